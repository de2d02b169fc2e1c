"""Terms of values in one document only, and terms far from the value."""

from taskloom.llm import pii


def test_rare_values_and_far_terms(spark):
    filler = " ".join(["and so on it goes"] * 8)
    texts = [f"The wizard zorblat answers at ann@mail.org today. {filler} Zorblat again.", "Ask ann@mail.org first.", f"ann@mail.org writes. {filler} Then zorblat came."]
    texts += [f"The people at work answers today, {filler}"] * 200
    docs = spark.createDataFrame(list(enumerate(texts + ["Quixotic glimmer: bob@mail.org, today. " + filler + " quixotic"])), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"] if s["kind"] != "email"] for r in pii.find(docs).collect()}
    marked = lambda i, t: [(k, t[a:b].lower()) for k, a, b in found[i]]
    assert [w for _, w in marked(203, docs.where("doc_id = 203").first()["text"])].count("quixotic") == 2  # one document, near and far
    assert {"glimmer", "quixotic"} == {w for _, w in marked(203, docs.where("doc_id = 203").first()["text"])}
    assert [w for _, w in marked(0, texts[0])].count("zorblat") == 2 and "answers" not in [w for _, w in marked(0, texts[0])]
    assert "zorblat" in [w for _, w in marked(2, texts[2])] and not found[5]
