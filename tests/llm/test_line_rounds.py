"""Line templates beyond the second of a leaf."""

import pytest

from taskloom.llm import linededup

EVENTS = ["user {} logged in from the office", "device {} was removed by the night shift", "printer {} reports an empty tray again", "door {} stood open for too long",
          "queue {} grew beyond its usual length today"]
NAMES = ["anna", "berta", "carla", "dora", "edna"]


def logs():
    """Each document has a line of every event, with a word of its own as variable field."""
    lines = [[f"2024-01-0{d} 10:1{e} host{d} " + text.format(name) for e, text in enumerate(EVENTS)] for d, name in enumerate(NAMES)]
    # As many tokens in each event, so that all lines fall into one leaf.
    width = max(len(x.split()) for own in lines for x in own)
    return [(d, "\n".join(" ".join([*x.split(), *["end"] * (width - len(x.split()))]) for x in own)) for d, own in enumerate(lines)]


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_every_template_of_a_leaf_is_found(spark, monkeypatch, cells):
    monkeypatch.setattr(linededup, "LEAF_CELLS", cells)
    monkeypatch.setattr(linededup, "LEADS", 2)
    docs = spark.createDataFrame(logs(), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["lines"]["n_dropped"] for r in linededup.drop_recurring(docs).collect()}
    assert got == {0: 0, **{d: len(EVENTS) for d in range(1, len(NAMES))}}


def test_two_documents_and_short_lines(spark, monkeypatch):
    import corpus_pipeline

    rows = [(0, "in two docs only this stands\nshort line\nSubscribe\n\npage 7\n9"), (1, "other words\nin two docs only this stands\nSubscribe\n\npage 8\n8"),
            (2, "short line\n\nlast one\nSHORT line"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int")
    want = {0: rows[0][1], 1: "other words\n\npage 8\n8", 2: "\nlast one\nSHORT line", 3: None, 4: ""}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want
    monkeypatch.setattr(linededup, "LEAF_CELLS", 0)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want
