"""Quality rules (6): base counts of a text, and gradient-boosted trees over document statistics.

``text_statistics`` turns whole texts into counts. ``fit_trees`` grows boosted
trees on a bounded sample of labelled rows; chosen statistics have a monotonic
constraint, so that more symbols or more repetition can never raise the score.
The trees are flattened into node arrays, and a batch of documents walks down
all of them at once with numpy.

Defined cases: a null text counts as empty; no words means base_failed; a text
of any length is read whole; repeated rows get equal answers, one row each; an
empty table gives an empty result; without labels of both classes there are no
trees and the base rules alone decide.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._text import arrow_type, covered, free_name, hash64, slices, small_batches, window_hash

#: Bound on the labelled rows that the trees are fitted on.
TRAIN_ROWS = 20_000
#: Statistics that the trees see; the sign is the constraint on the score (0: none).
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "pipes_per_word": -1, "shouts_per_word": -1,
    "capital_share": -1, "digit_share": 0, "dup_line_share": -1, "repeat_share": -1, "words_per_line": 0,
    "stops_per_word": 0, "distinct_share": 0,
}
_SPACES = " \t\n\v\f\r"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def count_text(raw: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the statistics of one text."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.split()] if n else []
    dup = len(lines) - len(set(lines))
    repeat = distinct = 0
    if n:
        h = hash64(words)
        distinct = len(np.unique(h))
    if n >= 5:
        w = window_hash(h, 5, 6)
        _, at, found = np.unique(w, return_inverse=True, return_counts=True)
        repeat = int(covered(np.flatnonzero(found[at] > 1), 5, n).sum())
    per = max(n, 1)
    letters = max(len(raw), 1)
    statistics = [
        float(np.log1p(n)), chars / per, symbols / per, raw.count(b"|") / per, raw.count(b"!") / per,
        (len(raw) - len(raw.translate(None, _CAPITALS))) / letters, (len(raw) - len(raw.translate(None, _DIGITS))) / letters,
        dup / max(len(lines), 1), repeat / per, n / max(len(lines), 1), raw.count(b".") / per, distinct / per,
    ]
    return (n, chars, symbols, dup, repeat), statistics


@dataclass
class Trees:
    """Node arrays of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 32, least: int = 20, keep: float = 0.995) -> Trees | None:
    """Boosted trees with logistic loss and monotonic constraints.

    A leaf has at least ``least`` rows, or fewer where a class is so small that its rows could not be told apart then.
    A fifth of the rows (every fifth) is held out. The cut is the score that
    ``keep`` of the good held-out rows reach, but at most 0 (even odds).
    """
    if len(y) < 2 * least or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 5 == 4
    if not (y[held] == 1).any():
        held[:] = False
    xt, yt = x[~held], y[~held].astype(float)
    if yt.min() == yt.max():
        return None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in xt.T]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, xt.T)], axis=1)
    least = max(2, min(least, int(min(yt.sum(), len(yt) - yt.sum())) // 6))
    mean = yt.mean()
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(yt), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(feature)
        out = float(np.clip(g[rows].sum() / (h[rows].sum() + 1), low, high))
        for column, v in ((feature, 0), (threshold, 0.0), (left, me), (right, me), (value, out * rate)):
            column.append(v)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, sign in enumerate(signs):
                k = len(cuts[f])
                if not k:
                    continue
                code = coded[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(code, w, k + 1))[:-1] for w in (g[rows], h[rows], None))
                a = np.clip(gs / (hs + 1), low, high)
                b = np.clip((total_g - gs) / (total_h - hs + 1), low, high)
                gain = gs * gs / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < least) | (len(rows) - ns < least) | (sign * (b - a) < 0)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (f, i, float(a[i]), float(b[i])))
        if best[1] is None:
            score[rows] += value[me]
            return me
        f, i, a, b = best[1]
        middle = (a + b) / 2
        spans = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[signs[f]]
        goes = coded[rows, f] <= i
        feature[me], threshold[me] = f, float(cuts[f][i])
        left[me] = node(rows[goes], g, h, level + 1, *spans[:2])
        right[me] = node(rows[~goes], g, h, level + 1, *spans[2:])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        roots.append(node(np.arange(len(yt)), yt - p, p * (1 - p), 0, -4.0, 4.0))
    trees = Trees(*map(np.array, (feature, threshold, left, right, value, roots)), depth, bias, 0.0)
    good = trees.score(x[held & (y == 1)]) if held.any() else trees.score(xt[yt == 1])
    trees.cut = min(0.0, float(np.quantile(good, 1 - keep)))
    return trees


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id and ``stats``, the statistics in the order of ``STATISTICS``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for part, texts in slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([count_text(t)[1] for t in texts], pa.list_(pa.float64()))], ["id", "stats"])

    return rows.mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = TRAIN_ROWS) -> Trees | None:
    """Fit on at most ``max_rows`` labelled documents, those with the least hash of their id."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    # The sample is bounded by max_rows, so it can be sent to every task.
    picked = texts.join(F.broadcast(known), "id", "left_semi")
    sample = text_statistics(picked, "id", "body").join(F.broadcast(known), "id").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = sample.select("stats", "label").toArrow()
    if not found.num_rows:
        return None
    x = np.array(found.column("stats").to_pylist(), float)
    return fit_trees(x, np.array(found.column("label").to_pylist()), list(STATISTICS.values()))


def score_documents(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents, and a struct ``quality`` (named aside if that is taken) with the
    counts, ``score``, ``base_failed`` and ``kept``. No shuffle: each batch is counted and scored where it is read.
    """
    name = free_name(docs.columns, "quality")
    body = free_name([*docs.columns, name], "body")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in counts), T.StructField("score", T.DoubleType()),
                         T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    width, inner = len(docs.columns), arrow_type(kind)

    def run(batches):
        for part, texts in slices(batches, body):
            found = [count_text(t) for t in texts]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
            score = trees.score(np.array([f[1] for f in found])) if trees else np.zeros(len(found))
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            kept = ~failed & (score >= (trees.cut if trees else 0.0))
            made = pa.StructArray.from_arrays([*map(pa.array, base.T.copy()), pa.array(score), pa.array(failed), pa.array(kept)], fields=list(inner))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], made], [*part.schema.names[:width], name])

    small_batches(docs.sparkSession)
    rows = docs.withColumn(body, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))
