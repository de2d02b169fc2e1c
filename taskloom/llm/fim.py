"""Fill-in-middle (12): documents cut into prefix, middle and suffix, and written in the order a model learns to fill.

A text is handled as its UTF-8 bytes. ``Exceptions`` is its sparse index: only the
characters of more than one byte are recorded, by where they stand and how many bytes
they take beyond the first. Between two of them bytes and code points run in step, so a
cut is converted by one binary search and one subtraction; an ASCII text has an empty
index. Two cuts are drawn by hash among the n + 1 ends of n units: tokens (runs of ASCII
letters, every other character alone) or characters.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` is the text as it is, for empty texts, texts that hold one of the marks, and
the share that the hash leaves out. ``restored`` rebuilds the text from output and form.

Defined cases: a null text counts as empty; a null id is drawn for as the empty string;
bytes that are not UTF-8 become U+FFFD first; equal cuts give an empty middle; repeated
rows are drawn alike, one row each; an empty table gives an empty result; only id and
text are read, whatever other columns are called; texts are read whole.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._text import slices, small_batches

MARKS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Exceptions:
    """Where the multibyte characters of a text stand, and the excess bytes up to each."""

    def __init__(self, raw: np.ndarray):
        self.at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at_byte]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.cumsum(own)
        self.at_point = self.at_byte - (excess - own)
        self.before = np.concatenate([[0], excess])

    def to_points(self, byte: int) -> int:
        """Code points before a byte offset that no character straddles."""
        return byte - int(self.before[np.searchsorted(self.at_byte, byte)])

    def to_bytes(self, point: int) -> int:
        return point + int(self.before[np.searchsorted(self.at_point, point)])


def token_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens of a text begin."""
    letter = _LETTER[raw]
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearrange(text: bytes, key: str, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20,
              unit: str = "token") -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text of well-formed UTF-8."""
    raw = np.frombuffer(text, np.uint8)
    index = Exceptions(raw)
    starts = token_starts(raw) if unit == "token" else None
    n = len(starts) if unit == "token" else index.to_points(len(raw))
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= fim_percent or any(m.encode() in text for m in MARKS):
        return n, "plain", None, None, text
    cuts = []
    for at in sorted((h1 % (n + 1), h2 % (n + 1))):
        if unit == "token":
            byte = int(starts[at]) if at < n else len(raw)
            cuts.append((byte, index.to_points(byte)))
        else:
            cuts.append((index.to_bytes(at), at))
    (a, a_point), (b, b_point) = cuts
    p, s, m = (mark.encode() for mark in MARKS)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a_point, b_point - a_point, b"".join((s, tail, p, head, m, middle))
    return n, "psm", a_point, b_point - a_point, b"".join((p, head, s, tail, m, middle))


def _clean(text: bytes) -> bytes:
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            return text.decode("utf-8", "replace").encode()
    return text


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, unit: str = "token",
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n (units), form, prefix_chars, middle_chars and ``output``. No shuffle."""
    if unit not in ("token", "char"):
        raise ValueError(f"unit is token or char, not {unit}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), F.col(id_col).cast("string").alias("key"))
    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for part, texts in slices(batches, "body"):
            keys = part.column(2).to_pylist()
            found = zip(*(rearrange(_clean(t), k or "", seed, fim_percent, spm_percent, unit) for t, k in zip(texts, keys)))
            columns = [pa.array(c, kind) for c, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns[:4], columns[4].cast(pa.string())], out.names)

    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    p, s, m = MARKS
    middle = F.substring_index(output, m, -1)
    first = F.substring_index(output, m, 1)  # the two other parts, with their marks
    head = F.when(form == "psm", F.substring_index(first, s, 1)).otherwise(F.substring_index(first, p, -1))
    tail = F.when(form == "psm", F.substring_index(first, s, -1)).otherwise(F.substring_index(first, p, 1))
    head = F.when(form == "psm", F.substring(head, len(p) + 1, 1 << 30)).otherwise(head)
    tail = F.when(form == "psm", tail).otherwise(F.substring(tail, len(s) + 1, 1 << 30))
    return F.when(form == "plain", output).otherwise(F.concat(head, middle, tail))


#: The query's rows in DuckDB SQL, tokens cut by pattern.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents
), t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""
