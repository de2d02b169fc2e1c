"""Counts of many fixed terms in one pass over a text: an automaton over code points, as an Arrow column.

A scan for each term reads a text as often as there are terms. The automaton
reads it once, and Python only sees the places where a term ends. It is made
once a task. The caller brings texts and terms to the same case.
"""

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand over at most 8 MB of texts at a time, so that long ones don't fill the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _automaton(terms: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, (i, len(term)))
    found.make_automaton()
    return found


def _distinct(terms: Sequence[str]) -> list[str]:
    if not terms or not all(terms):
        raise ValueError("terms must be given and not be empty")
    return list(dict.fromkeys(terms))


def term_counts(col: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """A struct with one int a group: the occurrences of its terms, summed.

    A term's occurrences are taken from left to right and don't overlap each other; those of different terms may. A term
    listed twice in a group counts twice. Null counts 0.
    """
    names = list(groups)
    terms = _distinct([t for g in groups.values() for t in g])
    weight = [[list(groups[g]).count(t) for t in terms] for g in names]
    kind = pa.struct([(g, pa.int32()) for g in names])

    @F.arrow_udf("struct<" + ", ".join(f"`{g}`: int" for g in names) + ">")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(terms)
        for texts in batches:
            sums: list[list[int]] = [[] for _ in names]
            for text in texts.to_pylist():
                n, free = [0] * len(terms), [0] * len(terms)
                for end, (i, length) in automaton.iter(text or ""):
                    if end - length + 1 >= free[i]:
                        n[i] += 1
                        free[i] = end + 1
                for column, w in zip(sums, weight):
                    column.append(sum(map(int.__mul__, n, w)))
            yield pa.StructArray.from_arrays([pa.array(s, pa.int32()) for s in sums], fields=list(kind))

    return counts(col.cast("string"))
