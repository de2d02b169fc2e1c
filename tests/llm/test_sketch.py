"""Merged sketches: repeated keys are always found, at one chunk a row and at several."""

import numpy as np
import pytest

from taskloom.llm import _sketch

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@pytest.mark.parametrize("bits", [20, 22])
def test_repeated_keys_are_found(spark, bits):
    def count(batches):
        keys = [b.column(0).to_numpy().astype(np.uint64) * _SPREAD for b in batches]
        yield from _sketch.touches(keys, bits)

    rows = spark.range(0, 30_000, 1, 4).selectExpr("id % 25000 AS id")  # the first 5,000 keys lie in two tasks
    repeated = _sketch.lookup(_sketch.merged(rows.mapInArrow(count, _sketch.TOUCHES), bits), bits)
    found = repeated(np.arange(25_000).astype(np.uint64) * _SPREAD)
    assert found[:5000].all() and found[5000:].mean() < 0.01
    none = _sketch.lookup(_sketch.merged(rows.where("id < 0").mapInArrow(count, _sketch.TOUCHES), bits), bits)
    assert not none(np.arange(100).astype(np.uint64) * _SPREAD).any()
