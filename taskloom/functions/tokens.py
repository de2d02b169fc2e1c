"""Token lengths with a tokenizer of the caller's, as a column."""

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a tokenizer gets in one call hold some so many characters.
CALL_CHARS = 1 << 20

Counter = Callable[[list[str]], list[int]]


def token_length(load: Callable[[], Counter], name: str) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens, for ``exchange.length_gate``; null counts 0.

    ``load`` makes the counter (texts to lengths) once in each Python worker, which keeps it from task to task under
    ``name``; the name should tell versions apart.
    """

    def counter() -> Counter:
        held = sys.modules.setdefault("_token_counters", types.ModuleType("_token_counters"))
        if not hasattr(held, name):
            setattr(held, name, load())
        return getattr(held, name)

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter()
        for texts in batches:
            out, part, chars = [], [], 0
            for text in texts.fillna(""):
                part.append(text)
                chars += len(text)
                if chars >= CALL_CHARS:
                    out += count(part)
                    part, chars = [], 0
            yield pd.Series(out + (count(part) if part else []), dtype="int64")

    return lambda text: lengths(text.cast("string"))


def tokenizer_length(definition: str, special_tokens: bool = False) -> Callable[[Column], Column]:
    """``token_length`` for the JSON text of a tokenizer, as the ``tokenizers`` library stores it. It travels with the task."""

    def load() -> Counter:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=special_tokens)]

    return token_length(load, "t" + hashlib.md5(f"{special_tokens}{definition}".encode()).hexdigest())
