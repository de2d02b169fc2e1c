"""Cost-balanced packing (3): token ids into sequences of equal cost, with no padding.

Each task packs the documents it reads, window by window (some four million
tokens), so that nothing is shuffled and memory stays bounded. In a window the
pieces are taken from long to short; each goes to the sequence of lowest cost so
far that has room for it. A piece of n tokens costs ``n + n**2 / capacity``: the
linear layers and attention inside the piece. Where no sequence has room for a
whole piece it is cut. A window opens just as many sequences as its tokens fill;
tokens beyond that wait for the next window, and those at the very end of a
partition go to sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; a text of any length is
cut into as many pieces as needed; repeated rows are packed each for itself; an
empty table gives no pieces; columns beside id and text are not read.
"""

import heapq
import sys
import types
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm._text import small_batches, slices

WINDOW_TOKENS = 4 << 20
#: Entries of the word memo; it starts anew when full, and with each task, as Python workers outlive their tasks.
MEMO_WORDS = 200_000
#: Bytes of text whose words are lists at one time; such lists take several times the text.
ENCODE_BYTES = 1 << 20

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))


class WordTokenizer:
    """Ids of whole texts for a tokenizer that drops white space and never joins words.

    Ids are kept per word, since all words between white space are encoded apart
    from each other. A new word of Latin letters, with or without ASCII signs
    after it, is cut before the signs, as the tokenizer does, and its letters skip
    the normalizer and the word pattern; every other word (digits, apostrophes,
    special tokens, other scripts) goes through the whole tokenizer.

    A word has a number, and numbers say where its ids stand in one array, so a
    text costs one dictionary lookup a word and its ids are gathered in numpy.
    """

    def __init__(self, definition: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        spaces, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # ASCII letters are their own bytes.
        self.letters = {True: Tokenizer.from_str(definition), False: Tokenizer.from_str(definition)}
        for ascii_only, t in self.letters.items():
            t.normalizer = None
            t.pre_tokenizer = spaces if ascii_only else pre_tokenizers.Sequence([spaces, as_bytes])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.memo_words = memo_words
        self.forget()

    def forget(self) -> None:
        """Empty the memo."""
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, "<u4"), 0
        self.number[b""]  # number 0, no ids

    def _numbers(self, words: Iterable[bytes], n: int) -> np.ndarray:
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, n)
        while len(self.number) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        return found

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and where each word's end."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - (ends - sizes), sizes)
        return self.ids[at], ends

    def _encode_runs(self, words: list[bytes], ascii_only: bool) -> None:
        """Words that the tokenizer for letters takes, many in one call; a word ends at a token with the suffix."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            found = self.letters[ascii_only].encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(part):
                self._store(self._numbers(part, len(part)), ids, np.diff(stops, prepend=0))
            else:
                self._encode_whole(part)

    def _encode_whole(self, words: list[bytes]) -> None:
        texts = [t.decode("utf-8", "replace") for t in words]
        found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._store(self._numbers(words, len(words)), np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes)

    def _learn(self, words: list[bytes], known: int) -> None:
        """Ids of new words; numbers from ``known`` on have none yet."""
        number = self.number
        plain: dict[bool, set[bytes]] = {True: set(), False: set()}
        made, tailed, whole = [], [], set()
        for w in words:
            core = w.rstrip(_SIGNS)
            if core.isalpha():  # ASCII letters only, as these are bytes
                low, ascii_only = core.lower(), True
            else:
                text = core.decode("utf-8", "replace").lower()
                # Letters below U+0250 are stable under the tokenizer's normalizer once they are small.
                if not (text.isalpha() and max(text) < "\u0250"):
                    whole.add(w)
                    continue
                low, ascii_only = text.encode(), text.isascii()
            if number[low] >= known:
                plain[ascii_only].add(low)
            if low != w:
                tail = w[len(core) :]
                tailed += (low, tail)
                if number[tail] >= known:
                    whole.add(tail)
                made.append(w)
        for ascii_only, own in plain.items():
            self._encode_runs(list(own), ascii_only)
        self._encode_whole(list(whole))
        ids, ends = self._gather(self._numbers(tailed, len(tailed)))
        self._store(self._numbers(made, len(made)), ids, np.diff(ends[1::2], prepend=0))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        piece = np.cumsum([len(t) for t in texts]) // ENCODE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
        return [ids for low, high in zip(edges, edges[1:]) for ids in self._encode(texts[low:high])]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.number) > self.memo_words:
            self.forget()
        # Small letters share entries; special tokens are only such as they are written.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known, counts = len(self.number), np.fromiter(map(len, split), np.int64, len(split))
        numbers = self._numbers(chain.from_iterable(split), int(counts.sum()))
        fresh = len(self.number) - known
        self._learn(list(islice(reversed(self.number), fresh)), known)
        ids, ends = self._gather(numbers)
        ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids, ends[:-1])


def _shared_tokenizer(definition: str) -> WordTokenizer:
    """One tokenizer per Python worker, kept from task to task."""
    held = sys.modules.setdefault("_word_tokenizers", types.ModuleType("_word_tokenizers"))
    if getattr(held, "definition", None) != definition:
        held.definition, held.tokenizer = definition, WordTokenizer(definition)
    return held.tokenizer


def assign(lengths: list[int], room: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset) for pieces of the given lengths.

    ``room`` holds the sequences' capacities; their sum must be that of the lengths.
    """
    room, size = list(room), list(room)
    pieces = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(pieces)
    open_, parked, out = [(0.0, s) for s in range(len(room))], [], []
    while pieces:
        n, i, start = heapq.heappop(pieces)
        n = -n
        # Pieces get shorter, so a sequence that was too full for one may suit a later one.
        while parked and -parked[0][0] >= n:
            _, cost, s = heapq.heappop(parked)
            heapq.heappush(open_, (cost, s))
        while open_ and room[open_[0][1]] < n:
            cost, s = heapq.heappop(open_)
            heapq.heappush(parked, (-room[s], cost, s))
        _, cost, s = (0, *heapq.heappop(open_)) if open_ else heapq.heappop(parked)
        take = min(n, room[s])
        out.append((i, start, take, s, size[s] - room[s]))
        room[s] -= take
        if room[s]:
            heapq.heappush(open_, (cost + take + take * take / capacity, s))
        if take < n:
            heapq.heappush(pieces, (take - n, i, start + take))
    return out


def pack_documents(docs: DataFrame, definition: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, and ``ids``, its little-endian 32-bit token ids.

    ``definition`` is the JSON text of a tokenizer whose words do not join across white space.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in names),
                        T.StructField("ids", T.BinaryType())])
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(definition)  # the size of a vocabulary file

    def close(held: list, last: bool, base: int) -> tuple[list, list, int]:
        """Rows of a window, what is left for the next one, and the next sequence number."""
        total = sum(len(h[3]) for h in held)
        spare, left = total % capacity, []
        while spare and not last:
            row, start, whole, ids = held.pop()
            keep = max(0, len(ids) - spare)
            if keep:
                held.append((row, start, whole, ids[:keep]))
            left.append((row, start + keep, whole, ids[keep:]))
            spare -= len(ids) - keep
        room = [capacity] * ((total - (0 if last else total % capacity)) // capacity)
        if last:
            room += [1 << b for b in range(spare.bit_length() - 1, -1, -1) if spare >> b & 1]
        made = []
        for i, start, n, s, offset in assign([len(h[3]) for h in held], room, capacity):
            row, first, whole, ids = held[i]
            made.append((row, first + start, n, whole, base + s, offset, ids[start : start + n].tobytes()))
        return made, left, base + len(room)

    def batches_of(made: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(made), 2000):
            columns = list(zip(*made[low : low + 2000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], out.names)

    def run(batches):
        tokenizer = _shared_tokenizer(sent.value)
        base = TaskContext.get().partitionId() << 33
        held, tokens, kind = [], 0, None
        for part, texts in slices(batches, "body"):
            kind = part.schema.types[0]
            for row, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts)):
                ids = np.append(ids, np.array([end_id], "<u4"))
                held.append((row, 0, len(ids), ids))
                tokens += len(ids)
                if tokens >= window_tokens:
                    made, held, base = close(held, False, base)
                    tokens = sum(len(h[3]) for h in held)
                    yield from batches_of(made, kind)
        if held:
            yield from batches_of(close(held, True, base)[0], kind)
        tokenizer.forget()

    return rows.mapInArrow(run, out)
