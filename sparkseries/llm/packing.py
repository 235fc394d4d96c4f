"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import bisect
import contextlib
import gc
import itertools
import math
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dense_rank_in, in_short_batches, table, tidy_worker

TOKENIZER = "word_bpe_49k.json"
#: Units (words without case, and marks) of a worker's table up to which it takes in those of more texts; beyond, and when the task ends, it is emptied.
CACHE_ENTRIES = 250_000
#: Plain words that are encoded as one text.
JOINED_WORDS = 256
#: Arrow also splits at these four, which the tokenizer's \s does not hold for white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space of the tokenizer (fixed values).
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = dict.fromkeys(map(ord, _SPACES), " ")
#: Marks that may follow a word; the apostrophe, which the tokenizer treats in its own way, is not among them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What ``_plain`` takes, and the marks at the end of a word, for Arrow.
_PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_ENDING = "(?P<marks>[" + "".join("\\" + c for c in _MARKS) + "]*)$"

_state: dict = {}


class _Numbers(dict):
    """Numbers of strings in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Table:
    """Of each unit its ids, all units' in a row."""

    def __init__(self) -> None:
        self.units = _Numbers({"": 0})
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)


def _forget() -> None:
    _state.clear()


def _tokenizer(path: str) -> dict:
    if _state.get("path") != path:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tokenizer = Tokenizer.from_file(path)
        joined = Tokenizer(tokenizer.model)
        joined.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # byte-level letters of the bytes: printable bytes stand for themselves, the others for 256, 257, ... in turn
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}
        # the last id of a word is one whose token has the model's suffix
        suffix = tokenizer.model.end_of_word_suffix
        last = np.array([(joined.id_to_token(i) or "").endswith(suffix) for i in range(joined.get_vocab_size())])
        _state.update(path=path, tokenizer=tokenizer, joined=joined, last=last, letters=letters, table=_Table())
    return _state


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Without cyclic collection, which would go over millions of small objects, none in a circle, again and again."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def _split(texts: list[str]) -> pa.ListArray:
    """The blank-delimited strings of each text; some may be empty."""
    if not any(c in t for t in texts for c in _SEPARATORS):
        return pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    return pa.array([t.translate(_BLANKS).split(" ") for t in texts], pa.list_(pa.string()))


def _plain(word: str) -> bool:
    """One run of letters to the tokenizer, also when it is lower-cased."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


def _learn(units: list[str], state: dict) -> None:
    """Put the ids of these units into the worker's table. What is plain is one word to the model behind the tokenizer, which takes many of them as one text, quicker than the tokenizer does."""
    table, letters = state["table"], state["letters"]
    is_plain = np.array([_plain(w) for w in units], dtype=bool)
    plain = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in itertools.compress(units, is_plain)]
    texts = [" ".join(plain[k : k + JOINED_WORDS]) for k in range(0, len(plain), JOINED_WORDS)]
    rest = list(itertools.compress(units, ~is_plain))
    joined = [np.array(e.ids, dtype="<u4") for e in state["joined"].encode_batch_fast(texts, add_special_tokens=False)]
    others = [np.array(e.ids, dtype="<u4") for e in state["tokenizer"].encode_batch_fast(rest, add_special_tokens=False)]
    ids = np.concatenate([np.zeros(0, dtype="<u4"), *joined])
    ends = np.flatnonzero(state["last"][ids]) + 1
    if len(ends) != len(plain):
        raise ValueError("the tokenizer's model does not mark the ends of words")
    # plain units first, then brought into the order of the units' numbers
    lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(e) for e in others], dtype=np.int64)])
    order = np.argsort(np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]))
    ids = _gathered(np.concatenate([ids, *others]), np.cumsum(lengths) - lengths, lengths, order)
    table.ends = np.concatenate([table.ends, len(table.ids) + np.cumsum(lengths[order])])
    table.ids = np.concatenate([table.ids, ids])


def _gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` with these numbers one after another."""
    n = lengths[which]
    return values[np.repeat(begins[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _numbers(units: pa.StringArray, table: _Table) -> np.ndarray:
    """The number of each unit in the worker's table."""
    places = units.dictionary_encode()
    different = places.dictionary.to_numpy(zero_copy_only=False)
    return np.fromiter(map(table.units.__getitem__, different), dtype=np.int64, count=len(different))[places.indices.to_numpy()]


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, as the tokenizer gives them without special tokens.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    blank-delimited strings in turn. Each distinct string is looked up; a word in any case with marks after it
    is the lower-case word and the marks, which the tokenizer separates.
    """
    state = _tokenizer(path)
    if len(state["table"].units) > CACHE_ENTRIES:
        state["table"] = _Table()
    table, words = state["table"], _split(texts)
    places = words.flatten().dictionary_encode()
    different = places.dictionary
    # a word is two units, of which the second may be the empty one
    stems = pc.utf8_rtrim(different, _MARKS)
    plain = pc.match_substring_regex(stems, _PLAIN)
    first = pc.if_else(plain, pc.utf8_lower(stems), different)
    marks = pc.if_else(plain, pc.struct_field(pc.extract_regex(different, _ENDING), "marks"), "")
    before = len(table.units)
    pairs = np.stack([_numbers(first, table), _numbers(marks, table)], axis=1)
    _learn(list(itertools.islice(table.units, before, None)), state)
    begins = np.concatenate([[0], table.ends[:-1]])
    lengths = table.ends - begins
    indices = places.indices.to_numpy()
    return [_gathered(table.ids, begins, lengths, pairs[indices[a:b]].ravel()).tobytes() for a, b in itertools.pairwise(words.offsets.to_pylist())]


def _pieces(path: str, capacity: int, end_id: int):
    """Batches of (key, text) to batches of pieces; about 2 MB of text are encoded at a time."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def some(keys: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in ("key", "piece", "start", "length", "ids_crc32")}
        with _uncollected():
            encoded = encode_all(texts, path)
        for key, ids in zip(keys, encoded, strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for n, v in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[n].append(v)
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 2_000_000:
                    yield some(keys, texts, batch.schema.field(0).type)
                    keys, texts, size = [], [], 0
            if keys:
                yield some(keys, texts, batch.schema.field(0).type)

    return run


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack ``counts[length]`` items of each length; only the counts are needed, however many items there are.

    Returns rows (length, first rank, items, first sequence, offset): the items of that length with
    ranks first, first + 1, ... go to sequences first, first + 1, ..., each at that offset; and the
    number of sequences. Items above a third of the capacity: the largest left is paired with the
    largest that fits, at most two in a sequence. Smaller ones, largest first, go where the gap
    is the smallest that takes them; new sequences are opened only when no gap does.
    """
    left = {int(n): int(c) for n, c in counts.items() if c}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first sequence, sequences)
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(length: int, first: int, n: int, offset: int) -> None:
        rows.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while k >= 0 and left[large[k]] < (2 if large[k] == a else 1):
                k -= 1
            b = large[k] if k >= 0 else 0
            n = left[a] if not b else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, opened, n, 0)
            if b:
                place(b, opened, n, a)
            gaps[capacity - a - b].append((opened, n))
            opened += n
    open_gaps = sorted(g for g in gaps if g)
    for s in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(open_gaps, s)
            if k == len(open_gaps):
                n = math.ceil(left[s] / (capacity // s))
                gaps[capacity].append((opened, n))
                opened += n
                open_gaps.append(capacity)
                continue
            g = open_gaps[k]
            first, n = gaps[g].pop()
            each = min(g // s, left[s])
            full = max(1, min(n, left[s] // each))
            for j in range(each):
                place(s, first, full, capacity - g + j * s)
            if full < n:
                gaps[g].append((first + full, n - full))
            if not gaps[g]:
                open_gaps.pop(k)
            rest = g - each * s
            if rest:
                if not gaps[rest]:
                    bisect.insort(open_gaps, rest)
                gaps[rest].append((first, full))
    return rows, opened


def _realise(plan: np.ndarray):
    """Look each (length, rank) up in the plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = np.int64(1) << 44
        keys = plan[:, 0] * step + plan[:, 1]
        for batch in batches:
            at = np.searchsorted(keys, batch["length"].to_numpy() * step + batch["rank"].to_numpy(), side="right") - 1
            found = plan[at]
            yield batch.assign(sequence_id=found[:, 3] + batch["rank"].to_numpy() - found[:, 1], offset=found[:, 4]).drop(columns="rank")

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, *, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """Tokenise documents, cut those over ``capacity`` ids and pack the pieces into as few sequences as best fit can.

    Returns ``key, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece. The plan is
    made from the number of pieces of each length (``capacity`` numbers, whatever the input) and
    realised by each piece's rank among those of its length.

    A null or empty text is the end id alone; a very long one becomes many pieces; null keys are kept;
    repeated rows are packed each. Pieces of one length are interchangeable: which of them goes where
    is arbitrary. An empty table gives no rows. Other columns are ignored.
    """
    path = public_tokenizers.path(tokenizer)
    kind = docs.schema[key].dataType.simpleString()
    pieces = cut(in_short_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy_worker(_pieces(path, capacity, end_id), _forget), f"key {kind}, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(plan_packing(counts, capacity)[0]), dtype=np.int64).reshape(-1, 5)
    buckets = max(8, math.ceil(sum(counts.values()) / 1_000_000))
    ranked = dense_rank_in(pieces, ["length"], ["key", "piece", "ids_crc32"], F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)), "rank")
    ranked = ranked.select("key", "piece", "start", "length", "ids_crc32", "rank")
    out = ranked.mapInPandas(_realise(plan), f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), 2048)
