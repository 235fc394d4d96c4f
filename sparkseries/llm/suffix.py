"""Removal of repeated byte strings by two-stage suffix sorting and adjacent common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_short_batches, join_checked, table, tidy_worker

#: Bytes of a repeated string; of an anchor.
LENGTH, ANCHOR = 400, 16
#: Different contexts under one key up to which they are sorted together, and windows of the parts into which those of a key with more are cut, again and again.
HOT, STEPS = 256, (50, 7, 1)
#: Bytes at which windows begin that are sorted at a time; bytes anchored at a time; most bytes (or words) of a piece.
CHUNK_WINDOWS, CHUNK_BYTES, MOST_BYTES = 60_000, 300_000, 1_000_000


class Strings(NamedTuple):
    """What is compared: strings of ``length`` symbols with anchors of ``anchor`` symbols, of ``unit`` bytes each; ``steps`` are those into which hot contexts are cut."""

    length: int
    anchor: int
    unit: int
    steps: tuple[int, ...]

    @property
    def shared(self) -> int:
        """Symbols that the strings of a group have in common with each other at least."""
        return self.length // 2

    @property
    def depth(self) -> int:
        """Bytes of a string of symbols."""
        return self.length * self.unit

    @property
    def dtype(self) -> str:
        return f"<u{self.unit}"


#: Strings of bytes, and passages of 50 words, a word being its 64-bit hash.
BYTES, WORDS = Strings(LENGTH, ANCHOR, 1, STEPS), Strings(50, 4, 8, (7, 1))

_BASES = (np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93))
_POSITION = np.uint64((1 << 24) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _forget() -> None:
    _powers.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any substrings of some bytes, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        if which not in _powers or len(_powers[which][0]) <= len(data):
            size = max(len(data) + 1, CHUNK_BYTES + 150_000)
            pair = []
            for b in (_BASES[which], np.uint64(pow(int(_BASES[which]), -1, 2**64))):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            _powers[which] = (pair[0], pair[1])
        up, self.down = _powers[which]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    padded = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1), dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin and end."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of words, of about CHUNK_BYTES of the bytes at a time."""
    out, k = np.zeros(len(begins), dtype=np.uint64), 0
    while k < len(begins):
        to = max(k + 1, int(np.searchsorted(ends, begins[k] + CHUNK_BYTES, side="right")))
        out[k:to] = _Hashes(data[begins[k] : ends[to - 1]], 1).of(begins[k:to] - begins[k], ends[k:to] - begins[k])
        k = to
    return out


def symbols_of(texts: list[bytes], of: Strings) -> list[np.ndarray]:
    """The symbols of each text: its bytes, or the hashes of its words."""
    if of.unit == 1:
        return [np.frombuffer(t, dtype=np.uint8) for t in texts]
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    begins, ends = _words(data)
    hashes = _word_hashes(data, begins, ends)
    return np.split(hashes, np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def contexts_of(data: np.ndarray, ends: np.ndarray, of: Strings = BYTES) -> tuple[np.ndarray, ...]:
    """The contexts of texts whose symbols lie one after another in ``data`` and end at ``ends``: text, key, context, off, lo, windows.

    A window is a string of ``of.length`` symbols. Its anchor is the ``of.anchor`` symbols in it with the least hash, the first of equals;
    the windows with one anchor are consecutive. They are told apart by whether the ``of.shared`` symbols after the anchor, or
    before it, are in all of them; the hash of those is the key. A context is such a run of windows with all
    symbols they cover. Equal windows have the same place of the anchor, so the same key.
    """
    begins = np.concatenate([[0], ends[:-1]])
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    if len(data) < of.length:
        return none
    one, two = _Hashes(data, 0), _Hashes(data, 1)
    at = np.arange(len(data) - of.anchor + 1, dtype=np.int64)
    grams = (one.of(at, at + of.anchor) & ~_POSITION) | at.astype(np.uint64)
    anchor = (_window_min(grams, of.length - of.anchor + 1) & _POSITION).astype(np.int64)
    windows = np.maximum(0, ends - begins - of.length + 1)
    if not windows.sum():
        return none
    start = np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    text = np.repeat(np.arange(len(ends)), windows)
    where = anchor[start]
    after = where - start <= of.shared
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (after[1:] != after[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    lo, where, after, text = start[first], where[first], after[first], text[first]
    shared = np.where(after, where, where - of.shared)
    key = _mix(one.of(shared, shared + of.shared) + after.astype(np.uint64))
    context = two.of(lo, lo + count + of.length - 1)
    return text, key.view(np.int64), context.view(np.int64), where - lo, lo - begins[text], count


def _contexts(of: Strings):
    """Rows (id, h, key, ctx, off, lo, n) of batches (id, h, text); long texts in pieces that overlap by a window less one symbol."""
    names = ["id", "h", "key", "ctx", "off", "lo", "windows"]

    def some(ids: list, hashes: list, pieces: list[np.ndarray], shifts: list[int]) -> pa.RecordBatch:
        text, key, ctx, off, lo, count = contexts_of(np.concatenate(pieces), np.cumsum([len(p) for p in pieces]), of)
        columns = [np.array(ids, dtype=np.int64)[text], np.array(hashes, dtype=np.int64)[text], key, ctx, off.astype(np.int32), lo + np.array(shifts, dtype=np.int64)[text], count.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                held: tuple[list, list, list, list] = ([], [], [], [])
                size = 0
                for k, symbols in _symbols(batch.column(2), of):
                    for shift in range(0, max(1, len(symbols) - of.length + 1), MOST_BYTES):
                        piece = symbols[shift : shift + MOST_BYTES + of.length - 1]
                        if len(piece) >= of.length:
                            for to, v in zip(held, (ids[k], hashes[k], piece, shift), strict=True):
                                to.append(v)
                            size += len(piece)
                        if size >= CHUNK_BYTES:
                            yield some(*held)
                            held, size = ([], [], [], []), 0
                if size:
                    yield some(*held)

    return run


def _symbols(texts: pa.Array, of: Strings) -> Iterator[tuple[int, np.ndarray]]:
    """Number and symbols of each text; some CHUNK_BYTES are split into words together."""
    held: list[bytes] = []
    size = 0
    for k in range(len(texts)):
        held.append(texts[k].as_py() or b"")
        size += len(held[-1])
        if of.unit == 1 or size >= CHUNK_BYTES or k == len(texts) - 1:
            yield from enumerate(symbols_of(held, of), k - len(held) + 1)
            held, size = [], 0


def suffix_order(text: bytes, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The ``wanted`` suffixes of ``text`` in order of their first ``depth`` bytes, by two-stage sorting.

    A suffix is small if it is smaller than the one that begins a byte later. Small suffixes are sorted directly. A large
    one begins with a byte that is at least the next, and is ordered by that byte and then by its successor: buckets of
    equal first bytes are scanned from the least up, and each suffix found hands its predecessor, if that is
    large, the next place of the predecessor's bucket. Large suffixes stand before small ones in a bucket.

    Besides the wanted ones, the suffixes up to the next small one are ordered, as successors.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    # small or large, from the next byte that differs; the end counts as smaller than any byte
    change = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))
    run = np.repeat(change, np.diff(np.concatenate([[-1], change])))
    after = np.where(run + 1 < n, t[np.minimum(run + 1, n - 1)].astype(np.int16), -1)
    small = after > t
    ordered = np.zeros(n, dtype=bool)
    ordered[wanted] = True
    # close under successors: from a wanted large suffix on, up to the next small one
    last_wanted = np.maximum.accumulate(np.where(ordered, np.arange(n), -1))
    small_before = np.concatenate([[0], np.cumsum(small)])
    between = small_before[:-1] - np.where(last_wanted >= 0, small_before[np.maximum(last_wanted, 0)], 0)
    ordered |= (last_wanted >= 0) & (between == 0)
    direct = np.flatnonzero(ordered & small)
    keyed = sorted(zip([text[i : i + depth] for i in direct.tolist()], direct.tolist(), strict=True))
    sorted_small = np.fromiter((i for _, i in keyed), dtype=np.int64, count=len(keyed))
    bounds = np.searchsorted(t[sorted_small], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if ordered[n - 1]:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        large = waiting[c]
        new = np.concatenate(large) if large else np.zeros(0, dtype=np.int64)
        parts = []
        while len(new):
            parts.append(new)
            before = new[new > 0] - 1
            new = before[ordered[before] & (t[before] == c)]
        parts.append(sorted_small[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[ordered[before] & (t[before] > c)]
        kind = t[before]
        by_kind = before[np.argsort(kind, kind="stable")]
        counts = np.bincount(kind, minlength=256)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for k in np.flatnonzero(counts).tolist():
            waiting[k].append(by_kind[edges[k] : edges[k + 1]])
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    chosen = np.zeros(n, dtype=bool)
    chosen[wanted] = True
    return order[chosen[order]]


def common_prefixes(text: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each suffix but the first, whether it has its first ``depth`` bytes in common with the one before, compared eight bytes at a time."""
    words = np.ndarray(shape=(len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    alive = np.arange(len(order) - 1)
    for k in range(0, depth, 8):
        k = min(k, depth - 8)
        alive = alive[words[order[alive] + k] == words[order[alive + 1] + k]]
        if not len(alive):
            break
    same = np.zeros(max(0, len(order) - 1), dtype=bool)
    same[alive] = True
    return same


def repeated_windows(segments: list[bytes], windows: list[int], weights: list[int], of: Strings = BYTES) -> list[np.ndarray]:
    """For each segment, for each of its windows, whether it is in the segments more than once; a segment counts ``weights`` times."""
    # a byte between segments, so that no window wanted runs into the next one; bytes after the last for whole words
    begins = np.cumsum([0, *(len(s) + 1 for s in segments)])
    text = b"\0".join(segments) + b"\0" * 9
    counts = np.array(windows)
    edges = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    wanted = begins[owner] + (np.arange(edges[-1]) - edges[owner]) * of.unit
    order = suffix_order(text, wanted, of.depth)
    group = np.concatenate([[0], np.cumsum(~common_prefixes(text, order, of.depth))])
    at = np.zeros(len(text), dtype=np.int64)
    at[wanted] = np.arange(edges[-1])
    window = at[order]
    total = np.bincount(group, weights=np.array(weights, dtype=float)[owner[window]])
    repeated = np.zeros(edges[-1], dtype=bool)
    repeated[window] = total[group] >= 2
    return [repeated[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


def _fetch(of: Strings):
    """Of each context its symbols."""
    names = ["key", "ctx", "off", "windows", "weight", "hot", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows, size = [], 0
                for k, symbols in _symbols(batch.column(0), of):
                    for w in batch.column(1)[k].as_py():
                        rows.append((*(w[n] for n in names[:-1]), symbols[w["lo"] : w["lo"] + w["windows"] + of.length - 1].tobytes()))
                        size += len(rows[-1][-1])
                        if size > 4_000_000:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return run


def parts_of(segment: bytes, off: int, windows: int, step: int, of: Strings = BYTES) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """The parts of a context with up to ``step`` windows each: shift, key, context, off, windows, segment.

    Windows with one anchor are parted by the place of the anchor in them, so equal windows are in equal places of their parts.
    All windows of a part have ``of.length - step + 1`` symbols in common, which with that place are the key.
    """
    data = np.frombuffer(segment, dtype=of.dtype)
    one, two = _Hashes(data, 0), _Hashes(data, 1)
    place = (off - np.arange(windows)) // step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    last = off - place[first] * step  # where the last window of a whole part begins; the first one ends of.length - step + 1 further on
    key = _mix(one.of(last, last + of.length - step + 1) ^ _mix(place[first].astype(np.uint64) + np.uint64(step) * _BASES[1]))
    context = two.of(first, first + count + of.length - 1)
    for k, c, shift, n in zip(key.view(np.int64).tolist(), context.view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True):
        yield shift, k, c, off - shift, n, segment[shift * of.unit : (shift + n + of.length - 1) * of.unit]


def _cut_up(step: int, of: Strings):
    """Contexts to their parts."""
    names = ["of_key", "of_ctx", "of_off", "of_windows", "weight", "shift", "key", "ctx", "off", "windows", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for key, ctx, off, windows, weight, segment in zip(*(batch.column(n).to_pylist() for n in ("key", "ctx", "off", "windows", "weight", "segment")), strict=True):
                    rows += ((key, ctx, off, windows, weight, *part) for part in parts_of(segment, off, windows, step, of))
                    if len(rows) > 10_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return run


def _sort_groups(of: Strings):
    """Contexts in order of their keys to the runs of repeated windows of each; whole keys are sorted together, about CHUNK_WINDOWS bytes that begin windows at a time."""
    names = ["key", "ctx", "off", "windows"]
    most = CHUNK_WINDOWS // of.unit

    def done(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(names)
        flags = repeated_windows(frame["segment"].tolist(), frame["windows"].tolist(), frame["weight"].tolist(), of)
        runs = [_runs(f) for f in flags]
        out = frame[names].assign(begins=[r[0] for r in runs], ends=[r[1] for r in runs])
        return out[[bool(r[0]) for r in runs]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            while len(batch):
                total = size + np.cumsum(batch["windows"].to_numpy())
                over = int(np.searchsorted(total, most, side="right"))
                if over == len(batch):
                    held.append(batch)
                    size = int(total[-1])
                    break
                # up to the end of the key that is being read when the chunk is full
                keys = batch["key"].to_numpy()
                later = np.flatnonzero(keys[over:] != keys[over])
                end = over + int(later[0]) if len(later) else len(batch)
                held.append(batch[:end])
                if end == len(batch):
                    size = int(total[-1])
                    break
                yield done(pd.concat(held))
                held, size, batch = [], 0, batch[end:]
        if held:
            yield done(pd.concat(held))

    return run


def _identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, h, text`` of every row: rows with one id and one text are one thing with a weight."""
    body = F.col(text).cast("binary")
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))


_SAME = ["key", "ctx", "off", "windows"]


def _joined(spans: Column) -> tuple[Column, Column]:
    """Begins and ends of the runs that sorted runs (begin, end), some of which touch, make up."""
    begins = F.filter(spans, lambda x, i: (i == 0) | (F.get(spans, i - 1)["end"] < x["begin"]))["begin"]
    ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["begin"] > x["end"]))["end"]
    return begins.alias("begins"), ends.alias("ends")


def _repeated_runs(contexts: DataFrame, of: Strings, steps: tuple[int, ...]) -> DataFrame:
    """Of contexts (with ``weight, hot, segment``) the runs of windows that occur more than once: ``key, ctx, off, windows, begins, ends``.

    Keys that are not hot are suffix-sorted, each in one task. Contexts of a hot key are cut into parts, which have keys of their own, and so on down
    to parts of one window, of which there is only one under a key.
    """
    cold = contexts.filter(~F.col("hot")).select(*_SAME, "weight", "segment")
    found = cold.repartition("key").sortWithinPartitions("key").mapInPandas(tidy_worker(_sort_groups(of)), "key long, ctx long, off int, windows int, begins array<int>, ends array<int>")
    hot = contexts.filter("hot")
    if not steps or hot.isEmpty():
        return found
    once = hot.groupBy(*_SAME).agg(F.first("weight").alias("weight"), F.first("segment").alias("segment"))
    parts = cut(once.mapInArrow(tidy_worker(_cut_up(steps[0], of), _forget), "of_key long, of_ctx long, of_off int, of_windows int, weight long, shift int, key long, ctx long, off int, windows int, segment binary"))
    differ = parts.groupBy(*_SAME).agg(F.sum("weight").alias("weight"), F.first("segment").alias("segment"))
    many = cut(parts.select(*_SAME).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.lit(True).alias("hot")))
    within = cut(_repeated_runs(cut(join_checked(differ, many, ["key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))), of, steps[1:]))
    whole = ["of_key", "of_ctx", "of_off", "of_windows"]
    spans = parts.select(*whole, "shift", *_SAME).join(within, _SAME).select(*whole, "shift", F.explode(F.arrays_zip("begins", "ends")).alias("r"))
    pairs = F.array_sort(F.collect_set(F.struct((F.col("shift") + F.col("r.begins")).alias("begin"), (F.col("shift") + F.col("r.ends")).alias("end"))))
    above = spans.groupBy(*whole).agg(pairs.alias("r")).select(*(F.col(x).alias(n) for x, n in zip(whole, _SAME, strict=True)), *_joined(F.col("r")))
    return found.unionByName(above)


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", of: Strings = BYTES) -> DataFrame:
    """``id, h, begins, ends``: for each text with repeats, the runs of window starts whose ``of.length`` symbols also start elsewhere.

    1. Every text is split into contexts (``contexts_of``). Equal windows have equal keys, so only keys that occur more
       than once can hold repeats; of equal contexts one is kept, with a weight.
    2. The symbols of those contexts are dealt by key and suffix-sorted; windows whose adjacent common prefixes reach
       that length are one string, repeated if their weights sum to two.
    3. A key with more than HOT different contexts is not gathered: its contexts are cut into parts, whose keys are
       hashes of longer strings, and these are sorted, so such a group spreads over all tasks.
    4. What was found for a context holds for every place where it occurs.
    """
    found = cut(_identity(in_short_batches(docs), key, text).mapInArrow(tidy_worker(_contexts(of), _forget), "id long, h long, key long, ctx long, off int, lo long, windows int"))
    # written first, so that the join below has exchanges of its own, of which Spark can split a hot key
    often = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("key"))
    places = cut(found.join(often, "key"))
    first = F.min(F.struct("id", "h", "lo")).alias("first")
    contexts = cut(places.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("weight"), first))
    hot = cut(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.lit(True).alias("hot")))
    marked = join_checked(contexts, hot, ["key"], "left")
    wanted = F.collect_list(F.struct(*_SAME, "weight", F.col("first.lo").alias("lo"), F.coalesce("hot", F.lit(False)).alias("hot")))
    by_text = cut(marked.groupBy(F.col("first.id").alias("id"), F.col("first.h").alias("h")).agg(wanted.alias("wanted")))
    texts = _identity(docs, key, text).join(by_text, ["id", "h"]).select("text", "wanted")
    fetched = cut(texts.mapInArrow(tidy_worker(_fetch(of), _forget), "key long, ctx long, off int, windows int, weight long, hot boolean, segment binary"))
    runs = cut(_repeated_runs(fetched, of, of.steps))

    spans = places.join(runs, _SAME).select("id", "h", "lo", F.explode(F.arrays_zip("begins", "ends")).alias("r"))
    pairs = F.array_sort(F.collect_set(F.struct((F.col("lo") + F.col("r.begins")).alias("begin"), (F.col("lo") + F.col("r.ends")).alias("end"))))
    # windows of contexts that follow each other are one run
    return cut(spans.groupBy("id", "h").agg(pairs.alias("r")).select("id", "h", *_joined(F.col("r"))))


def cover(begins: Iterable[int], ends: Iterable[int], of: Strings = BYTES) -> list[tuple[int, int]]:
    """The maximal runs of symbols that windows starting in the given runs cover; between words there is white space, so those that only touch stay two."""
    out: list[tuple[int, int]] = []
    for a, b in zip(begins, ends, strict=True):
        b += of.length - 1
        if out and a < out[-1][1] + (of.unit == 1):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in removed for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(docs: DataFrame, columns: dict[str, Column], *, key: str = "doc_id", text: str = "text", of: Strings = BYTES) -> DataFrame:
    """Every row of ``docs``: the given columns, its text as bytes (``_text``), and its spans (null without repeats)."""
    spans = repeated_spans(docs, key=key, text=text, of=of).withColumnsRenamed({"id": "_id", "h": "_h", "begins": "_begins", "ends": "_ends"})
    body = F.col(text).cast("binary")
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], body.alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(body).alias("_h"))
    return join_checked(rows, spans, ["_id", "_h"], "left").select(*columns, "_text", "_begins", "_ends")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, begins, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            body = text.as_py() or b""
            removed = cover(begins.as_py() or (), ends.as_py() or ())
            left = keep(body, removed) if removed else body
            rows.append((len(body), len(body) - len(left), len(removed), hashlib.sha256(left).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(of: Strings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column(0), []
            for text, begins, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                body = text.as_py()
                removed = cover(begins.as_py() or (), ends.as_py() or (), of)
                if removed and of.unit > 1:
                    first, last = _words(np.frombuffer(body, dtype=np.uint8))
                    removed = [(int(first[a]), int(last[b - 1])) for a, b in removed]
                # a character that is cut through goes whole
                texts.append(None if body is None else (keep(body, removed) if removed else body).decode("utf-8", "ignore"))
            names = [row.type.field(k).name for k in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([*(row.field(k) for k in range(len(names))), pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", of: Strings = BYTES) -> DataFrame:
    """``docs`` with all taken out of the texts that a repeated string covers, of LENGTH bytes or as ``of`` says; same columns, same rows.

    Strings are judged on the input; all places of a repeated string are taken out, in one text or many. Null texts
    stay null and match nothing, nor do texts shorter than a string. Rows with equal ids and texts repeat each other. An
    empty table gives no rows. Other columns, whatever their names, are carried along. With WORDS, words are compared whatever
    white space is between them, and the white space around a passage stays.
    """
    others = [c for c in docs.columns if c != text]
    rows = with_spans(docs, {"_row": F.struct(*others)}, key=key, text=text, of=of)
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("text", T.StringType())])
    return rows.mapInArrow(tidy_worker(_strip(of)), schema).withColumnRenamed("text", text).select(*docs.columns)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs, {"doc_id": F.col("doc_id")}).mapInArrow(tidy_worker(_digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
