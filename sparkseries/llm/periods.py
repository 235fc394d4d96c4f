"""Periodic runs of words: maximal pairs from the tree of LCP intervals of each text."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_short_batches, table, tidy_worker

#: A run is at least LEAST_LENGTH words long, and LEAST_EXPONENT times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: The two places of a maximal pair of a run have this many words in common at least: the length less the period, which is 1, or else three periods of 2 or more.
LEAST_COMMON = LEAST_LENGTH - 1
#: Words of the texts that are sorted at a time; one text is never cut.
BATCH_WORDS = 400_000

Run = tuple[int, int, int]


def suffix_order(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): the suffixes that share ``least`` words or more with another of their text, in order, and the number of words that each shares with the one before it.

    ``words`` are the numbers of the words of some texts, ``ends`` for each word the place after the end of its text. Prefixes of
    1, 2, 4, ... words get a rank each; only suffixes whose prefix occurs again in the same text are looked at further. A suffix that shares fewer words
    than ``least`` with the one before it, where the number does not matter, has a smaller number there. Memory is in proportion to the words times the
    logarithm of the longest repeat.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a prefix's rank is the first place in order of those equal to it; texts do not mix, as their ends are part of the rank
    order = np.lexsort((words, ends))
    levels: list[np.ndarray] = []
    fresh = np.ones(n, bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]) | (ends[order[1:]] != ends[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 1
    levels.append(rank)
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    at = np.flatnonzero(tied)  # places in order that are tied with a neighbour
    while len(at):
        some = order[at]
        then = some + width
        # the end of a text comes before any word
        second = np.where(then < ends[some], rank[np.minimum(then, n - 1)].astype(np.int64) + 1, 0)
        key = rank[some].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[some] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = at[tied]
    # common words of neighbours: whole prefixes of 2^k words, from the longest; before that, neighbours that differ early are left out
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    near = np.arange(n - 1)[levels[min(2, len(levels) - 1)][left] == levels[min(2, len(levels) - 1)][right]]
    a, b, got = left[near], right[near], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < ends[left[near]]) & (b < ends[right[near]])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        # ranks of prefixes that the end of a text cuts short are never equal
        step = np.where(same, 1 << k, 0)
        a, b, got = a + step, b + step, got + step
    common[near + 1] = got
    keep = common >= least
    keep[:-1] |= keep[1:]
    return order[keep], common[keep]


class _Interval:
    """Places of an LCP interval, in ascending order, in all and by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}


def _between(places: list[int], low: int, high: int) -> Sequence[int]:
    return places[bisect_left(places, low) : bisect_right(places, high)]


def _joined(one: _Interval, other: _Interval, common: int, lefts: Sequence[int], found: Callable[[int, int, int], None]) -> _Interval:
    """Both in one; ``found`` gets the maximal pairs between them, of ``common`` words, whose distance is a run's.

    Places of two children of an interval differ in the word to the right; those of two lists differ in the word to the left.
    Each place of the smaller child looks for the other's places within a third of the common words. Those that are so near are a period
    apart, and have at most two words to their left, so that it takes the fewer of near places and lists.
    """
    small, large = (one, other) if len(one.all) < len(other.all) else (other, one)
    reach = common // (LEAST_EXPONENT - 1)
    for i in small.all:
        first, last = bisect_left(large.all, i - reach), bisect_right(large.all, i + reach)
        if first < last:
            left = lefts[i]
            if last - first <= len(large.by_left):
                partners = [j for j in large.all[first:last] if lefts[j] != left]
            else:
                partners = [j for word, places in large.by_left.items() if word != left for j in _between(places, i - reach, i + reach)]
            for j in partners:
                found(min(i, j), abs(i - j), common)
    for i in small.all:
        insort(large.all, i)
    for word, places in small.by_left.items():
        if (have := large.by_left.get(word)) is None:
            large.by_left[word] = places
        else:
            for i in places:
                insort(have, i)
    return large


def maximal_pairs(places: Sequence[int], common: Sequence[int], lefts: Sequence[int], found: Callable[[int, int, int], None]) -> None:
    """Calls ``found(i, distance, length)`` for the maximal pairs of words from i and from i + distance whose distance is at most a third of their length.

    The intervals of suffixes that share ``LEAST_COMMON`` words or more are visited bottom-up; each keeps its places by the word to their left.
    """
    if not len(places):
        return
    stack: list[tuple[int, _Interval]] = []
    current = _Interval(places[0], lefts[places[0]])
    for k in range(1, len(places) + 1):
        h = common[k] if k < len(places) else 0
        while stack and stack[-1][0] > h:
            level, before = stack.pop()
            current = _joined(before, current, level, lefts, found)
        if h >= LEAST_COMMON:
            if stack and stack[-1][0] == h:
                stack[-1] = (h, _joined(stack[-1][1], current, h, lefts, found))
            else:
                stack.append((h, current))
        if k < len(places):
            current = _Interval(places[k], lefts[places[k]])


def runs_of(texts: Sequence[np.ndarray]) -> list[list[Run]]:
    """Of each text, given as the numbers of its words, the runs (start, length, period), by start, then period.

    A run is a stretch of words whose smallest period p is at most a LEAST_EXPONENT-th of its length, which is LEAST_LENGTH at least, and
    that no neighbouring word extends with that period. Its words, and its words p further on, are a maximal pair of length less p
    words; a maximal pair whose distance is at most a third of its words is such a stretch of the period of its distance. That is the smallest period
    of the stretch or a multiple, as both are maximal for the same stretch, so the smallest distance for a stretch is taken.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    ends = np.repeat(begins[1:], sizes)
    out: list[list[Run]] = [[] for _ in texts]
    places, common = suffix_order(words, ends, LEAST_COMMON)
    lefts = np.empty(len(words), np.int64)
    lefts[1:] = words[:-1]
    lefts[begins[:-1][sizes > 0]] = -1
    periods: dict[tuple[int, int], int] = {}

    def found(i: int, distance: int, length: int) -> None:
        if distance + length >= LEAST_LENGTH and length >= (LEAST_EXPONENT - 1) * distance:
            stretch = (i, distance + length)
            periods[stretch] = min(distance, periods.get(stretch, distance))

    maximal_pairs(places.tolist(), common.tolist(), lefts.tolist(), found)
    if periods:
        starts = np.array([i for i, _ in periods], np.int64)
        for t, ((i, length), period) in zip((np.searchsorted(begins, starts, side="right") - 1).tolist(), periods.items(), strict=True):
            out[t].append((int(i - begins[t]), int(length), int(period)))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def with_period(words: list[bytes], key: str | None) -> list[bytes]:
    """The words, of which those of one key in ten go on periodically from some place; a key names place and period by its checksum."""
    n = len(words)
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


SCHEMA = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _told(words: list[bytes], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    collapsed = hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()
    return (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed, collapsed)


def _numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def find_runs(batches: Iterator[tuple[list, list]], change: Callable[[list[bytes], str | None], list[bytes]] | None = None) -> Iterator[tuple[list, list[tuple]]]:
    """For batches of keys and texts the keys with (words, runs); texts of about BATCH_WORDS words are sorted together."""

    def done(keys: list, held: list[list[bytes]]) -> tuple[list, list[tuple]]:
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        runs = runs_of([_numbered(words, numbers) for words in held])
        return keys, list(zip(held, runs, strict=True))

    keys: list = []
    held: list[list[bytes]] = []
    size = 0
    for some_keys, texts in batches:
        for key, text in zip(some_keys, texts, strict=True):
            # bytes split at blank, tab, LF, VT, FF and CR, and nothing else
            words = (text or "").encode().split()
            if change:
                words = change(words, None if key is None else str(key))
            if size + len(words) > BATCH_WORDS and held:
                yield done(keys, held)
                keys, held, size = [], [], 0
            keys.append(key)
            held.append(words)
            size += len(words)
    if held:
        yield done(keys, held)


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", change: Callable[[list[bytes], str | None], list[bytes]] | None = None) -> DataFrame:
    """``<key>, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed``: the periodic runs of words of every whole text.

    ``runs`` lists (start, length, period) by start, then period; the columns before are those of the longest run (ties: smallest start, then period; null without a run).
    ``collapsed`` is the text without the words that a run contains after its first period, its words joined by one blank. Words are runs of
    bytes other than blank, tab, LF, VT, FF and CR. ``change`` may change the words of a row first (by the key as text).

    Each row is worked on alone, so nothing is shuffled; time is in proportion to the words times the logarithm of the longest repeat, and a worker
    holds about BATCH_WORDS words, or one text, at a time. A null or empty text has no words and no runs. Repeated rows give equal rows. An
    empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def columns() -> Iterator[tuple[list, list]]:
            nonlocal kinds
            for b in batches:
                kinds = b.schema.field(0).type
                yield b.column(0).to_pylist(), b.column(1).to_pylist()

        for keys, found in find_runs(columns(), change):
            told = list(zip(*(_told(words, runs) for words, runs in found), strict=True))
            columns_out = [pa.array(list(c), f.type) for c, f in zip(told, SCHEMA, strict=True)]
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            collapsed = pa.array([b" ".join(kept_words(words, r)).decode() for words, r in found], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds), *columns_out, runs, collapsed], names=["_key", *SCHEMA.names, "runs", "collapsed"])

    schema = f"_key {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_short_batches(docs.select(key, text)).mapInArrow(tidy_worker(of_batches), schema).withColumnRenamed("_key", key)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), change=with_period).drop("runs", "collapsed")


#: Words from 5 on that are equal at one distance are stretches; a run's stretch is the length less the period.
OP13_SQL = r"""
WITH RECURSIVE t(i, c, s) AS (
  SELECT i, i, 0 FROM range(256) x(i)
  UNION ALL
  SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)::BIGINT, s + 1 FROM t WHERE s < 8),
steps AS (SELECT list(c ORDER BY i) AS crc FROM t WHERE s = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: xor(a >> 8, crc[xor(a, b) % 256 + 1]))) END::BIGINT AS h
  FROM d, steps),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
c AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
words AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS word FROM c),
five AS (
  SELECT r, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS k,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM words),
pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.r = y.r AND x.k = y.k AND y.i > x.i WHERE x.m = 5 AND y.m = 5),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + 4 >= 3 * q),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
ordered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS rn FROM runs),
told AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) x),
kept AS (
  SELECT words.r, sha256(string_agg(word, ' ' ORDER BY words.i)) AS collapsed
  FROM words ANTI JOIN gone ON words.r = gone.r AND words.i = gone.i GROUP BY words.r)
SELECT c.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, coalesce(listed, sha256('')) AS runs_sha256, coalesce(collapsed, sha256('')) AS collapsed_sha256
FROM c LEFT JOIN told ON c.r = told.r LEFT JOIN ordered ON c.r = ordered.r AND rn = 1 LEFT JOIN kept ON c.r = kept.r
"""
