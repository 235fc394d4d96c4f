"""MinHash near-duplicates by an inverted join on signature coordinates, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_short_batches, join_checked, table, tidy_worker

#: Coordinates of a signature, and how many must agree. At similarity 0.75 a coordinate agrees with probability 0.75; fewer than
#: 32 of 64 do so with probability 2e-6.
COORDINATES, MATCHES = 64, 32
#: Words of a shingle; a link needs SHARE_OF times the intersection to be at least SHARE times the union.
WORDS, SHARE, SHARE_OF = 5, 75, 100
#: Members of a posting list that meet in one cell; bits of what is known there of a set; rows of whole cells, and pairs, that are held at a time.
BLOCK_ROWS, SKETCH_BITS, HELD_ROWS, HELD_PAIRS = 512, 2048, 4096, 300_000
#: About so many bytes of text are shingled at a time.
CHUNK_BYTES = 500_000

_BASE, _STEP = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_random = np.random.Generator(np.random.PCG64(20240601))
_FACTORS = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[str, np.ndarray] = {}


def _forget() -> None:
    _powers.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 200_000)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, b in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, for texts of together about CHUNK_BYTES (or one longer one)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = _powers_upto(len(data) + 1)
    is_word = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(is_word.astype(np.int8), prepend=np.int8(0)))
    begins, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _STEP)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(begins, starts)  # of each text, its first word
    n = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        rolled = rolled * _STEP + words[k : k + n]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = (short * _STEP + w) & np.uint64(2**64 - 1)
            out.append(_mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate the high half of the least value of its permutation."""
    least = None
    for k in range(0, len(hashes), 8192):
        part = (hashes[None, k : k + 8192] * _FACTORS[:, None] + _ADDENDS[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of a batch's texts, a chunk at a time."""
    with np.errstate(over="ignore"):
        for batch in batches:
            texts, at, size = [], 0, 0
            column = batch.column(1).cast(pa.large_binary())
            for k in range(len(batch)):
                texts.append(column[k].as_py() or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES or k == len(batch) - 1:
                    yield batch.column(0).slice(at, len(texts)), shingle_sets(texts)
                    texts, at, size = [], k + 1, 0


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for ids, sets in _chunks(batches):
            sums = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            mixed = [int(np.bitwise_xor.reduce(_mix(s ^ _STEP)).view(np.int64)) if len(s) else 0 for s in sets]
            signatures = [signature(s) if len(s) else None for s in sets]
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(sums, pa.int64()), pa.array(mixed, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "sig"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _chunks(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of a link (columns ``u, v``) with the smallest node that links lead to.

    Alternates large stars (each larger neighbour is linked to the least of the neighbourhood) and small stars (each
    smaller one is) until nothing changes; a hub's neighbours are never gathered. The least neighbours are written before they are joined,
    so that the join is by broadcast, or has exchanges of its own of which Spark can split a hub.
    """

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        of = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = cut(of.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        near = join_checked(of, least, ["u"])
        if large:
            out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return cut(out.filter(F.col("u") != F.col("v")).distinct())

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, mark(edges)
    while before != now:
        edges = stars(stars(edges, True), False)
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def posting_lists(nodes: DataFrame) -> DataFrame:
    """``key, node, weight``: nodes under the coordinate-value pairs of their prefixes.

    In the order of how many nodes share them, a node's rarest COORDINATES - MATCHES + 1 pairs are its prefix: two
    nodes that agree in MATCHES coordinates share a pair of their prefixes. Pairs of one node alone fill
    its prefix but are not posted. ``weight`` counts the node's shared pairs.
    """
    coordinates = nodes.select("node", F.posexplode("sig").alias("k", "value"))
    pairs = coordinates.select("node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    of_node = pairs.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ordered"))
    taken = COORDINATES - MATCHES + 1 - (COORDINATES - F.size("ordered"))
    prefixes = of_node.filter(taken > 0).select("node", F.size("ordered").alias("weight"), F.explode(F.slice("ordered", F.lit(1), taken)).alias("x"))
    return prefixes.select(F.col("x.key").alias("key"), "node", "weight")


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a byte of every coordinate, and which of SKETCH_BITS numbers its shingles fall on."""
    with np.errstate(over="ignore"):
        for ids, sets in _chunks(batches):
            lows, bits = [], []
            for s in sets:
                lows.append((signature(s) & 255).astype(np.uint8).tobytes() if len(s) else b"")
                flags = np.zeros(SKETCH_BITS, dtype=bool)
                flags[(s % np.uint64(SKETCH_BITS)).astype(np.int64)] = True
                bits.append(np.packbits(flags).tobytes())
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(lows, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "low", "bits"])


def colliding(cell: np.ndarray, probe: np.ndarray, member: np.ndarray, root: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (probe, member) of rows of one cell and different roots whose ``low`` agree in MATCHES columns at least.

    The members of each cell are posted under their coordinate-value pairs. Of a probe's lists the shortest, as many
    as one more than may miss, are merged: a member that is on none of them cannot match often enough. The
    longer lists are then gone through from the shortest up, each only for members found before, and a member is left
    as soon as all lists to come could not bring it to MATCHES.
    """
    width = low.shape[1]
    merged = width - MATCHES + 1
    rows = np.flatnonzero(member)
    pair = np.arange(width) * 256 + low  # a coordinate and its value, of each row
    code = cell[:, None] * (width * 256) + pair
    posted = code[rows].ravel()
    order = np.argsort(posted, kind="stable")
    posted = posted[order]
    probes = np.flatnonzero(probe)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    first = np.searchsorted(posted, code[probes].ravel(), "left").reshape(-1, width)
    sizes = np.searchsorted(posted, code[probes].ravel(), "right").reshape(-1, width) - first
    by_size = np.argsort(sizes, axis=1, kind="stable")
    short = by_size[:, :merged]
    first, sizes = np.take_along_axis(first, short, 1), np.take_along_axis(sizes, short, 1)
    upto = np.cumsum(sizes.sum(axis=1))
    a = 0
    while a < len(probes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD_PAIRS, "right")))
        n, begin = sizes[a:b].ravel(), first[a:b].ravel()
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        p = np.repeat(np.repeat(np.arange(a, b), merged), n)
        both, count = np.unique(p * len(rows) + order[at] // width, return_counts=True)
        p, m = both // len(rows), rows[both % len(rows)]
        differ = root[probes[p]] != root[m]
        p, m, count = p[differ], m[differ], count[differ]
        for k in range(merged, width):
            stays = count + (width - k) >= MATCHES
            p, m, count = p[stays], m[stays], count[stays]
            column = by_size[p, k]
            count = count + (low[probes[p], column] == low[m, column])
        out.append((probes[p[count >= MATCHES]], m[count >= MATCHES]))
        a = b
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (probes, probes)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells in order to the pairs of their nodes that may be links and are not yet connected.

    Bytes of coordinates agree at least as often as coordinates. A number that only one of two sets falls on is a shingle
    that the other lacks, which bounds the intersection; no link is lost by either test but for the one in a
    million that MATCHES loses.
    """
    cell = ["key", "i", "j"]

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(rows["low"]), dtype=np.uint8).reshape(len(rows), -1).astype(np.int64)
        bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), -1)
        side, n, node = rows["side"].to_numpy(), rows["n"].to_numpy(), rows["node"].to_numpy()
        number = np.cumsum((rows[cell] != rows[cell].shift()).any(axis=1).to_numpy()) - 1
        p, m = colliding(number, side != 1, side != 0, rows["root"].to_numpy(), low)
        most = np.minimum(n[p] - np.bitwise_count(bits[p] & ~bits[m]).sum(axis=1, dtype=np.int64), n[m] - np.bitwise_count(bits[m] & ~bits[p]).sum(axis=1, dtype=np.int64))
        likely = SHARE_OF * most >= SHARE * (n[p] + n[m] - most)
        u, v = node[p[likely]], node[m[likely]]
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).drop_duplicates()

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        while len(batch):
            # whole cells, about HELD_ROWS rows together
            last = held[-1][cell].iloc[-1] if held else None
            new = (batch[cell] != batch[cell].shift()).any(axis=1).to_numpy().copy()
            new[0] = last is not None and bool((batch[cell].iloc[0] != last).any())
            ends = np.flatnonzero(new)
            ends = ends[ends + size >= HELD_ROWS]
            if not len(ends):
                held.append(batch)
                size += len(batch)
                break
            held.append(batch[: ends[0]])
            yield done(pd.concat(held))
            held, size, batch = [], 0, batch[ends[0] :]
    if size:
        yield done(pd.concat(held))


def cells(labelled: DataFrame) -> DataFrame:
    """``key, i, j, side, node, root``: the cells in which nodes of different components meet, of lists (``key, node, root``) that hold several.

    The nodes of a list's largest component do not meet each other: their blocks (i below 0) meet the blocks of the others
    (j from 0), and these meet one another. ``side`` is 0 and 1 for the two blocks, 2 where a block meets itself. A list of two
    nodes is a star that has been tried.
    """
    in_list = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(in_list.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("roots")).filter((F.col("members") > 2) & (F.col("roots") > 1)))
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    left = labelled.join(mixed.select("key", "main", blocks(F.col("most")).alias("of_main"), blocks(F.col("members") - F.col("most")).alias("of_rest")), "key")
    is_main = F.col("root") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("of_main")).otherwise(F.col("of_rest"))).cast("int")
    left = left.withColumn("block", F.when(is_main, -1 - block).otherwise(block))
    met = left.withColumn("other", F.explode(F.sequence(F.when(is_main, F.lit(0)).otherwise(-F.col("of_main")), F.col("of_rest") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    return met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "node", "root")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    1. Every text gives its number of distinct shingles, two hashes of the set, and a signature. Equal sets are one node.
    2. Nodes are posted under the pairs of their prefixes. Each list's most shared node is compared with the
       others: those that agree in MATCHES coordinates are confirmed on the full sets and linked.
    3. Lists that are then still in several components: collisions of nodes of different components are counted by merging
       the posting lists of their coordinates (``colliding``), block by block; pairs that collide often enough and can be links by their
       sketches are confirmed. Nodes of one component do not meet, so copies of one text never form all their pairs.
    4. Components are the stars that the links lead to.

    Null and wordless texts have an empty set and are linked with nothing; fewer than five words are one shingle. Rows
    with equal keys are one vertex. A null key takes no part: its component is null and ``kept`` false. An
    empty table gives no rows. Other columns are ignored.
    """
    body = F.col(text).cast("binary")
    base = cut(in_short_batches(docs).select(F.col(key).cast("long").alias("doc_id"), body.alias("text")).mapInArrow(tidy_worker(_signatures, _forget), "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"))
    same = ["n_shingles", "s1", "s2"]
    nodes = cut(base.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*same).agg(F.min("doc_id").alias("node"), F.max("sig").alias("sig")))
    lists = cut(posting_lists(nodes))

    # 2: stars
    centers = lists.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("center"), F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    stars = lists.join(centers, "key").filter(F.col("node") != F.col("center")).select("node", "center").distinct()
    sigs = nodes.select("node", "sig")
    stars = stars.join(sigs, "node").join(sigs.select(F.col("node").alias("center"), F.col("sig").alias("sig2")), "center")
    agree = F.size(F.filter(F.arrays_zip("sig", "sig2"), lambda x: x["sig"] == x["sig2"]))
    stars = cut(stars.filter(agree >= MATCHES).select(F.col("node").alias("u"), F.col("center").alias("v")))
    links = confirm(docs, stars, key, text)
    # sets of one key are one vertex
    placed = cut(base.select("doc_id", *same).join(nodes.select(*same, "node"), same, "left"))
    several = placed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter(F.col("v") < F.col("last"))
    links = cut(links.unionByName(placed.join(cut(several.select("doc_id", "v")), "doc_id").filter(F.col("node") > F.col("v")).select(F.col("node").alias("u"), "v")))
    roots = cut(components(links))

    # 3: what is left between components
    met = cut(cells(lists.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))))
    sketches = cut(texts_of(docs, met.select("node").distinct(), key, text).mapInArrow(tidy_worker(_sketches, _forget), "node long, n long, low binary, bits binary"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(met.count() / (4 * HELD_ROWS)))
    pairs = met.join(sketches, "node").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(tidy_worker(_meet), "u long, v long").distinct()
    tried = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"))
    if not pairs.isEmpty():
        links = links.unionByName(confirm(docs, pairs, key, text))
        roots = cut(components(links))

    out = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def texts_of(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """``node, text`` of these nodes."""
    return join_checked(docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("binary").alias("text")), cut(nodes), ["node"], "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs ``u, v`` whose full shingle sets are similar enough; a pair may come twice where rows share a key.

    No step after the joins asks for rows in place by ``v``, so that Spark can split a hub.
    """
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = cut(texts_of(docs, needed, key, text).mapInArrow(tidy_worker(_sets, _forget), "node long, shingles array<long>"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(SHARE_OF * shared >= SHARE * (F.size("a") + F.size("b") - shared)).select("u", "v")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d),
t AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN t ON t.d = n.doc_id
"""
