"""Line dedup, hard negatives and periodic runs against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import lines, negatives, periods

from .conftest import SCHEMA

# --- common lines ---


def key_of(line: str) -> str:
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute_lines(rows: list[tuple], least_chars: int, least_docs: int) -> list[tuple]:
    """(id, kept text, lines, dropped) of (id, text)."""
    held = defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                held[key_of(line)].add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(held.get(key_of(x), ())) >= least_docs and rank(i) < max(map(rank, held[key_of(x)])))]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def line_rows() -> list[tuple]:
    rng = random.Random(3)
    common = [f"shared line number {k} of the corpus, with ünïcode {'x' * k}" for k in range(6)]
    rows: list[tuple] = []
    for i in range(60):
        parts = [common[0]] * (i % 3 == 0)  # a third of all rows
        for c in common[1:]:
            if rng.random() < 0.15:
                parts.append(rng.choice(["", " ", "\t", "\x0c"]) + (c.upper() if rng.random() < 0.3 else c) + rng.choice(["", "\r", "  "]))
        parts += [f"own line {i} {k} " + "y" * rng.randrange(60) for k in range(rng.randrange(4))]
        parts += ["", "short"] * (i % 2)
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, common[1] + "\n" + common[1] + "\n"), (104, "\n".join(common)), (None, common[2] + "\nanother"), (None, common[0]), (5, common[3] + "\nsecond row of an id"), rows[9], rows[9]]
    rows += [(200 + k, "é" * 39 + "\n" + "É" * 40 + "\n " + "z" * 39) for k in range(6)]
    rows.append((300, "\n".join([common[0], "w" * 50] * 3000)))
    return rows


@pytest.mark.parametrize("least_docs", [2, 5])
def test_common_lines(spark, least_docs):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name in ("_lines", "_gone", "_n_lines", "_id", "_t", "_hash", "lang"):
        df = df.withColumn(name, F.lit("clash"))
    out = lines.drop_common_lines(df, least_docs=least_docs)
    assert [c for c in out.columns if c not in ("_n_lines", "_n_dropped")] == [c for c in df.columns if c != "_n_lines"]
    got = sorted(((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in out.collect()), key=str)
    assert got == brute_lines(rows, 40, least_docs)
    assert sum(r[3] for r in got) > 20


def test_common_lines_by_shuffle(spark, monkeypatch):
    from sparkseries.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = line_rows()
    out = lines.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in out.collect()), key=str) == brute_lines(rows, 40, 5)


def test_common_lines_of_text_ids_and_no_rows(spark):
    rows = [(f"d{i}", "the very same line, which is longer than forty characters\nown") for i in range(7)]
    out = {r.doc_id: r.text for r in lines.drop_common_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {f"d{i}": "own" for i in range(6)} | {"d6": rows[6][1]}
    assert lines.drop_common_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_lines_without_python(spark, docs):
    plan = lines.drop_common_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- hard negatives ---


def brute_negatives(rows: list[tuple], anchors, n_positives=5, n_negatives=3, low=50, high=95) -> list[tuple]:
    one: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = (label, [int(np.floor(256.0 * float(x))) for x in v])
        one[i] = min(one.get(i, x), x)
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in filter(anchors, one):
        label, v = one[a]
        scored = sorted((-product(v, w), i, k) for i, (k, w) in one.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:n_positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out += [(a, i, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(n: int, d: int = 6) -> list[tuple]:
    rng = random.Random(11)
    centers = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in centers[rng.randrange(4)]], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0, None] * (d // 2), 1), (n + 3, [float("nan")] * d, 1), (n + 4, [float("inf")] * d, 1), (None, rows[0][1], 0), (n + 5, rows[1][1], None)]
    rows += [(n + 6, rows[2][1], rows[2][2]), (n + 7, rows[2][1], 3), rows[5], (5, rows[6][1], 9), (n + 8, [], 0), (n + 9, rows[3][1][:3], 1), (n + 10, [0.0] * d, 2)]
    return rows


@pytest.mark.parametrize("block_rows,chunk_rows", [(8192, 1024), (7, 3)])
def test_hard_negatives(spark, block_rows, chunk_rows):
    rows = vectors(150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for name in ("id", "v", "block", "chunk", "rank", "is_anchor"):
        df = df.withColumn(name, F.lit("clash"))
    out = negatives.hard_negatives(df, F.col("id") % 5 == 0, block_rows=block_rows, chunk_rows=chunk_rows)
    got = sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert got == want and len(got) > 100


def test_hard_negatives_of_other_numbers(spark):
    rows = vectors(60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = negatives.hard_negatives(df, F.col("id") % 7 == 0, n_positives=2, n_negatives=9, low=10, high=100, block_rows=11)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect()) == brute_negatives(rows, lambda i: i % 7 == 0, 2, 9, 10, 100)


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], schema), F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="fit a long"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e12], 1)], schema), F.col("id") % 50 == 0)


@pytest.mark.parametrize("most,d", [(1, 1), (300, 64), (40_000, 64), (2**27, 8)])
def test_packed_products(most, d):
    rng = np.random.default_rng(most)
    bits = negatives.field_bits(d, most)
    found = rng.integers(-most, most + 1, (37, d))
    found[0], found[1] = most, -most
    packed = [int.from_bytes(p, "little") for p in negatives.pack(found, most, bits)]
    for anchor in (*rng.integers(-most, most + 1, (9, d)), np.full(d, most), np.full(d, -most), np.zeros(d, int)):
        got = negatives.unpack(packed, anchor.tolist(), most, most, 37, bits)
        assert got.tolist() == [sum(map(int, row * anchor)) for row in found]


# --- periodic runs ---


def brute_runs(w: list) -> list[tuple]:
    found: dict[tuple, int] = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(2)
    total = 0
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 9)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 9])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a, p = rng.randrange(n), rng.randint(1, 9)
                w = w[:a] + (w[a : a + p] * 99)[: n - a]
            texts.append(w)
        got = periods.runs_of([np.array(w, np.int64) for w in texts])
        assert got == [brute_runs(w) for w in texts]
        total += sum(map(len, got))
    assert total > 500


def test_runs_of_long_texts():
    assert periods.runs_of([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    block = [1, 2, 3, 4, 5, 6, 7] * 30 + list(range(100, 120))
    (found,) = periods.runs_of([np.array(block * 200)])
    assert (0, 230 * 200, 230) in found and len(found) == 201
    # five equal words between words that differ, thousands of times
    assert periods.runs_of([np.array(sum(([9] * 5 + [1000 + i] for i in range(5000)), []))]) == [[]]


def test_runs_of_rows(spark, docs, rows):
    extra = [(900, "a b a b a b a b end", None, None, None), (901, "x " * 50, None, None, None), (None, "x " * 7, None, None, None), (901, "x " * 50, None, None, None)]
    some = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "rank", "key").unionByName(spark.createDataFrame(extra, SCHEMA), allowMissingColumns=True)
    got = periods.periodic_runs(some, change=periods.with_period).collect()
    want = []
    for i, text, *_ in rows + extra:
        words = periods.with_period((text or "").encode().split(), None if i is None else str(i))
        runs = brute_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left.decode()))
    assert sorted((tuple(r)[:8] + (r.collapsed,) for r in got), key=str) == sorted(want, key=str)
    assert sum(n > 0 for _, n, *_ in want) > 5


def test_changed_words():
    import zlib

    words = [b"%d" % i for i in range(50)]
    changed = 0
    for i in range(100):
        h = zlib.crc32(str(i).encode())
        got = periods.with_period(words, str(i))
        if h % 10:
            assert got == words
            continue
        g = h // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert got == [words[k] if k < a else words[a + (k - a) % p] for k in range(50)]
        changed += 1
    assert changed > 3 and periods.with_period([], "0") == [] and periods.with_period(words, None) == words


def test_runs_of_no_rows(spark, none):
    assert periods.periodic_runs(none).count() == 0
    assert periods.periodic_runs(spark.createDataFrame([("a", None)], "doc_id string, text string")).collect()[0].n_runs == 0
