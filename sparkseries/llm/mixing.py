"""Temperature mixing of sources to target weights, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_checked, table

SEED = "mix"
#: Production parameters: entropy as a share of that of equal weights, passes over a source, mix blocks.
ENTROPY_SHARE, MAX_REPEATS, MIX_BLOCKS = 0.95, 4.0, 64
#: Halvings of the exponent's interval, and how many of them one aggregate decides.
STEPS, BITS = 50, 5


def token_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def order_key(epoch: Column, key: str) -> Column:
    """16 hexadecimal digits that shuffle the documents of a pass."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 16)


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a the sums over sources of p^a and of p^a ln p, in one aggregate."""
    p = F.col("share")
    row = shares.agg(*[f.alias(f"{n}{k}") for k, a in enumerate(exponents) for n, f in (("z", F.sum(F.pow(p, F.lit(a)))), ("l", F.sum(F.pow(p, F.lit(a)) * F.ln(p))))]).first()
    return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]


def _narrow(shares: DataFrame, lo: float, hi: float, up: Callable[[float, float, float], bool]) -> tuple[float, float]:
    """(lo, hi) after ``STEPS`` halvings; lo moves to the middle where ``up(middle, its sums)`` holds, else hi does. Each aggregate has the middles of BITS halvings."""
    for _ in range(STEPS // BITS):
        n = 1 << BITS
        grid = [lo + (hi - lo) * k / n for k in range(1, n)]
        holds = [up(a, z, l) for a, (z, l) in zip(grid, _sums(shares, grid), strict=True)]
        left, right = 0, n
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (middle, right) if holds[middle - 1] else (left, middle)
        points = [lo, *grid, hi]
        lo, hi = points[left], points[right]
    return lo, hi


def source_quotas(tokens: DataFrame, *, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget_share: float = 1.0) -> DataFrame:
    """One row per source with tokens: ``source, tokens, share, exponent, weight, quota``.

    ``tokens`` has ``source, tokens``, and is read several times. Weights are the sources' token shares raised to an exponent from
    0 to 1 and normalised. The exponent is the largest at which their entropy reaches ``entropy_share``
    of that of equal weights; if a source would then be read more than ``max_repeats`` times, the
    smallest larger one at which none is. The quota is the weight's part of ``budget_share`` times all tokens.

    Sources stay rows, however many: entropy and repeats follow from two sums over them, and the driver has these sums for a grid of exponents only.
    """
    some = tokens.filter(F.col("tokens") > 0)
    first = some.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least")).first()
    shares = some.withColumn("share", F.col("tokens") / F.lit(first["total"]).cast("double"))
    if not first["n"]:
        return shares.withColumns({"exponent": F.lit(1.0), "weight": F.lit(1.0), "quota": F.lit(0).cast("long")})
    target, least = entropy_share * math.log(first["n"]), first["least"] / first["total"]
    enough = lambda a, z, l: math.log(z) - a * l / z >= target
    # the smallest source is repeated most
    repeats = lambda a, z: least ** (a - 1) / z * budget_share
    exponent = 1.0 if enough(1.0, *_sums(shares, [1.0])[0]) else _narrow(shares, 0.0, 1.0, enough)[0]
    z = _sums(shares, [exponent])[0][0]
    if repeats(exponent, z) > max_repeats:
        exponent = _narrow(shares, exponent, 1.0, lambda a, z, _: repeats(a, z) > max_repeats)[1]
        z = _sums(shares, [exponent])[0][0]
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    quota = F.floor(weight * F.lit(budget_share) * F.lit(first["total"])).cast("long")
    return shares.select("source", "tokens", "share", F.lit(exponent).alias("exponent"), weight.alias("weight"), quota.alias("quota"))


def mix_plan(counted: DataFrame, key: str, source: str, blocks: int = 4096, **quota_options) -> DataFrame:
    """One row per source: ``_source, passes, last, ratio``: whole passes, and the last order key of the partial pass ('' for none).

    ``counted`` has the key, the source and ``n_tokens`` and is read three times. A pass is a permutation
    of the source by a hash of pass and key, held as ``blocks`` runs of hash values. Prefix sums over
    the runs' tokens find the run in which the quota ends; only that run is ordered by document.
    """
    held = counted.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), "n_tokens")
    sums = cut(held.groupBy(F.col("_source").alias("source")).agg(F.sum("n_tokens").alias("tokens")))
    quotas = cut(source_quotas(sums, **quota_options).select(F.col("source").alias("_source"), "tokens", "quota"))
    quotas = quotas.withColumn("passes", F.expr("quota div tokens")).withColumn("rest", F.col("quota") % F.col("tokens")).withColumn("ratio", F.col("quota") / F.col("tokens"))
    keyed = join_checked(held, quotas.select("_source", "passes", "rest"), ["_source"]).withColumn("_h", order_key(F.col("passes"), "_key"))
    keyed = keyed.withColumn("_block", F.pmod(F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"), F.lit(4096)) * blocks / 4096).withColumn("_block", F.col("_block").cast("int"))
    by_block = keyed.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("n"), F.max("_h").alias("top"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("_source").orderBy("_block"))
    by_block = cut(by_block.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")))
    whole = by_block.filter(F.col("upto") <= F.col("rest")).groupBy("_source").agg(F.max("top").alias("last"))
    edge = by_block.filter((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select("_source", "_block", "before")
    inside = join_checked(keyed, edge, ["_source", "_block"]).groupBy("_source", "_block", "_h", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    running = F.col("before") + F.sum("n").over(Window.partitionBy("_source", "_block").orderBy("_h"))
    inside = inside.withColumn("upto", running).filter(F.col("upto") <= F.col("rest")).groupBy("_source").agg(F.max("_h").alias("last"))
    last = whole.unionByName(inside).groupBy("_source").agg(F.max("last").alias("last"))
    return cut(quotas.join(last, ["_source"], "left").select("_source", "passes", F.coalesce("last", F.lit("")).alias("last"), "ratio"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", mix_blocks: int = MIX_BLOCKS, **quota_options) -> DataFrame:
    """``docs`` with each row repeated for every pass that takes it, and ``_epoch, _mix_block, _order_key, _n_tokens`` added.

    A source whose quota is r times its tokens is read in floor(r) whole passes and one partial pass that
    stops at the last document with which the pass is still within the quota. Reading the rows by
    ``_mix_block, _order_key`` gives ``mix_blocks`` blocks, each with the target weights.

    Null sources, and the source with an empty name, are one source; null or wordless texts cost nothing, follow their source, and are read
    once where the source has no tokens at all. Repeated rows share an order key and are taken
    together. An empty table gives no rows. Other columns are
    carried along, but for those named like an added one.
    """
    counted = cut(docs.select(F.col(key), F.col(source), token_count(text).alias("n_tokens")))
    plan = mix_plan(counted, key, source, **quota_options)
    # the row as one column, so that none of its columns clashes with those of the plan
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), token_count(text).alias("_n_tokens"))
    rows = join_checked(rows, plan, ["_source"], "left")
    rows = rows.withColumn("passes", F.coalesce("passes", F.lit(1).cast("long"))).withColumn("last", F.coalesce("last", F.lit(""))).withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("_order_key", order_key(F.col("_epoch"), "_key"))
    rows = rows.filter((F.col("_epoch") < F.col("passes")) | (F.col("_order_key") <= F.col("last")))
    at = (F.col("_epoch") + F.conv(F.substring("_order_key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12))) / F.col("ratio")
    added = {"_epoch": F.col("_epoch").cast("int"), "_mix_block": F.least(F.lit(mix_blocks - 1), F.floor(at * mix_blocks).cast("int")), "_order_key": F.col("_order_key"), "_n_tokens": F.col("_n_tokens")}
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_mix_block").alias("mix_block"), F.col("_order_key").alias("order_key"), F.col("_n_tokens").alias("n_tokens"))


_POW = "list_transform(list_transform(shares, lambda p: pow(p, {a})), lambda x: x / list_sum(list_transform(shares, lambda p: pow(p, {a}))))"
_ENTROPY = f"list_sum(list_transform({_POW}, lambda w: -w * ln(w)))"

OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
src AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY s HAVING sum(n_tokens) > 0),
one AS (SELECT list(tokens::DOUBLE / total ORDER BY s) AS shares, list(s ORDER BY s) AS names,
               {ENTROPY_SHARE}::DOUBLE * ln(count(*)::DOUBLE) AS target
        FROM src, (SELECT sum(tokens)::BIGINT AS total FROM src) t),
e(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h >= target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= target THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT e.*, target, {_ENTROPY.format(a="((lo + hi) / 2)")} AS h FROM e, one WHERE i < {STEPS}) x),
by_entropy AS (
  SELECT CASE WHEN {_ENTROPY.format(a="1.0::DOUBLE")} >= target THEN 1.0::DOUBLE ELSE lo END AS a0, shares FROM one, (SELECT lo FROM e WHERE i = {STEPS}) z),
r(i, lo, hi) AS (
  SELECT 0, a0, 1.0::DOUBLE FROM by_entropy
  UNION ALL
  SELECT i + 1, CASE WHEN m > {MAX_REPEATS} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m > {MAX_REPEATS} THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT r.*, list_max(list_transform(list_zip({_POW.format(a="((lo + hi) / 2)")}, shares), lambda z: z[1] / z[2])) AS m FROM r, one WHERE i < {STEPS}) x),
chosen AS (
  SELECT CASE WHEN list_max(list_transform(list_zip({_POW.format(a="a0")}, shares), lambda z: z[1] / z[2])) <= {MAX_REPEATS} THEN a0 ELSE hi END AS a
  FROM by_entropy, (SELECT hi FROM r WHERE i = {STEPS}) z),
w AS (SELECT unnest(names) AS s, unnest({_POW.format(a="a")}) AS weight FROM one, chosen),
q AS (SELECT src.s, tokens, floor(weight * 1.0::DOUBLE * total)::BIGINT AS quota
      FROM src JOIN w ON src.s = w.s, (SELECT sum(tokens)::BIGINT AS total FROM src) t),
p AS (SELECT s, tokens, quota // tokens AS passes, quota % tokens AS rest, quota::DOUBLE / tokens AS ratio FROM q),
k AS (SELECT d.*, coalesce(passes, 1) AS passes, coalesce(rest, -1) AS rest, coalesce(ratio, 1.0) AS ratio FROM d LEFT JOIN p ON d.s = p.s),
x AS (SELECT *, substr(md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS order_key
      FROM (SELECT k.*, unnest(range(0, passes + 1)) AS epoch FROM k) y),
c AS (SELECT *, sum(CASE WHEN epoch = passes THEN n_tokens ELSE 0 END) OVER (PARTITION BY s, epoch ORDER BY order_key) AS upto FROM x)
SELECT doc_id, source, epoch::INTEGER AS epoch,
       least({MIX_BLOCKS - 1}, floor((epoch + ('0x' || substr(order_key, 1, 12))::BIGINT::DOUBLE / {float(16**12)}::DOUBLE) / ratio * {MIX_BLOCKS})::INTEGER) AS mix_block,
       order_key, n_tokens
FROM c WHERE epoch < passes OR upto <= rest
"""
