"""Lines that many documents share go, but for the last document that holds them; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_checked, table

#: Production parameters: code points of a key, documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text, as an array; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` joined by LF without those at the ascending positions ``gone``: the stretches between them, so that the time is in proportion to the lines."""
    after = F.concat(F.array(F.lit(-1)), gone)
    before = F.concat(gone, F.array(F.size(lines)))
    stretches = F.zip_with(after, before, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(F.filter(stretches, lambda s: F.size(s) > 0)), "\n")


def common_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``_id, _t, _gone``: for each text that loses lines, by its id and a hash of the text, their positions in ascending order.

    Lines become 128-bit hashes of their keys. One aggregate with a partial one before the shuffle counts lines by hash; only
    hashes that occur often enough are looked at further, so a line that a third of all rows hold is one row of each task there. The lines of
    those hashes are then counted by distinct documents. Both joins broadcast a counted table of hashes if it is small, else shuffle, where Spark splits hot hashes.
    """
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_t"), F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"))
    keyed = rows.withColumn("_key", line_key(F.col("_line"))).filter(F.char_length("_key") >= least_chars)
    # written, as keys and hashes of all lines cost more than reading them again
    lines = cut(keyed.select("_id", "_t", "_pos", F.unhex(F.md5("_key")).alias("_hash")))
    often = cut(lines.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_docs).select("_hash"))
    held = cut(join_checked(lines, often, ["_hash"]))
    # in a struct, as a null id is a document too, below all others
    of_documents = held.groupBy("_hash", F.struct("_id").alias("_doc")).agg(F.lit(1).alias("_one")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_docs"), F.max("_doc").alias("_last"))
    common = cut(of_documents.filter(F.col("_docs") >= least_docs).select("_hash", "_last"))
    gone = join_checked(held, common, ["_hash"]).filter(F.struct("_id") < F.col("_last"))
    return gone.groupBy("_id", "_t").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))


def drop_common_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with common lines taken out of the texts, and ``_n_lines`` (before) and ``_n_dropped`` added.

    A line's key is the line without blanks, tabs, LF, VT, FF and CR at its ends and with A-Z in lower case. A key of at least ``least_chars`` code points that
    at least ``least_docs`` documents hold loses all its lines, but for those of the document with the largest id that holds it. The
    other lines stay as they are, in their order, joined by LF.

    Documents are told apart by id: rows that share an id are one document for the counts, each with its own text. A null id is one document, below all others. A null text is
    an empty one (one empty line) and stays null. Repeated rows are treated alike. An empty table gives no rows. Other columns are
    carried along, but for those named like an added one.
    """
    gone = cut(common_lines(docs, key=key, text=text, least_chars=least_chars, least_docs=least_docs))
    # texts are shuffled at any size: whether they are would otherwise depend on how many lose lines
    losses = gone.select(F.col("_id").alias("_gone_id"), F.col("_t").alias("_gone_t"), "_gone").hint("merge")
    # the row as one column, so that none of its columns clashes with those added
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_t"))
    on = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_t") == F.col("_gone_t"))
    joined = rows.join(losses, on, "left").withColumn("_lines", lines_of(F.col(f"_row.`{text}`")))
    lost = F.col("_gone").isNotNull()
    kept = F.when(lost, _without(F.col("_lines"), F.col("_gone"))).otherwise(F.col(f"_row.`{text}`"))
    added = {"_n_lines": F.size("_lines").cast("long"), "_n_dropped": F.when(lost, F.size("_gone")).otherwise(0).cast("long")}
    return joined.select(*[(kept.alias(c) if c == text else F.col(f"_row.`{c}`")) for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.*, coalesce(k.doc_id < c.last, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
