"""CSV with encoding and date detection, parquet, catalogs of files, sinks."""

from __future__ import annotations

import csv
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ratio
from ..operators.ranges import written

NULL_MARK = "*"
#: Bytes of a file that its header is looked for in, and bytes that are read at a time.
HEADER_BYTES, CHUNK_BYTES = 1_000_000, 8_000_000
#: Date and time formats that text columns are tried with, in this order (fixed values).
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")


def _opened(path: str):
    """A file of any store that pyarrow knows by its address, for reads at a place."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def byte_ranges(files: DataFrame, size: int, n_bytes: int | None = None) -> DataFrame:
    """``path, begin, end`` of the ranges of ``size`` bytes of each file (``path, size``), or of its first ``n_bytes`` only."""
    upto = F.col("size") if n_bytes is None else F.least(F.col("size"), F.lit(n_bytes).cast("long"))
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(upto - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    return files.select("path", upto.alias("_upto"), F.explode(begins).alias("begin")).select("path", "begin", F.least(F.col("begin") + size, F.col("_upto")).alias("end"))


def file_heads(files: DataFrame, n_bytes: int = 1_000_000) -> DataFrame:
    """``path, head, error``: the first bytes of each file (``path, size``). No more is read of it, however large; a file that can't be read has the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                head = error = None
                try:
                    with _opened(path) as f:
                        head = f.read_at(n_bytes, 0)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "head": [head], "error": [error]})

    return files.select("path").mapInPandas(run, "path string, head binary, error string")


def ascii_bodies(files: DataFrame, range_bytes: int = 64_000_000) -> DataFrame:
    """``path, is_ascii``: whether all of a file (``path, size``) behind its first line end is ASCII. Files are read by ranges, in parallel, a chunk at a time; nothing is decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, begin, end in zip(batch["path"], batch["begin"], batch["end"], strict=True):
                with _opened(path) as f:
                    at, ok, header = int(begin), True, begin == 0
                    while ok and at < end and (chunk := f.read_at(min(CHUNK_BYTES, int(end) - at), at)):
                        at += len(chunk)
                        if header:
                            _, newline, chunk = chunk.partition(b"\n")
                            header = not newline
                        ok = chunk.isascii()
                found.append((path, ok))
            yield pd.DataFrame(found, columns=["path", "is_ascii"])

    return byte_ranges(files, range_bytes).mapInPandas(run, "path string, is_ascii boolean").groupBy("path").agg(F.bool_and("is_ascii").alias("is_ascii"))


def _encoding(head: Column, complete: Column) -> Column:
    """utf-8 if the whole lines of a file's first bytes are, else cp932; cut at the last line end, so that no character is cut in two."""
    text = F.decode(head, "ISO-8859-1")
    last = F.length(F.substring_index(text, "\n", -1))
    cut = F.when(complete, head).otherwise(head.substr(F.lit(1), F.length(head) - last))
    return F.when(F.is_valid_utf8(cut.cast("string")), "utf-8").otherwise("cp932")


def detect_encodings(spark: SparkSession, path: str, sample_bytes: int = 1_000_000) -> DataFrame:
    """``path, encoding`` of every file: utf-8 if the complete lines of its first bytes are, else cp932. One job for all files, which reads these bytes only."""
    files = list_files(spark, path).select("path", "size")
    heads = file_heads(files, sample_bytes)
    return heads.select("path", _encoding(F.col("head"), F.length("head") < sample_bytes).alias("encoding"))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str | None = None, date_sample: int = 100) -> DataFrame:
    """A CSV with a header: detected encoding, ``*`` as null, types inferred from the whole file unless a schema is given, dates promoted.

    cp932 needs ``spark.sql.legacy.javaCharsets`` (see ``session.configure``).
    """
    names = None
    if encoding is None:
        kinds = {r["encoding"] for r in detect_encodings(spark, path).collect()}
        encoding = "utf-8" if kinds <= {"utf-8"} else "cp932"
        # only the header needs decoding where all behind it is ASCII; the rest is scanned as it is
        if encoding == "cp932" and (names := _ascii_header(spark, path)):
            encoding = "utf-8"
    reader = spark.read.option("header", True).option("nullValue", NULL_MARK).option("encoding", "windows-31j" if encoding == "cp932" else encoding)
    if schema is not None:
        return reader.schema(schema).csv(path)
    # timestamps are promoted below, by one rule for all
    frame = reader.option("inferSchema", True).option("timestampFormat", "'none'").option("timestampNTZFormat", "'none'").option("dateFormat", "'none'").option("preferDate", False).csv(path)
    return promote_dates(frame.toDF(*names) if names and len(names) == len(frame.columns) else frame, date_sample)


def _header(head: bytes, encoding: str) -> list[str]:
    """The names in the first line."""
    line = head.partition(b"\n")[0].rstrip(b"\r").removeprefix(b"\xef\xbb\xbf")
    return next(csv.reader([line.decode(encoding, "replace")]), [])


def _ascii_header(spark: SparkSession, path: str) -> list[str] | None:
    """The column names of cp932 files with one header behind which all bytes are ASCII; else none."""
    files = list_files(spark, path).select("path", "size")
    headers = {tuple(_header(r["head"] or b"", "cp932")) for r in file_heads(files, HEADER_BYTES).collect()}
    if len(headers) != 1 or not ascii_bodies(files).agg(F.bool_and("is_ascii")).first()[0]:
        return None
    return list(headers.pop())


def parsed(c: str, form: str) -> Column:
    return F.try_to_timestamp(F.col(c), F.lit(_loose(form))).cast("timestamp_ntz")


def _loose(form: str) -> str:
    """One-digit months, days and hours are read too."""
    return form.replace("MM", "M").replace("dd", "d").replace("HH", "H")


def promote_dates(df: DataFrame, sample: int = 100, least: float = 0.95) -> DataFrame:
    """Text columns become timestamps if one format parses the first ``sample`` values and at least ``least`` of all; what it does not parse becomes null.

    All (column, format) pairs are tried in one aggregate over the values and one over the sample.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    shares = {(c, k): F.avg(F.when(F.col(c).isNotNull(), parsed(c, form).isNotNull().cast("double"))) for c in columns for k, form in enumerate(DATE_FORMATS)}

    def measure(rows: DataFrame) -> dict:
        row = rows.agg(*[x.alias(f"s{i}_{k}") for (c, k), x in shares.items() for i in [columns.index(c)]]).first()
        return {(c, k): row[f"s{columns.index(c)}_{k}"] for c, k in shares}

    head = measure(df.select(*columns).limit(sample))
    hopeful = [x for x, s in head.items() if s == 1.0]
    if not hopeful:
        return df
    every = measure(df)
    chosen: dict[str, str] = {}
    for c, k in hopeful:
        if c not in chosen and (every[c, k] or 0) >= least:
            chosen[c] = DATE_FORMATS[k]
    return df.withColumns({c: parsed(c, form) for c, form in chosen.items()}) if chosen else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV by its ending."""
    return read_csv(spark, path) if path.lower().endswith((".csv", ".csv.gz")) else spark.read.parquet(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """``path, name, folder, size, modified`` of files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if exclude is None else out.filter(~F.col("path").contains(exclude))


def query_files(files: DataFrame, name: str | None = None, endings: Sequence[str] = (), sort: str = "name", descending: bool = False, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of a catalog: by part of the name or a pattern with * and ?, and by ending; the page number is kept within what there is."""
    if name:
        pattern = re.escape(name.lower()).replace(r"\*", ".*").replace(r"\?", ".")
        whole = "*" in name or "?" in name
        files = files.filter(F.lower("name").rlike(f"^{pattern}$" if whole else pattern))
    if endings:
        files = files.filter(F.lower("name").rlike("(" + "|".join(re.escape(e.lower()) for e in endings) + ")$"))
    n = files.count()
    page = min(max(1, page), max(1, -(-n // page_size)))
    order = F.desc(sort) if descending else F.asc(sort)
    ranked = files.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "name", "path")))
    return ranked.filter(F.col("_rn").between((page - 1) * page_size + 1, page * page_size)).orderBy("_rn").drop("_rn")


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def source_signature(spark: SparkSession, source: str) -> str:
    """Paths, sizes and times of the files of a source."""
    files = list_files(spark, source).select("path", "size", F.col("modified").cast("string").alias("m")).orderBy("path").collect()
    return json.dumps([list(r) for r in files])


def materialize(spark: SparkSession, source: str, target: str) -> DataFrame:
    """The source as parquet, written once and read again as long as the source's files have not changed.

    A new version goes to a folder of its own; the mark, which names it, is written last, so readers find whole versions only.
    """
    signature = source_signature(spark, source)
    mark = f"{target}/_signature"
    try:
        kept = "\n".join(r[0] for r in spark.read.text(mark, wholetext=True).collect())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = None
    folder, _, of = (kept or "").strip().partition("\n")
    if of != signature:
        folder = f"data-{uuid.uuid4().hex}"
        read_table(spark, source).write.parquet(f"{target}/{folder}")
        spark.createDataFrame([(f"{folder}\n{signature}",)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(f"{target}/{folder}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def prediction_columns(columns: Sequence[str]) -> list[str]:
    """``pred``, or ``pred_0, pred_1, ...`` by class number."""
    found = [c for c in columns if re.fullmatch(r"pred(_\d+)?", c)]
    return sorted(found, key=lambda c: int(c[5:] or -1))


def write_predictions(df: DataFrame, path: str, key: str, fold: str | None = None, target: str | None = None) -> None:
    """``key, fold, target, pred..`` as parquet; NaN becomes null."""
    preds = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in prediction_columns(df.columns)]
    fixed = [F.col(key).alias("key"), (F.col(fold).cast("int") if fold else F.lit(None).cast("int")).alias("fold"), (F.col(target).cast("double") if target else F.lit(None).cast("double")).alias("target")]
    df.select(*fixed, *preds).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str | None = None, runs: str | None = None, file: str = "oof.parquet") -> DataFrame:
    """A member's predictions by path, or those of the newest run folder that has them (names in order of time)."""
    if path is None:
        newest = list_files(spark, runs, "*.parquet").select(F.regexp_extract("path", rf"^(.*/{re.escape(file)})(/|$)", 1).alias("p")).filter("p != ''").agg(F.max("p")).first()[0]
        if newest is None:
            raise FileNotFoundError(f"no {file} under {runs}")
        path = newest
    return spark.read.parquet(path)


def profile_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``name, path, n_rows, n_columns, duplicated_rows, duplicated_rate, missing_columns, missing_cells, missing_rate, error`` of every CSV, as ``table_profile`` counts them, in the order given (a path given twice is one row); a file that can't be read is a row with ``error``."""
    rows, _ = _many_files(spark, paths)
    return rows


def profile_file_columns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, position, column, kind, missing, missing_rate, n_unique, mode, mean, std, min, max`` of every column of every CSV that can be read.

    ``n_unique`` counts null as a value; a column is a number if all its values are, and only then has mean to max; ties of the mode go to the first value in order.
    """
    _, columns = _many_files(spark, paths)
    return columns


def _many_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The tables above, from one read of the files' heads and one aggregate each over the values of all files by position, whatever the number of files."""
    addresses = dict.fromkeys(p if "://" in p or p.startswith("file:") else f"file://{os.path.abspath(p)}" for p in paths)
    given = spark.createDataFrame(list(enumerate(addresses)), "_i long, path string")
    described = written(given.repartition(min(len(paths), 1000) or 1).mapInPandas(_describe, "_i long, path string, encoding string, names array<string>, error string"))
    good = described.filter("error is null").withColumn("n_columns", F.size("names"))
    widest = good.agg(F.max("n_columns")).first()[0] or 0
    of_encoding = {r["encoding"]: r["paths"] for r in good.groupBy("encoding").agg(F.collect_list("path").alias("paths")).collect()}
    schema = ", ".join(f"c{i} string" for i in range(max(1, widest)))
    parts = [
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", NULL_MARK).option("encoding", "windows-31j" if e == "cp932" else e).csv(found).select(F.col("_metadata.file_path").alias("_file"), F.array(*[f"c{i}" for i in range(max(1, widest))]).alias("values"))
        for e, found in of_encoding.items()
    ]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "_file string, values array<string>")
    # both sides' addresses in one form; Spark's own are encoded
    form = lambda c: F.regexp_replace(c, "^file:/+", "file:///")
    plain = F.url_decode(F.regexp_replace("_file", r"\+", "%2B"))
    keyed = rows.withColumn("_file", form(plain)).join(F.broadcast(good.select(F.col("path").alias("_path"), form("path").alias("_file"), "n_columns")), "_file").select(F.col("_path").alias("path"), F.slice("values", 1, F.col("n_columns")).alias("values"), "n_columns")
    # each row by its hash, so that repeated rows are counted without moving the values
    distinct = keyed.groupBy("path", F.xxhash64("values").alias("_h"), F.xxhash64(F.lit(1), "values").alias("_g")).agg(F.count(F.lit(1)).alias("_n")).groupBy("path").agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("_d"))
    cells = keyed.select("path", F.posexplode("values").alias("position", "v"))
    counts = cells.groupBy("path", "position", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("v").try_cast("double"))
    of_column = counts.groupBy("path", "position").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.min(F.when(F.col("v").isNotNull(), F.struct(-F.col("n"), "v"))).alias("m"), F.count_if(F.col("v").isNotNull() & F.col("x").isNull()).alias("texts"),
        F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.when(F.col("x").isNotNull(), F.col("n"))).alias("k"), F.min("x").alias("least"), F.max("x").alias("most"),
    )
    of_column = written(of_column)
    spread = counts.join(of_column.select("path", "position", (F.col("s") / F.col("k")).alias("_mean")), ["path", "position"]).groupBy("path", "position").agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("_mean"), F.lit(2.0))).alias("squares"))
    names = good.select("path", F.posexplode("names").alias("position", "column"))
    numeric = (F.col("texts") == 0) & (F.col("k") > 0)
    only = lambda c: F.when(numeric, c)
    columns = names.join(of_column.join(spread, ["path", "position"]), ["path", "position"], "left").select(
        "path", "position", "column", F.when(numeric, "number").when(F.col("m").isNotNull(), "text").otherwise("empty").alias("kind"), F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), ratio("missing", "rows").alias("missing_rate"), F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), F.col("m.v").alias("mode"),
        only(F.col("s") / F.col("k")).alias("mean"), only(F.sqrt(ratio("squares", F.col("k") - 1))).alias("std"), only(F.col("least")).alias("min"), only(F.col("most")).alias("max"),
    )
    missing = of_column.groupBy("path").agg(F.count_if(F.col("missing") > 0).alias("missing_columns"), F.sum("missing").alias("missing_cells"))
    zero = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0).cast("long")))
    tables = described.join(distinct, "path", "left").join(missing, "path", "left").orderBy("_i").select("path", zero("n_rows").alias("n_rows"), F.when(F.col("error").isNull(), F.size("names").cast("long")).alias("n_columns"), zero(F.col("n_rows") - F.col("_d")).alias("duplicated_rows"), zero("missing_columns").alias("missing_columns"), zero("missing_cells").alias("missing_cells"), "error")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "://"), -1), r"(?U)\.\w+$", ""), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return tables.select(name.alias("name"), "path", "n_rows", "n_columns", "duplicated_rows", ratio("duplicated_rows", "n_rows").alias("duplicated_rate"), "missing_columns", "missing_cells", ratio("missing_cells", F.col("n_rows") * F.col("n_columns")).alias("missing_rate"), "error"), columns


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Encoding and column names of CSVs, or why they can't be read."""
    for batch in batches:
        out = []
        for i, path in zip(batch["_i"], batch["path"], strict=True):
            try:
                with _opened(path) as f:
                    head = f.read_at(HEADER_BYTES, 0)
                whole = head if len(head) < HEADER_BYTES else head[: head.rfind(b"\n") + 1]
                encoding = "utf-8"
                try:
                    whole.decode()
                except UnicodeDecodeError:
                    encoding = "cp932"
                    whole.decode("cp932")
                names = _header(head, encoding)
                out.append((i, path, encoding, names, None) if names and b"\0" not in head else (i, path, None, None, "no header" if not head.strip() else "not text"))
            except (OSError, UnicodeDecodeError, csv.Error) as e:
                out.append((i, path, None, None, type(e).__name__))
        yield pd.DataFrame(out, columns=["_i", "path", "encoding", "names", "error"])


def dataset_name(path: str) -> str:
    """Folders and name without ending, joined by underscores."""
    return re.sub(r"[^\w]+", "_", re.sub(r"\.\w+$", "", path.split("://")[-1])).strip("_")
