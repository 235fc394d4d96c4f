"""Heads of files, encodings of large ones, and profiles of many CSVs together."""

import os

import pytest
from pyspark.sql import functions as F

from sparkseries.sources import files


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    (tmp_path / "csv").mkdir()
    return tmp_path / "csv"


def test_a_large_file_is_detected_by_its_head(spark, folder):
    with open(folder / "large.csv", "wb") as f:
        f.write("時刻,気温\n2016/1/1,1\n".encode("cp932"))
        f.truncate(3_000_000_000)  # sparse
    (folder / "small.csv").write_bytes("時刻,気温\n".encode())
    listed = files.list_files(spark, str(folder)).select("path", "size")
    heads = {os.path.basename(r.path): r.head for r in files.file_heads(listed, 1000).collect()}
    assert {n: len(h) for n, h in heads.items()} == {"large.csv": 1000, "small.csv": 14}
    found = {os.path.basename(r.path): r.encoding for r in files.detect_encodings(spark, str(folder), 1000).collect()}
    assert found == {"large.csv": "cp932", "small.csv": "utf-8"}
    ranges = files.byte_ranges(listed, 64_000_000).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end")).collect()
    assert {os.path.basename(r.path): (r.n, r.end) for r in ranges} == {"large.csv": (47, 3_000_000_000), "small.csv": (1, 14)}


@pytest.mark.parametrize("cut", range(1, 40))
def test_a_character_at_the_edge_of_the_head_does_not_count(spark, folder, cut):
    if cut % 6 == 1:
        text = "見出し\n" + "あいう,えお\n" * 3
        (folder / "a.csv").write_bytes(text.encode())
        assert files.detect_encodings(spark, str(folder), 13 + cut).first().encoding == "utf-8"


def test_ascii_bodies_behind_a_header(spark, folder, monkeypatch):
    (folder / "a.csv").write_bytes("時刻,気温\n".encode("cp932") + b"2016/1/1 0:00,1.5\n" * 50)
    (folder / "b.csv").write_bytes("時刻,気温\n".encode("cp932") + b"2016/1/1 0:00,1.5\n" * 50 + "2016/1/1 0:00,高\n".encode("cp932"))
    (folder / "c.csv").write_bytes("見出し".encode("cp932"))
    listed = files.list_files(spark, str(folder)).select("path", "size")
    for size in (7, 100, 10_000):
        found = {os.path.basename(r.path): r.is_ascii for r in files.ascii_bodies(listed, size).collect()}
        # a header longer than a range counts as body
        assert found == {"a.csv": size > 7, "b.csv": False, "c.csv": True}
    df = files.read_csv(spark, str(folder / "a.csv"))
    assert dict(df.dtypes) == {"時刻": "timestamp_ntz", "気温": "double"} and df.count() == 50
    assert files.read_csv(spark, str(folder / "b.csv")).filter("`気温` = '高'").count() == 1


def test_many_files_together(spark, folder):
    made = {"a b.csv": "x,name,empty\n1,u,\n2,*,\n2,*,\n*,v,\n", "s_p+1.csv": "x,y,x\n1.5,a,3\n", "short.csv": "p,q\n1\n2,3,4\n", "quoted.csv": 't\n"a,b"\n"a,b"\n', "header.csv": "only,header\n"}
    for n, text in made.items():
        (folder / n).write_text(text)
    (folder / "old.csv").write_bytes("名,値\n高,1\n低,2\n".encode("cp932"))
    (folder / "bad.csv").write_bytes(b"\x00\xff\xfe\x81\x00")
    (folder / "none.csv").write_bytes(b"")
    paths = [str(folder / n) for n in (*made, "old.csv", "bad.csv", "none.csv", "missing.csv")]
    got = {os.path.basename(r.path): r for r in files.profile_files(spark, paths).collect()}
    assert {n for n, r in got.items() if r.error} == {"bad.csv", "none.csv", "missing.csv"} and all(got[n].n_rows is None for n in ("bad.csv", "missing.csv"))
    counts = {n: (r.n_rows, r.n_columns, r.duplicated_rows, r.missing_columns, r.missing_cells) for n, r in got.items() if not r.error}
    assert counts == {"a b.csv": (4, 3, 1, 3, 7), "s_p+1.csv": (1, 3, 0, 0, 0), "short.csv": (2, 2, 0, 1, 1), "quoted.csv": (2, 1, 1, 0, 0), "header.csv": (0, 2, 0, 0, 0), "old.csv": (2, 2, 0, 0, 0)}
    assert got["a b.csv"].missing_rate == pytest.approx(7 / 12) and got["a b.csv"].name == files.dataset_name(str(folder / "a b.csv"))
    columns = {(os.path.basename(r.path), r.position): r for r in files.profile_file_columns(spark, paths).collect()}
    x = columns["a b.csv", 0]
    assert (x.column, x.kind, x.missing, x.n_unique, x["mode"], x["min"], x["max"]) == ("x", "number", 1, 3, "2", 1, 2) and x["mean"] == pytest.approx(5 / 3) and x["std"] == pytest.approx((1 / 3) ** 0.5)
    assert [columns["a b.csv", k].kind for k in (1, 2)] == ["text", "empty"] and columns["a b.csv", 1]["mean"] is None
    assert [columns["old.csv", k].column for k in (0, 1)] == ["名", "値"] and columns["old.csv", 1]["max"] == 2
    assert [columns["s_p+1.csv", k].column for k in range(3)] == ["x", "y", "x"] and columns["header.csv", 0].n_unique == 0


def test_the_number_of_jobs_does_not_follow_the_number_of_files(spark, folder):
    def jobs(n: int) -> int:
        for k in range(n):
            (folder / f"{n}-{k}.csv").write_text(f"a,b\n{k},x\n")
        group = f"files-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert files.profile_files(spark, [str(folder / f"{n}-{k}.csv") for k in range(n)]).count() == n
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(25) <= jobs(2) + 2


def test_csv_files_are_written_without_sorting(spark):
    """A sort holds all rows of a file in one task's memory."""
    from sparkseries.plans import table_queries

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    paths = table_queries._csv_files(spark, "/root/testdata/sf0.001")
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p]
    assert writes and not any("Sort" in p for p in writes)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert len(paths) == len(set(paths)) == orders.select("o_orderpriority").distinct().count()
    assert spark.read.option("header", True).csv(paths).count() == orders.count() + orders.filter("o_orderkey % 13 = 0").count()
