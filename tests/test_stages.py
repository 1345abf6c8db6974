import pytest
from pyspark.sql import functions as F

from gneiss.sources import stages


def test_hit_miss_and_torn_write(spark, tmp_path):
    folder, calls = str(tmp_path / "stages"), []
    df = spark.createDataFrame([(1, "a", [1.0], {"k": 1}), (2, None, None, None), (2, None, None, None)], "i int, t string, v array<double>, m map<string,int>")

    def ask(rows, **how):
        def make():
            calls.append(1)
            return rows.groupBy("i").agg(F.count("*").alias("n"))

        return sorted(map(tuple, stages.stage(folder, "counts", [rows], make, **how).collect()))

    assert ask(df) == [(1, 1), (2, 2)] and len(calls) == 1
    assert ask(df.orderBy(F.desc("i")).repartition(3)) == [(1, 1), (2, 2)] and len(calls) == 1
    assert ask(df.dropDuplicates(["i"])) == [(1, 1), (2, 1)] and len(calls) == 2  # repeated rows count
    assert ask(df.withColumn("t", F.lit("b"))) == [(1, 1), (2, 2)] and len(calls) == 3
    assert ask(df.withColumn("t", F.lit("b")), params={"x": 1}) and len(calls) == 4
    assert ask(df.withColumn("t", F.lit("b")), params={"x": 1}, version=2) and len(calls) == 5
    # one table is left; a half-written one has no entry
    path = stages.manifest(spark, folder)["counts"]["path"]
    assert [p.name for p in (tmp_path / "stages").iterdir() if p.is_dir()] == [path]
    (tmp_path / "stages" / "counts-half").mkdir()
    (tmp_path / "stages" / path / "_SUCCESS").unlink()
    assert ask(df.withColumn("t", F.lit("b")), params={"x": 1}, version=2) == [(1, 1), (2, 2)] and len(calls) == 6
    (tmp_path / "stages" / "manifest.json").write_text('{"counts": {"key"')
    for crc in (tmp_path / "stages").glob(".manifest.json*.crc"):
        crc.unlink()
    assert stages.manifest(spark, folder) == {}
    assert ask(df) == [(1, 1), (2, 2)] and len(calls) == 7 and ask(df) and len(calls) == 7


def test_a_failed_build_leaves_the_old_entry(spark, tmp_path):
    folder, df = str(tmp_path / "stages"), spark.range(5)
    stages.stage(folder, "s", [df], lambda: df)

    def broken():
        return df.select(F.raise_error(F.lit("no")).cast("long").alias("id"))

    with pytest.raises(Exception, match="no"):
        stages.stage(folder, "s", [spark.range(6)], broken)
    assert stages.stage(folder, "s", [df], broken).count() == 5


def test_csv_is_read_once(spark, tmp_path):
    path, folder = tmp_path / "t.csv", str(tmp_path / "kept")
    path.write_text("a,b,c\n1,x,2.5\n2,,3\n")
    first = stages.csv_once(spark, folder, "t", str(path))
    assert first.dtypes == [("a", "int"), ("b", "string"), ("c", "double")] and first.count() == 2
    entry = stages.manifest(spark, folder)["t"]["path"]
    assert [tuple(r) for r in stages.csv_once(spark, folder, "t", str(path), ["c"]).orderBy("c").collect()] == [(2.5,), (3.0,)]
    assert stages.manifest(spark, folder)["t"]["path"] == entry
    path.write_text("a,b,c\n1,x,2.5\n")
    assert stages.csv_once(spark, folder, "t", str(path)).count() == 1 and stages.manifest(spark, folder)["t"]["path"] != entry
