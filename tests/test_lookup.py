"""A lookup reads a bounded part of its table."""

from pyspark.sql import functions as F

from shoebox.sources import tables


def rows_read(df):
    """(rows found, rows that the scan gave to the filter)."""
    found = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return found, leaf.metrics().get("numOutputRows").get().value()


def test_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LOOKUP_BYTES", 64 << 10)
    rows = spark.range(60_000).select(F.concat(F.lit("/lib/"), F.md5(F.col("id").cast("string"))).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("label"), "id")
    path = str(tmp_path / "lookup")
    tables.write_lookup(rows, path)
    one = rows.where("id = 4321").first()["path"]
    found, read = rows_read(tables.look_up(spark, path, [one]))
    assert [r["id"] for r in found] == [4321] and read < 6_000
    found, read = rows_read(tables.look_up(spark, path, [one + "x"]))
    assert not found and read < 6_000
    assert tables.look_up(spark, path, []).count() == 0
