import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import ordered


def test_slices_equal_plain_windows_on_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(0)).alias("k"), F.col("id").alias("t"),
        (F.col("id") * 37 % 101).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("maybe"))
    sliced = ordered.range_slices(df, ["k"], ["t"])
    order = [F.col("t")]
    out = ordered.running_sum(sliced, ["k"], order, F.col("v"), "s")
    out = ordered.running_max(out, ["k"], order, F.col("v"), "m")
    out = ordered.number_rows(out, ["k"], order, "n")
    out = ordered.previous(out, ["k"], order, F.col("maybe"), "p")
    w = Window.partitionBy("k").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(run).alias("s"), F.max("v").over(run).alias("m"), F.row_number().over(w).alias("n"), F.lag("maybe").over(w).alias("p"))
    cols = ["k", "t", "s", "m", "n", "p"]
    assert out.select(*cols).exceptAll(want.select(*cols)).count() == 0 and out.count() == 4000


def test_median(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select((F.col("id") * 3.0).alias("v"))
        assert ordered.exact_median(df, "v").first()[0] == (n - 1) * 1.5


@pytest.fixture
def whole_slices(spark):
    """Spark joins partitions of a few KB; here they are to be seen as dealt."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_bursts_and_ties_are_spread_over_slices(spark, whole_slices):
    """One group, one hour, one value for most rows: no slice holds much more than its share, and windows stay exact."""
    df = spark.range(8000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 10 > 0, F.lit(5)).otherwise(F.col("id")).alias("t"), "id")
    sliced = ordered.range_slices(df, ["k"], ["t", "id"])
    sizes = [r["count"] for r in sliced.groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 3 * 8000 / len(sizes)
    order = [F.col("t"), F.col("id")]
    got = ordered.number_rows(sliced, ["k"], order, "n").select("id", "n")
    assert got.exceptAll(df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("n"))).count() == 0
    same = ordered.range_slices(spark.range(4000).select(F.lit(1).alias("v")), [], ["v"])
    assert same.select(ordered.SLICE).distinct().count() >= 4


def test_frames_of_a_clip_are_numbered_by_slices(spark):
    import re

    from pagewright.checks.copies import frames
    from pagewright.checks.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    df = frames(t)
    assert not re.search(r"windowspecdefinition\(label#\d+, vec_id", df._jdf.queryExecution().optimizedPlan().toString())
    got = sorted((r.clip, r.frame_no) for r in df.collect())
    n = {r.label: r["count"] for r in t.embeddings.groupBy("label").count().collect()}
    assert got == sorted((clip, i) for clip, k in n.items() for i in range(k))
