"""Versions, sentences and null keys, on hand-made rows."""

from pyspark.sql import functions as F

from pagewright.operators import catalog as C
from pagewright.operators import copies, logs


def test_versions_of_any_length(spark):
    tags = [("v1.20240101123456789012345.0",), ("v1.9",), ("1.10.0",), ("junk",), (None,), ("v1.0009.0.0",)]
    out = {r["tag"]: r["newer"] for r in C.version_compare(spark.createDataFrame(tags, "tag string"), "1.9").collect()}
    assert out == {"v1.20240101123456789012345.0": True, "v1.9": False, "1.10.0": True, "junk": False, None: False, "v1.0009.0.0": False}


def sentence(spark, detail, pattern, said):
    sweeps = spark.createDataFrame([(1, "run", detail, pattern)], "sweep int, command string, detail string, detail_pattern string").withColumns(
        {"not_run_when": F.lit(None).cast("array<string>"), "on_failure": F.lit(None).cast("string"), "why": F.lit(None).cast("string")})
    runs = spark.createDataFrame([(1, 1, 0, said)], "run_id int, sweep int, code int, said string")
    return C.sweep_verdicts(sweeps, runs).first()["detail"]


def test_sentences_are_filled_like_format(spark):
    five, said = r"(\\w)(\\w)(\\w)(\\w)(\\w)".replace("\\\\", "\\"), "abcde"
    for detail, pattern in (("{0}-{4}", five), ("{}{}{}", five), ("{{{1}}} {1}", five), ("none", five)):
        assert sentence(spark, detail, pattern, said) == detail.format(*"abcde")
    # no group for a place, or both ways of counting: the sentence stays as it is
    for detail in ("{3}", "{} {0}", "{name}"):
        assert sentence(spark, detail, r"(\w)\w", said) == detail


def test_rows_with_null_keys_and_times_stay(spark):
    rows = [("a", "2024-01-01 00:00:00", 1, "INFO", "x"), ("a", None, 2, "INFO", "y"), (None, "2024-01-01 00:00:00", 3, "INFO", "z"), (None, None, 4, "INFO", "z")]
    log = spark.createDataFrame(rows, "source string, ts string, line_id int, level string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    # inside the null source the row without a time comes first and the other repeats it
    assert {r["line_id"] for r in logs.repeat_collapse(log).collect()} == {1, 2, 4}
    assert {r["line_id"] for r in logs.log_retention(log).collect()} == {1, 2, 3, 4}
    assert {r["source"] for r in logs.damage_signs(log).collect()} == {"a", None}


def test_long_cycles_are_found(spark):
    import math

    frames = [("c", i, [math.sin(i * 2 * math.pi / 90), math.cos(i * 2 * math.pi / 90)]) for i in range(200)]
    df = spark.createDataFrame(frames, "clip string, frame_no int, e array<double>")
    got = copies.loop_cut(df, 60, 120).first()
    assert got["stop"] - got["start"] == 90
