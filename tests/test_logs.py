import os
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagewright.operators import logs
from pagewright.session import fresh_path
from pagewright.sources import logs as source
from pagewright.sources import sinks
from pagewright.streaming import carried, meters

T0 = datetime(2024, 5, 1, 10)
LOG = "source int, ts timestamp, line_id long, level string, text string"


def _log(spark, texts, source=1, start=0):
    return spark.createDataFrame([(source, T0 + timedelta(minutes=17 * (start + i)), start + i, lv, tx) for i, (lv, tx) in enumerate(texts)], LOG)


def test_repeats_are_written_once(spark):
    log = _log(spark, [("INFO", "hello")] * 3 + [("ERROR", "hello"), ("ERROR", "x"), ("INFO", "hello"), ("INFO", "hello")])
    assert [r["line_id"] for r in logs.repeat_collapse(log).orderBy("line_id").collect()] == [0, 3, 4, 5]


def test_records_from_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "(older lines dropped)\n2024-05-01 10:00:00 INFO  one\n2024-05-01 10:00:01 ERROR two\n    more\n        deeper\n2024-05-01 10:00:02 INFO  \n")
    got = source.parse_log(source.read_log_lines(spark, str(tmp_path))).orderBy("record").collect()
    assert [(r["level"], r["text"]) for r in got] == [(None, "(older lines dropped)"), ("INFO", "one"), ("ERROR", "two\nmore\n    deeper"), ("INFO", "")]


def test_retention_equals_cutting_the_file(spark):
    texts = [("INFO", "line %d %s" % (i, "x" * (i % 9))) for i in range(60)]
    whole = "".join("%s %-5s %s\n" % ((T0 + timedelta(minutes=17 * i)).strftime("%Y-%m-%d %H:%M:%S"), lv, tx) for i, (lv, tx) in enumerate(texts))
    for keep in (400, 401, 433, 700):
        tail = whole.encode()[-keep:]
        want = tail[tail.find(b"\n") + 1:].decode().splitlines()
        got = logs.log_retention(_log(spark, texts), max_bytes=1000, keep_bytes=keep).orderBy("line_id").collect()
        assert [r["text"] for r in got] == [logs.DROPPED] + [w[26:] for w in want]
    assert logs.log_retention(_log(spark, texts), max_bytes=len(whole), keep_bytes=10).count() == 60


def test_damage_only_in_the_tail(spark):
    bad = "No module named 'nodes'"
    early = _log(spark, [("ERROR", bad)] + [("INFO", "x" * 100)] * 50, source=1)
    late = _log(spark, [("INFO", "x" * 100)] * 50 + [("ERROR", bad)], source=2)
    got = {r["source"]: r["damaged"] for r in logs.damage_signs(early.unionByName(late)).collect()}
    assert got == {1: False, 2: True}


def _files(spark, df, n):
    path = fresh_path(spark, "t-stream")
    for i in range(n):
        df.filter(F.col("line_id") % 100 * n >= i * 100).filter(F.col("line_id") % 100 * n < (i + 1) * 100).coalesce(1).write.mode("append").parquet(path)
    return path


def test_streams_equal_batches(spark):
    rows = [(s, T0 + timedelta(seconds=(i * 7) % 11 + i * 9), s * 100 + i, "INFO", "t%d" % ((i // 3) % 2), (i * 5) % 13 // 4 + i // 20)
            for s in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, LOG + ", gen int").orderBy("line_id")
    path = _files(spark, df, 4)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    # every file is later than the one before, as a log's are
    out = fresh_path(spark, "t-out")
    carried.collapse_repeats(read().drop("gen"), out).awaitTermination()
    want = logs.repeat_collapse(df.drop("gen"))
    got = carried.read_output(spark, out)
    assert got.select("batch").distinct().count() == 4
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    out = fresh_path(spark, "t-out")
    carried.find_stalls(read().select("source", "ts", "line_id"), out, limit=9).awaitTermination()
    want = logs.stall_gaps(df, limit=9)
    assert sorted(map(tuple, carried.read_output(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    out = fresh_path(spark, "t-out")
    carried.newest_generation(read(), out).awaitTermination()
    kept, top = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        top[r[0]] = max(top.get(r[0], -1), r[5])
        if r[5] >= top[r[0]]:
            kept.append(r[2])
    assert sorted(r["line_id"] for r in carried.read_output(spark, out).collect()) == sorted(kept)
    out = fresh_path(spark, "t-out")
    meters.cost_meter(read().withColumn("cost", F.lit(0.5)), out, bucket="5 minutes").awaitTermination()
    reading = meters.meter_reading(spark, out)
    want = df.groupBy(F.window("ts", "5 minutes")["start"].alias("start")).agg((F.count("*") * 0.5).alias("cost"), F.count("*").alias("calls"))
    assert sorted(map(tuple, reading.collect())) == sorted(map(tuple, want.collect()))


def test_sheet_folder_holds_no_stale_piece(spark):
    path = fresh_path(spark, "t-sheets")
    sinks.save_sheets(spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "sheet int, piece int"), path)
    sinks.save_sheets(spark.createDataFrame([(1, 0)], "sheet int, piece int"), path)
    assert sorted((r["sheet"], r["piece"]) for r in spark.read.parquet(path).collect()) == [(1, 0), (2, 0)]


def test_sheets_share_folders_and_are_replaced_one_by_one(spark):
    """Folders grow far slower than sheets; a sheet written again leaves its neighbours, named or not, as they were."""
    for kind, name in (("long", lambda i: i), ("string", lambda i: f"s{i}")):
        path = fresh_path(spark, "t-shelves")
        first = [(name(i), p) for i in range(3000) for p in (0, 1)] + [(None, 0), (None, 1)]
        sinks.save_sheets(spark.createDataFrame(first, f"sheet {kind}, piece int"), path)
        again = [(name(i), 7) for i in range(0, 40, 2)] + [(None, 7), (name(5000), 7)]
        sinks.save_sheets(spark.createDataFrame(again, f"sheet {kind}, piece int"), path)
        gone = {s for s, _ in again}
        got = [(r["sheet"], r["piece"]) for r in spark.read.parquet(path).collect()]
        assert Counter(got) == Counter([r for r in first if r[0] not in gone] + again)
        assert len(os.listdir(path)) <= 1100
