import hashlib
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.functions.canonical import bytes_key, json_array, json_object, json_string
from pagewright.operators import answers as A
from pagewright.session import fresh_path
from pagewright.sources import sinks

TEXTS = ["plain", 'quote " and \\ slash', "tab\tnew\nline\r\b\f", "größe — ✓", "emoji 😀 and  ", "\x00\x1f\x7f", ""]


def test_request_key_is_the_canonical_hash(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    message = json_object({"role": F.lit('"user"'), "content": json_string(F.col("t"))})
    for timeout in ("5", "60"):
        payload = F.create_map(F.lit("model"), F.lit('"m"'), F.lit("messages"), json_array(message), F.lit("timeout"), F.lit(timeout))
        got = {r["i"]: r["key"] for r in A.request_key(df.withColumn("payload", payload)).collect()}
        for i, t in enumerate(TEXTS):
            blob = json.dumps({"model": "m", "messages": [{"role": "user", "content": t}]}, sort_keys=True)
            assert got[i] == hashlib.sha256(blob.encode()).hexdigest(), t


def test_bytes_key(spark):
    got = spark.createDataFrame([(bytearray(b"abc"),)], "d binary").select(bytes_key(F.col("d"), F.lit("'png'"), F.lit("3"))).first()[0]
    assert got == hashlib.sha256(b"abc" + b"'png'" + b"3").hexdigest()


@pytest.mark.parametrize("text,score", [
    ('ok {"score": 7.5, "issue": "a"} end', 8), ('{"score": 6.5}', 6), ('{"score": 14}', 10), ('{"score": -3}', 0),
    ('{"score": "8"}', 8), ('{"score": "n/a"}', None), ('{"issue": "x"}', None), ("nothing", None), ("} {", None), ('{"score": 5', None)])
def test_reply_reading(spark, text, score):
    r = A.reply_scores(spark.createDataFrame([(1, 1, text)], "sheet int, reply_id int, text string")).first()
    assert r["score"] == score


def test_issue_is_cut(spark):
    text = json.dumps({"score": 3, "issue": "y" * 400})
    assert A.reply_scores(spark.createDataFrame([(1, 1, text)], "sheet int, reply_id int, text string")).first()["issue"] == "y" * 160


def test_cost(spark):
    usage = spark.createDataFrame(
        [("unknown", 1000, 100, 10, 8), ("known", 1000, 100, 0, 0), ("ollama:x", 9, 9, 9, 9)],
        "model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")
    prices = spark.createDataFrame([("known", 2.0, 10.0, 0.1)], "model string, price_in double, price_out double, price_cache_read double")
    got = {r["model"]: r["cost"] for r in A.price_join(usage, prices).collect()}
    assert got["unknown"] == pytest.approx((1000 * 4 + 8 * 4 * 1.25 + 10 * 0.2 + 100 * 20) / 1e6)
    assert got["known"] == pytest.approx((1000 * 2 + 100 * 10) / 1e6) and got["ollama:x"] == 0
    half = {r["model"]: r["cost"] for r in A.price_join(usage, prices, batch=F.lit(True)).collect()}
    assert half["known"] == pytest.approx(got["known"] / 2)


def test_same_request_once_and_refusals_not_stored(spark):
    req = spark.createDataFrame([(1, "k", "a", {"x": "1"}), (2, "k", "a", {"x": "1"}), (3, "k", "b", {"x": "2"})],
                                "seq long, kind string, key string, payload map<string,string>")
    store = spark.createDataFrame([], "kind string, key string, version long, text string, stop_reason string, model string")

    def ask(batch):
        return pd.DataFrame({"key": batch["key"], "text": "t", "stop_reason": ["refusal" if k == "b" else "end_turn" for k in batch["key"]], "model": "m"})

    plan = A.batch_plan(req, store).orderBy("first_seq").collect()
    assert [(r["key"], r["first_seq"], r["asked"]) for r in plan] == [("a", 1, 2), ("b", 3, 1)]
    got = A.answer_fn(req, store, ask, version=1)
    assert [r["key"] for r in got.collect()] == ["a"]
    hits = {r["seq"]: r["hit"] for r in A.cache_lookup(req, got).collect()}
    assert hits == {1: True, 2: True, 3: False}


def test_store_on_disk_keeps_the_newest(spark):
    path = fresh_path(spark, "t-answers")
    cols = "kind string, key string, version long, text string, stop_reason string, model string"
    sinks.save_answers(spark.createDataFrame([("k", "aa1", 1, "old", "end_turn", "m"), ("k", "bb1", 1, "only", "end_turn", "m")], cols), path)
    sinks.save_answers(spark.createDataFrame([("k", "aa1", 2, "new", "end_turn", "m")], cols), path)
    assert {r["key"]: r["text"] for r in sinks.load_answers(spark, path, "k").collect()} == {"aa1": "new", "bb1": "only"}


def test_json_text_of_odd_characters_and_of_long_texts(spark):
    """The escape against ``json.dumps``, and its time in proportion to the text."""
    texts = ["", "plain", 'q"b\\s/', "\b\t\n\f\r\x00\x1f\x7f", "é日本", "😀a😀", "\\u000a", "a b", "tail\n", '"', "\\", "퟿", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", json_string(F.col("t")).alias("j")).collect():
        assert r["j"] == (None if texts[r["i"]] is None else json.dumps(texts[r["i"]]))

    def seconds(n):
        start = time.time()
        got = spark.range(8).select(json_string(F.repeat(F.lit('é"x\n '), n)).alias("j")).agg(F.sum(F.length("j"))).first()[0]
        assert got == 8 * (len(json.dumps('é"x\n ')[1:-1]) * n + 2)
        return time.time() - start

    seconds(100)
    assert seconds(200_000) < 20  # a million characters a row
    assert seconds(16_000) < 3 * max(seconds(8_000), 0.5)
