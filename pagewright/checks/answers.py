"""Answer store and cost checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.canonical import json_array, json_object, json_string
from ..operators import answers as ops
from ..session import fresh_path
from ..sources import sinks
from .registry import Tables, check

# the JSON text of a string, character by character
_CHAR = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r'
 WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
 WHEN unicode(c) BETWEEN 32 AND 126 THEN c
 WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c))
 ELSE '\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) || '\u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023)) END"""


def _js(col: str) -> str:
    return f"""'"' || array_to_string(list_transform(string_split({col}, ''), lambda c: {_CHAR}), '') || '"'"""


REQUESTS = f"""
turns AS (SELECT conv_id, turn, text, {_js('text')} AS js, {_js('role')} AS jr,
   CASE conv_id % 3 WHEN 0 THEN 'large-1' WHEN 1 THEN 'small-1' ELSE 'ollama:tiny' END AS model
   FROM conversations),
requests AS (SELECT (conv_id * 100 + turn) * 10 + pass AS seq, conv_id, turn, model, pass, text,
   length(text)::BIGINT AS input_tokens, (length(text) // 4)::BIGINT AS output_tokens,
   CASE WHEN (conv_id * 7 + turn) % 17 = 0 THEN 'refusal' ELSE 'end_turn' END AS stop_reason,
   sha256('{{"max_tokens": 300, "messages": [{{"content": ' || js || ', "role": ' || jr || '}}], "model": "' || model || '"}}') AS key
   FROM turns, (SELECT unnest([1, 2]) AS pass)),
answers AS (SELECT key, any_value('re: ' || text) AS text FROM requests
            WHERE conv_id % 4 = 0 AND stop_reason <> 'refusal' GROUP BY key)
"""


def requests(t: Tables):
    model = F.expr("CASE conv_id % 3 WHEN 0 THEN 'large-1' WHEN 1 THEN 'small-1' ELSE 'ollama:tiny' END")
    message = json_object({"role": json_string(F.col("role")), "content": json_string(F.col("text"))})
    turns = t.conversations.withColumn("model", model).withColumn("messages", json_array(message))
    twice = turns.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
    payload = F.create_map(
        F.lit("model"), json_string(F.col("model")), F.lit("max_tokens"), F.lit("300"),
        F.lit("messages"), F.col("messages"), F.lit("timeout"), F.col("pass").cast("string"),
    )
    return twice.select(
        F.expr("(conv_id * 100 + turn) * 10 + pass").alias("seq"), "conv_id", "turn", "model", "pass", "text",
        payload.alias("payload"), F.length("text").cast("long").alias("input_tokens"),
        F.expr("cast(length(text) div 4 as bigint)").alias("output_tokens"),
        F.expr("CASE WHEN (conv_id * 7 + turn) % 17 = 0 THEN 'refusal' ELSE 'end_turn' END").alias("stop_reason"),
    )


def keyed(t: Tables):
    return ops.request_key(requests(t))


def stored(k):
    return k.filter("conv_id % 4 = 0 AND stop_reason <> 'refusal'").groupBy("key").agg(
        F.concat(F.lit("re: "), F.min("text")).alias("text")
    )


@check("request_key", f"WITH {REQUESTS} SELECT seq, model, pass::INT AS pass, key FROM requests")
def _(t):
    return keyed(t).select("seq", "model", "pass", "key")


LOOKUP = f"""{REQUESTS},
looked AS (SELECT seq, r.model, r.key, a.key IS NOT NULL AS hit, a.text AS answer,
  CASE WHEN a.key IS NULL THEN input_tokens ELSE 0 END::BIGINT AS input_tokens,
  CASE WHEN a.key IS NULL THEN output_tokens ELSE 0 END::BIGINT AS output_tokens
  FROM requests r LEFT JOIN answers a USING (key))"""


@check("cache_lookup", f"WITH {LOOKUP} SELECT * FROM looked")
def _(t):
    k = keyed(t)
    return ops.cache_lookup(k.select("seq", "model", "key", "input_tokens", "output_tokens"), stored(k))


@check("cache_stats", f"""WITH {LOOKUP} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
round(avg(hit::INT), 6) AS hit_rate FROM looked""")
def _(t):
    k = keyed(t)
    out = ops.cache_stats(ops.cache_lookup(k.select("seq", "key"), stored(k)))
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@check("batch_plan", f"""WITH {REQUESTS}
SELECT key, min(seq) AS first_seq, count(*) AS asked, min_by(model, seq) AS model FROM requests
WHERE key NOT IN (SELECT key FROM answers) GROUP BY key""")
def _(t):
    k = keyed(t)
    return ops.batch_plan(k.select("seq", "key", "model"), stored(k))


@check("answer_upsert", f"""WITH {REQUESTS},
fresh AS (SELECT key, max(seq) AS version, max_by('new: ' || text, seq) AS text FROM requests
          WHERE stop_reason <> 'refusal' AND conv_id % 3 <> 1 GROUP BY key)
SELECT 'vision' AS kind, key, coalesce(f.version, 0) AS version, coalesce(f.text, a.text) AS text
FROM answers a FULL JOIN fresh f USING (key)""")
def _(t):
    k = keyed(t)
    store = stored(k).select(
        F.lit("vision").alias("kind"), "key", F.lit(0).cast("long").alias("version"), "text",
        F.lit("end_turn").alias("stop_reason"),
    )
    new = k.filter("conv_id % 3 <> 1").select(
        F.lit("vision").alias("kind"), "key", F.col("seq").alias("version"),
        F.concat(F.lit("new: "), "text").alias("text"), "stop_reason",
    )
    return ops.answer_upsert(store, new).drop("stop_reason")


PRICED = f"""{REQUESTS},
priced AS (SELECT seq, conv_id, turn, model, round(CASE WHEN starts_with(model, 'ollama:') THEN 0.0 ELSE
  (input_tokens * CASE model WHEN 'small-1' THEN 2.0 ELSE 4.0 END
   + turn * CASE model WHEN 'small-1' THEN 2.0 ELSE 4.0 END * 1.25 + conv_id * 0.2
   + output_tokens * CASE model WHEN 'small-1' THEN 10.0 ELSE 20.0 END) / 1000000.0
  * CASE WHEN pass = 2 THEN 0.5 ELSE 1.0 END END::DOUBLE, 9) AS cost FROM requests)"""


def priced(t: Tables):
    usage = requests(t).select(
        "seq", "conv_id", "turn", "model", "pass", "input_tokens", "output_tokens",
        F.col("conv_id").alias("cache_read_input_tokens"), F.col("turn").alias("cache_creation_input_tokens"),
    )
    # one known model; the others are unknown (default price) or local (free)
    prices = t.spark.createDataFrame(
        [("small-1", 2.0, 10.0, 0.2)], "model string, price_in double, price_out double, price_cache_read double")
    return ops.price_join(usage, prices, batch=F.col("pass") == 2)


@check("price_join", f"WITH {PRICED} SELECT seq, model, cost FROM priced")
def _(t):
    return priced(t).select("seq", "model", F.round("cost", 9).alias("cost"))


@check("cost_rollup", f"""WITH {PRICED},
calls AS (SELECT conv_id AS sheet, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' ELSE 'trace' END AS source, cost FROM priced)
SELECT sheet, source, round(sum(cost), 9) AS cost, count(*) AS calls, count(*) AS pieces,
  GROUPING(sheet, source)::INT AS level FROM calls GROUP BY ROLLUP (sheet, source)""")
def _(t):
    calls = priced(t).select(
        F.col("conv_id").alias("sheet"),
        F.expr("CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'vector' ELSE 'trace' END").alias("source"),
        F.round("cost", 9).alias("cost"), F.lit(1).alias("pieces"),
    )
    return ops.cost_rollup(calls).withColumn("cost", F.round("cost", 9))


REPLY_TEXT = """CASE WHEN turn % 5 = 4 THEN 'no object here ' || issue
  WHEN turn % 5 = 3 THEN 'Broken {"score": 5, "issue": ' || issue || '}'
  ELSE 'Reply {"score": ' || CASE WHEN conv_id % 7 = 0 THEN '"n/a"' ELSE ((conv_id * 3 + turn) % 15 - 2) || '.5' END
       || ', "issue": "' || issue || '"} done' END"""
SCORES = r"""
rep AS (SELECT conv_id AS sheet, turn AS reply_id, *, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS issue_all FROM conversations),
raw AS (SELECT *, CASE WHEN turn % 5 < 3 AND conv_id % 7 <> 0 THEN (conv_id * 3 + turn) % 15 - 2 END AS whole FROM rep),
scores AS (SELECT sheet, reply_id,
  CASE WHEN whole IS NOT NULL THEN greatest(0, least(10, whole + CASE WHEN whole < 0 THEN CASE WHEN whole % 2 = 0 THEN 0 ELSE -1 END
                                     ELSE CASE WHEN whole % 2 = 0 THEN 0 ELSE 1 END END))::INT END AS score,
  CASE WHEN whole IS NOT NULL THEN left(issue_all, 160) END AS issue FROM raw)"""


def replies(t: Tables):
    rows = t.conversations.select(
        F.col("conv_id").alias("sheet"), F.col("turn").alias("reply_id"), "conv_id", "turn",
        F.regexp_replace("text", "[^A-Za-z0-9 ]", "").alias("issue"),
    )
    return rows.select("sheet", "reply_id", F.expr(REPLY_TEXT).alias("text"))


@check("reply_scores", f"""WITH {SCORES}
SELECT sheet, count(*) AS replies, round(avg((score IS NOT NULL)::INT), 6) AS readable,
  round(avg(score), 6) AS mean_score, count(*) FILTER (score < 7) AS low,
  coalesce(sum(length(issue)), 0)::BIGINT AS issue_chars FROM scores GROUP BY sheet""")
def _(t):
    scores = ops.reply_scores(replies(t))
    chars = scores.groupBy("sheet").agg(F.coalesce(F.sum(F.length("issue")), F.lit(0)).cast("long").alias("issue_chars"))
    return (
        ops.reply_summary(scores).withColumn("readable", F.round("readable", 6))
        .withColumn("mean_score", F.round("mean_score", 6)).join(chars, "sheet")
    )


@check("answer_fn", f"""WITH {REQUESTS},
todo AS (SELECT key, any_value(length(js_key)) AS n FROM (SELECT key, key AS js_key FROM requests) GROUP BY key)
SELECT 'vision' AS kind, key, CASE WHEN a.key IS NULL THEN 1 ELSE 0 END::BIGINT AS version,
  CASE WHEN a.key IS NULL THEN 'answer to ' || left(todo.key, 8) ELSE a.text END AS text
FROM todo LEFT JOIN answers a USING (key)
WHERE a.key IS NOT NULL OR left(todo.key, 1) <> '0'""")
def _(t):
    k = keyed(t)
    store = stored(k).select(
        F.lit("vision").alias("kind"), "key", F.lit(0).cast("long").alias("version"), "text",
        F.lit("end_turn").alias("stop_reason"), F.lit("m").alias("model"),
    )

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        refused = batch["key"].str.startswith("0")
        return pd.DataFrame({
            "key": batch["key"], "text": "answer to " + batch["key"].str[:8],
            "stop_reason": refused.map({True: "refusal", False: "end_turn"}), "model": "m",
        })

    asked = k.select("seq", F.lit("vision").alias("kind"), "key", "payload")
    return ops.answer_fn(asked, store, ask, version=1).select("kind", "key", "version", "text")


@check("piece_fns", """
SELECT p_partkey AS piece_id,
  CASE WHEN p_size % 2 = 0 THEN upper(p_name) WHEN p_size % 3 = 0 THEN reverse(p_name)
       WHEN p_size % 5 <> 0 THEN p_name END AS drawn,
  CASE WHEN p_size % 2 = 0 THEN 'text' WHEN p_size % 3 = 0 THEN 'vector' WHEN p_size % 5 <> 0 THEN 'trace' END AS method
FROM part""")
def _(t):
    @F.pandas_udf("string")
    def turned(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str[::-1].where(size % 3 == 0)

    fns = [
        ("text", lambda name, size: F.when(size % 2 == 0, F.upper(name))),
        ("vector", turned),
        ("trace", lambda name, size: F.when(size % 5 != 0, name)),
    ]
    pieces = t.part.select(F.col("p_partkey").alias("piece_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return ops.piece_fns(pieces, fns, "name", "size").select("piece_id", "drawn", "method")


@check("sink_answer_store", f"""WITH {REQUESTS}
SELECT 'vision' AS kind, key, max(seq) AS version, max_by(text, seq) AS text, left(key, 2) AS key_prefix
FROM requests WHERE stop_reason <> 'refusal' GROUP BY key""")
def _(t):
    path = fresh_path(t.spark, "answers")
    rows = keyed(t).filter("stop_reason <> 'refusal'").select(
        F.lit("vision").alias("kind"), "key", F.col("seq").alias("version"), "text", "stop_reason", "model", "pass"
    )
    for n in (1, 2):
        sinks.save_answers(rows.filter(F.col("pass") == n).drop("pass"), path)
    back = sinks.load_answers(t.spark, path, kind="vision")
    return back.select("kind", "key", "version", "text", F.substring("key", 1, 2).alias("key_prefix"))


@check("sink_sheet_output", """
SELECT l_suppkey AS sheet, l_linenumber AS piece, count(*) AS n FROM lineitem
WHERE NOT (l_suppkey % 2 = 0 AND l_linenumber > 3) GROUP BY ALL""")
def _(t):
    path = fresh_path(t.spark, "sheets")
    pieces = t.lineitem.groupBy(F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("piece")).agg(
        F.count("*").alias("n")
    )
    sinks.save_sheets(pieces, path)
    sinks.save_sheets(pieces.filter("sheet % 2 = 0 AND piece <= 3"), path)
    return t.spark.read.parquet(path).select(F.col("sheet").cast("long").alias("sheet"), "piece", "n")
