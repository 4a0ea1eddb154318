"""The registered queries ``opN_<name>`` over whole tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extract, hosts, jaccard, labelled, merkle, packing, positive, subword, suffixes, tokens, warc, whiten, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, installed alike on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load() -> tuple[dict, dict]:
    return QUERIES, ORACLES


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
    FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = d.doc_id
"""


@query(JACCARD_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85, links=False).select("doc_id", "n_shingles", "component_id")


WINNOW_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
    FROM (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT m FROM bw
), dw AS (
    SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
    FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, lens WHERE len(ws) >= m)
), h AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY 1
), hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query(WINNOW_SQL)
def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)
    return packing.pack(cuts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


def judged(scores: DataFrame, at: float) -> DataFrame:
    return scores.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(subword.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(positive.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


HOSTS_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)
), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1
), dl AS (
    SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1
), m AS (
    SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY 1
), fit AS (SELECT sum(f) / sum(n) AS mean, var_pop(f / n) AS spread, avg(1 / n) AS inv FROM h
), st AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * inv > 0 THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * inv) - 1, 2), 10000) ELSE 10000 END AS s FROM fit
), v AS (SELECT source, (f + mean * s) / (n + s) > 0.5 AS bad FROM h, st)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


@query(HOSTS_SQL)
def op9_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.quality_verdicts(table(spark, sf_dir, "documents"), host="source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM s LEFT JOIN f ON f.payload_digest = s.payload_digest AND payload_bytes >= 100
"""


@query(WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.stored(warc.bundles(table(spark, sf_dir, "pages")))
    return warc.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHAT_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(regexp_replace(text, '(\\|\[INST\]|\[/INST\]|\[OUT\]|</s>|\[ROLE\]|\[/ROLE\]|\[END\])', '_\1', 'g')) AS tn,
           length(regexp_replace(role, '(\\|\[INST\]|\[/INST\]|\[OUT\]|</s>|\[ROLE\]|\[/ROLE\]|\[END\])', '_\1', 'g')) AS rn FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(tn + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE rn + 18 END)::BIGINT AS formatted_chars
FROM e GROUP BY 1
"""


@query(CHAT_SQL)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.formatted(rows))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))) AS crc
    FROM documents
), h AS (
    SELECT doc_id, lang, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(front || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS other
    FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
          || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS front FROM d)
), num AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM h
), lv AS (
    SELECT tree, 0 AS level, pos AS idx, n, leaf AS digest FROM num
    UNION ALL SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY tree, level, idx // 8
), tops AS (SELECT tree, digest, count(*) OVER () AS n FROM lv WHERE n = 1
), tv AS (
    SELECT 0 AS level, tree AS idx, n, digest FROM tops
    UNION ALL SELECT level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tv WHERE n > 1 GROUP BY level, idx // 8
), nodes AS (
    SELECT tree, level, idx, n, digest FROM lv UNION ALL SELECT -1, level, idx, n, digest FROM tv
), runs AS (
    SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY 1, 2, 3
), way AS (
    SELECT doc_id, leaf, other, tree AS home, pos AS place, tree, 0 AS level, pos AS idx, '' AS proof, coalesce(other, leaf) AS node, false AS done FROM num
    UNION ALL SELECT doc_id, leaf, other, home, place,
        CASE WHEN r.idx IS NULL THEN -1 ELSE w.tree END, CASE WHEN r.idx IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN r.idx IS NULL THEN w.tree ELSE w.idx // 8 END,
        proof || coalesce(lft || rgt, ''), CASE WHEN r.idx IS NULL THEN node ELSE sha256(lft || node || rgt) END, r.idx IS NULL AND w.tree = -1
    FROM way w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.idx = w.idx WHERE NOT done
)
SELECT doc_id, leaf, tops.digest AS subroot, tv.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = tv.digest AS verified
FROM way JOIN tops ON tops.tree = way.home JOIN tv ON tv.n = 1 WHERE done
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", merkle.UPPER, merkle.LOWER)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    told = merkle.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": lower}, where=chosen)
    back = told.withColumn("folded_root", merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("proof")))
    return back.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"), components=4)


@query()
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.without_repeats(table(spark, sf_dir, "documents"), span=200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
