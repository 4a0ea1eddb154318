"""Retrieval checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import unit
from ..operators import index as kept_index
from ..operators import prompts as prompt_ops
from ..operators import retrieval as ops
from ..session import fresh_path, spread, written
from ..sources import maps
from .registry import Tables, check

# ---------------------------------------------------------------- inputs

WORDS_SQL = r"list_filter(list_distinct(string_split_regex(lower({}), '[^\p{L}\p{N}]+')), lambda w: w <> '')"


def _words(col: str) -> str:
    return WORDS_SQL.replace("{}", col)


ENTRIES = f"""
entries AS (SELECT doc_id AS entry_idx, {_words('text')} AS words, doc_id % 2 = 0 AS has_ref FROM documents),
prompts AS (SELECT item_id AS prompt_id, text FROM benchmark
            UNION ALL SELECT -1, 'zzzz qqqq nothing' UNION ALL SELECT -2, ''),
asked AS (SELECT DISTINCT prompt_id, unnest({_words('text')}) AS word FROM prompts),
posting AS (SELECT entry_idx, has_ref, unnest(words) AS word FROM entries)
"""


def entries(t: Tables):
    return spread(t.documents.select("doc_id", "text")).select(
        F.col("doc_id").alias("entry_idx"), words(F.col("text")).alias("words"),
        (F.col("doc_id") % 2 == 0).alias("has_ref"),
    )


def prompts(t: Tables):
    # rows of a range, whose size the planner knows; it takes local rows for a table too large to send out
    extra = t.spark.range(-2, 0).select(F.col("id").alias("prompt_id"), F.when(F.col("id") == -1, "zzzz qqqq nothing").otherwise("").alias("text"))
    return t.benchmark.select(F.col("item_id").alias("prompt_id"), "text").unionByName(extra)


VECTORS = """
raw_vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
  UNION ALL
  SELECT vec_id + 1000000, label, list_transform(embedding, lambda v: v::DOUBLE + 0.001) FROM embeddings WHERE vec_id % 10 = 0),
vectors AS (
  SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS e FROM raw_vectors)
"""


def vectors(t: Tables):
    base = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    near = base.filter("vec_id % 10 = 0").select(
        (F.col("vec_id") + 1000000).alias("vec_id"), "label", F.transform("e", lambda v: v + 0.001).alias("e")
    )
    return base.unionByName(near).withColumn("e", unit(F.col("e")))


# ---------------------------------------------------------------- checks


@check("retrieve_join", f"""WITH {ENTRIES}
SELECT prompt_id, entry_idx, word FROM posting JOIN asked USING (word) WHERE has_ref""")
def _(t):
    return ops.retrieve_join(entries(t), prompts(t), require_ref=True)


@check("keyword_score", f"""WITH {ENTRIES}
SELECT prompt_id, entry_idx, count(DISTINCT word) AS score FROM posting JOIN asked USING (word) GROUP BY ALL""")
def _(t):
    return ops.keyword_score(ops.retrieve_join(entries(t), prompts(t)))


TOPK = f"""{ENTRIES},
scores AS (SELECT prompt_id, entry_idx, count(DISTINCT word) AS score FROM posting JOIN asked USING (word)
           WHERE has_ref GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, entry_idx) AS rank FROM scores),
first AS (SELECT entry_idx, row_number() OVER (ORDER BY entry_idx) AS rank FROM entries WHERE has_ref
          ORDER BY entry_idx LIMIT 4)
"""


@check("retrieve_topk", f"""WITH {TOPK}
SELECT prompt_id, entry_idx, score, rank FROM best WHERE rank <= 4
UNION ALL
SELECT prompt_id, entry_idx, 0, rank FROM prompts, first WHERE prompt_id NOT IN (SELECT prompt_id FROM scores)""")
def _(t):
    return ops.retrieve_topk(entries(t), prompts(t))


@check("retrieve_kept_index", f"""WITH {TOPK}
SELECT prompt_id, entry_idx, score, rank FROM best WHERE rank <= 4
UNION ALL
SELECT prompt_id, entry_idx, 0, rank FROM prompts, first WHERE prompt_id NOT IN (SELECT prompt_id FROM scores)""")
def _(t):
    """An index that was written before and is opened by its path."""
    path = fresh_path(t.spark, "index")
    kept_index.build(entries(t).filter("has_ref"), path)
    return ops.topk_from(kept_index.opened(t.spark, path), prompts(t))


def _unrestricted(sql: str) -> str:
    """The same with every entry eligible."""
    return sql.replace("WHERE has_ref GROUP BY ALL", "GROUP BY ALL").replace("FROM entries WHERE has_ref", "FROM entries")


@check("retrieve_topk_all", f"""WITH {_unrestricted(TOPK)}
SELECT prompt_id, entry_idx, score, rank FROM best WHERE rank <= 4
UNION ALL
SELECT prompt_id, entry_idx, 0, rank FROM prompts, first WHERE prompt_id NOT IN (SELECT prompt_id FROM scores)""")
def _(t):
    return ops.retrieve_topk(entries(t), prompts(t), require_ref=False)


@check("index_equals_walk", f"""WITH {ENTRIES}, pw AS (SELECT prompt_id, {_words('text')} AS w FROM prompts),
walk AS (SELECT prompt_id, entry_idx, len(list_intersect(words, w)) AS score FROM entries, pw)
SELECT prompt_id, count(*) AS n_entries, sum(score)::BIGINT AS total, 0::BIGINT AS n_differ
FROM walk WHERE score > 0 GROUP BY ALL""")
def _(t):
    # words are told once, for the index and for the walk
    e, p = written(entries(t).select("entry_idx", "words")), prompts(t)
    sides = ops.side_counts(ops.keyword_score(ops.retrieve_join(e, p)), ops.walk_score(e, p))
    return sides.groupBy("prompt_id").agg(
        F.sum("n_left").alias("n_entries"), F.sum(F.col("score") * F.col("n_left")).alias("total"),
        F.sum(F.abs(F.col("n_left") - F.col("n_right"))).alias("n_differ")).filter("n_entries > 0")


@check("seeded_draw", f"""WITH {TOPK},
drawn AS (SELECT *, row_number() OVER (PARTITION BY prompt_id
            ORDER BY md5('7|' || prompt_id || '|' || entry_idx), entry_idx) AS draw FROM best WHERE rank <= 32)
SELECT * FROM drawn WHERE draw <= 4
UNION ALL
SELECT prompt_id, entry_idx, 0, rank, rank FROM prompts, first WHERE prompt_id NOT IN (SELECT prompt_id FROM scores)""")
def _(t):
    return ops.seeded_draw(entries(t), prompts(t), seed=7)


THIN_K = 40


WALK = f"""WITH RECURSIVE {VECTORS},
ranking AS (SELECT label, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id % 1000000, vec_id) AS rank
            FROM vectors),
walk AS (
  SELECT DISTINCT label, 0::BIGINT AS pos, NULL::BIGINT AS seen, NULL::BIGINT AS copy_of, []::BIGINT[] AS ids, []::BIGINT[] AS ranks, []::DOUBLE[][] AS es FROM vectors
  UNION ALL
  SELECT w.label, r.rank, r.vec_id, CASE WHEN len(w.ids) < {THIN_K} AND first_near IS NOT NULL THEN w.ids[first_near] END,
    CASE WHEN ok THEN list_append(w.ids, r.vec_id) ELSE w.ids END,
    CASE WHEN ok THEN list_append(w.ranks, r.rank) ELSE w.ranks END,
    CASE WHEN ok THEN list_append(w.es, r.e) ELSE w.es END
  FROM walk w JOIN ranking r ON r.label = w.label AND r.rank = w.pos + 1,
  LATERAL (SELECT list_position(list_transform(w.es, lambda q: list_dot_product(q, r.e) > 0.97), true) AS first_near),
  LATERAL (SELECT len(w.ids) < {THIN_K} AND first_near IS NULL AS ok)),
last AS (SELECT label, ids, ranks FROM walk QUALIFY row_number() OVER (PARTITION BY label ORDER BY pos DESC) = 1)"""


def ranking(v):
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy(F.expr("vec_id % 1000000"), "vec_id")
    return v.select(
        F.col("label").alias("prompt_id"), F.col("vec_id").alias("entry_idx"), F.row_number().over(order).alias("rank")
    )


THINNED = f"""WITH RECURSIVE {_unrestricted(TOPK)}, {VECTORS},
ranking AS (SELECT prompt_id, entry_idx, rank, e FROM best LEFT JOIN vectors ON vec_id = entry_idx),
walk AS (
  SELECT DISTINCT prompt_id, 0::BIGINT AS pos, []::BIGINT[] AS ids, []::BIGINT[] AS ranks, []::DOUBLE[][] AS es FROM ranking
  UNION ALL
  SELECT w.prompt_id, r.rank, CASE WHEN ok THEN list_append(w.ids, r.entry_idx) ELSE w.ids END,
    CASE WHEN ok THEN list_append(w.ranks, r.rank) ELSE w.ranks END, CASE WHEN ok THEN list_append(w.es, r.e) ELSE w.es END
  FROM walk w JOIN ranking r ON r.prompt_id = w.prompt_id AND r.rank = w.pos + 1,
  LATERAL (SELECT list_position(list_transform(w.es, lambda q: list_dot_product(q, r.e) > 0.97), true) IS NULL AS ok) WHERE len(w.ids) < 4),
last AS (SELECT prompt_id, ids, ranks FROM walk QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY pos DESC) = 1)
SELECT prompt_id, unnest(ids) AS entry_idx, unnest(ranks) AS rank, generate_subscripts(ids, 1) AS place FROM last"""


@check("near_dup_thin", f"""{WALK}
SELECT label AS prompt_id, unnest(ids) AS entry_idx, unnest(ranks) AS rank,
       generate_subscripts(ids, 1) AS place FROM last""")
def _(t):
    v = vectors(t)
    return ops.near_dup_thin(ranking(v), v.select(F.col("vec_id").alias("entry_idx"), "e"), k=THIN_K, pool=16)


@check("retrieve_thinned", THINNED)
def _(t):
    # from words to kept entries in one job: every document is an entry, its vector the one of the same number
    ranking_ = ops.ranked(ops.keyword_score(ops.retrieve_join(entries(t), prompts(t))))
    return ops.near_dup_thin(ranking_, vectors(t).select(F.col("vec_id").alias("entry_idx"), "e"), k=4)


@check("retrieve_map_files", THINNED)
def _(t):
    """One job from map files to thinned answers: read, words, ranking, vectors, walk."""
    read = ops.entry_words(maps.map_entries(maps.read_map_files(t.spark, map_files(t, F.lit(None).cast("array<string>")))))
    known = read.select(F.regexp_extract("image", r"doc_(\d+)", 1).cast("long").alias("entry_idx"), "words")
    ranking_ = ops.ranked(ops.keyword_score(ops.retrieve_join(known, prompts(t))))
    return ops.near_dup_thin(ranking_, vectors(t).select(F.col("vec_id").alias("entry_idx"), "e"), k=4)


@check("near_dup_pairs", f"""{WALK}
SELECT label AS prompt_id, seen AS entry_idx, pos AS rank, copy_of AS kept_idx FROM walk WHERE copy_of IS NOT NULL""")
def _(t):
    v = vectors(t)
    out = ops.near_dup_pairs(ranking(v), v.select(F.col("vec_id").alias("entry_idx"), "e"), k=THIN_K, pool=16)
    return out.drop("cosine")


@check("src_embeddings", """
WITH v AS (SELECT vec_id // 10 AS map_id, (vec_id % 10)::INT AS entry_idx,
                  list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY entry_idx DESC) AS back FROM v),
ent AS (SELECT map_id, entry_idx FROM n WHERE NOT (map_id % 7 = 0 AND back = 1)),
fit AS (SELECT map_id FROM v GROUP BY 1 INTERSECT
        (SELECT map_id FROM (SELECT map_id, count(*) AS c FROM v GROUP BY 1) JOIN
                            (SELECT map_id, count(*) AS c FROM ent GROUP BY 1) USING (map_id, c)))
SELECT map_id, entry_idx, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_value,
       round(1.0, 6)::DOUBLE AS length
FROM v JOIN fit USING (map_id)""")
def _(t):
    from pyspark.sql import Window

    from ..functions.vectors import norm

    v = t.embeddings.selectExpr(
        "vec_id div 10 AS map_id", "cast(vec_id % 10 AS int) AS entry_idx", "embedding"
    )
    back = Window.partitionBy("map_id").orderBy(F.desc("entry_idx"))
    ent = v.select("map_id", "entry_idx", F.row_number().over(back).alias("back")).filter(
        "NOT (map_id % 7 = 0 AND back = 1)"
    )
    out = maps.map_vectors(v, ent)
    return out.select(
        "map_id", "entry_idx", F.round(F.element_at("e", 1), 6).alias("first_value"),
        F.round(norm(F.col("e")), 6).alias("length"),
    )


def map_files(t: Tables, keywords) -> str:
    """A folder of map files, each of at most fifty documents, none of which names its entries by number."""
    item = F.struct(F.concat(F.lit("doc_"), "doc_id", F.lit(".png")).alias("image"), keywords.alias("keywords"), F.col("text").alias("caption"))
    maps_ = t.documents.groupBy(F.expr("doc_id div 50").alias("no")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("l"))
    value = F.to_json(F.struct(F.concat(F.lit("map "), "no").alias("name"), F.when(F.col("no") % 2 == 0, F.lit("ink")).alias("lora"), F.col("l.item").alias("entries")))
    path = fresh_path(t.spark, "maps")
    maps_.select("no", value.alias("value")).write.partitionBy("no").text(path)
    return path


@check("src_map_files", f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS entry_idx,
  CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' ELSE '' END || coalesce(text, '') AS said FROM documents)
SELECT 'map ' || doc_id // 50 AS name, CASE WHEN doc_id // 50 % 2 = 0 THEN 'ink.safetensors' END AS lora, entry_idx::INT AS entry_idx, 'doc_' || doc_id || '.png' AS image,
  len({_words('said')}) AS n_words, md5(array_to_string(list_sort({_words('said')}), ' ')) AS words_md5 FROM d""")
def _(t):
    """Map files written and read back, with the words of their entries."""
    path = map_files(t, F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")))
    read = ops.entry_words(maps.map_entries(maps.read_map_files(t.spark, path)))
    return read.select("name", "lora", "entry_idx", "image", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort("words"), " ").cast("binary")).alias("words_md5"))


@check("src_map_entries", r"""
WITH m AS (SELECT *, 'maps/' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '-rag.ragmap.json'
                  ELSE '-rag.json' END AS map_id,
                  string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT *, unnest(lines) AS caption, generate_subscripts(lines, 1) - 1 AS entry_idx FROM m)
SELECT map_id, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE 'map ' || doc_id END AS name,
  CASE doc_id % 3 WHEN 1 THEN 'style_' || lang || '.safetensors' WHEN 2 THEN 'x.safetensors' END AS lora,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS "trigger",
  CASE WHEN doc_id % 2 = 0 AND doc_id % 6 <> 0 THEN '.' ELSE 'images' END AS image_dir,
  CASE WHEN doc_id % 2 = 1 OR doc_id % 10 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS weight,
  CASE WHEN doc_id % 2 = 1 OR doc_id % 14 = 0 THEN 4 ELSE 6 END AS top_k,
  entry_idx::INT AS entry_idx, doc_id || '_' || entry_idx || '.png' AS image,
  CASE WHEN doc_id % 2 = 0 AND entry_idx % 2 = 0 THEN lang || ',' || source END AS keywords, caption
FROM x""")
def _(t):
    def item(i, line, with_keywords):
        fields = [
            F.concat_ws("", "doc_id", F.lit("_"), i, F.lit(".png")).alias("image"), line.alias("caption"),
        ]
        if with_keywords:
            fields.append(F.when(i % 2 == 0, F.array("lang", "source")).alias("keywords"))
        return F.struct(*fields)

    lines = F.split("text", "\n")
    name = F.expr("CASE WHEN doc_id % 4 <> 0 THEN concat('map ', doc_id) END").alias("name")
    lora = F.expr("CASE doc_id % 3 WHEN 1 THEN concat('style_', lang) WHEN 2 THEN 'x.safetensors' END").alias("lora")
    current = t.documents.filter("doc_id % 2 = 0").select(
        F.expr("concat('maps/', source, '/', doc_id, '-rag.ragmap.json')").alias("map_id"),
        F.to_json(F.struct(
            F.lit("example").alias("schema"), name, lora, F.col("lang").alias("trigger"),
            F.expr("CASE WHEN doc_id % 6 = 0 THEN 'images' END").alias("image_dir"),
            F.expr("CASE WHEN doc_id % 10 <> 0 THEN 0.5D END").alias("weight"),
            F.expr("CASE WHEN doc_id % 14 <> 0 THEN 6 END").alias("top_k"),
            F.transform(lines, lambda line, i: item(i, line, True)).alias("entries"),
        )).alias("value"),
    )
    legacy = t.documents.filter("doc_id % 2 = 1").select(
        F.expr("concat('maps/', source, '/', doc_id, '-rag.json')").alias("map_id"),
        F.to_json(F.struct(
            name, lora, F.lit("images").alias("images_dir"),
            F.transform(lines, lambda line, i: item(i, line, False)).alias("entries"),
        )).alias("value"),
    )
    out = maps.map_entries(maps.parse_maps(current), maps.parse_maps(legacy, legacy=True))
    return out.withColumn("keywords", F.when(F.col("keywords").isNotNull(), F.array_join("keywords", ",")))


@check("trigger_inject", r"""
WITH s AS (SELECT p_partkey AS style,
  CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_slice(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' x y', ' '), 1, 4), ', ') END AS a,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS b,
  CASE WHEN p_partkey % 7 = 0 THEN p_type END AS c,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '_' || p_type END AS d FROM part),
g AS (SELECT style, coalesce(a, b, c, CASE WHEN regexp_matches(d, '^[A-Za-z][A-Za-z]{0,39}$') THEN d END) AS style_trigger FROM s),
p AS (SELECT p_partkey AS prompt_id, p_partkey AS style, 'style ' || lower(p_type) || ' ' || p_name AS prompt,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS mt FROM part),
l AS (SELECT *, CASE WHEN mt IS NULL OR contains(lower(prompt), lower(mt)) THEN prompt ELSE mt || ', ' || prompt END AS led FROM p)
SELECT prompt_id, style, style_trigger,
  CASE WHEN style_trigger IS NULL OR contains(lower(led), lower(style_trigger)) THEN led ELSE led || ', ' || style_trigger END AS full_prompt
FROM l JOIN g USING (style)""")
def _(t):
    styles = t.part.selectExpr(
        "p_partkey AS style",
        "CASE WHEN p_partkey % 3 = 0 THEN split(concat(p_name, ' ', p_type, ' ', p_brand, ' x y'), ' ') END AS sidecar",
        "CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS trigger_phrase",
        "CASE WHEN p_partkey % 7 = 0 THEN p_type END AS trigger_words",
        "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat('_', p_type) END AS output_name",
    )
    asked = t.part.selectExpr(
        "p_partkey AS prompt_id", "p_partkey AS style", "concat('style ', lower(p_type), ' ', p_name) AS prompt",
        "CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS map_trigger",
    )
    return prompt_ops.trigger_inject(asked, styles)


@check("caption_pair", """
WITH i AS (SELECT source AS dataset, 'doc_' || doc_id AS stem FROM documents),
c AS (SELECT source AS dataset, 'doc_' || (doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END) AS stem
      FROM labels JOIN documents USING (doc_id)),
j AS (SELECT coalesce(i.dataset, c.dataset) AS dataset, i.stem AS a, c.stem AS b
      FROM i FULL JOIN c ON i.dataset = c.dataset AND i.stem = c.stem),
n AS (SELECT dataset, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired,
  count(*) FILTER (b IS NULL) AS without_caption, count(*) FILTER (a IS NULL) AS without_image FROM j GROUP BY 1)
SELECT *, CASE WHEN paired < 15 THEN 'small' WHEN paired <= 30 THEN 'good' WHEN paired < 50 THEN 'large'
          ELSE 'excellent' END AS size_class FROM n""")
def _(t):
    images = t.documents.selectExpr("source AS dataset", "concat('doc_', doc_id, '.png') AS path")
    captions = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").selectExpr(
        "source AS dataset",
        "concat('doc_', doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END, '.txt') AS path",
    )
    return prompt_ops.caption_pair(images, captions)
