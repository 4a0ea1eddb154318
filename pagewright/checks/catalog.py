"""Catalogue, inventory and audit checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..session import fresh_path
from ..sources import catalogs
from .registry import Tables, check

INSTALL = """
manifest AS (SELECT p_type AS dir, p_partkey::VARCHAR AS local,
  CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice * 1000)::BIGINT END AS size FROM part),
installed AS (SELECT p_type AS dir, p_partkey::VARCHAR AS local,
  round(p_retailprice * 1000)::BIGINT + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 11 <> 0)"""


def manifest(t: Tables):
    return t.part.selectExpr(
        "p_type AS dir", "cast(p_partkey AS string) AS local",
        "CASE WHEN p_partkey % 17 <> 0 THEN cast(round(p_retailprice * 1000) AS bigint) END AS size")


@check("manifest_needed", f"""WITH {INSTALL}
SELECT dir, local, coalesce(m.size, 0) AS size, CASE WHEN i.local IS NULL THEN 'missing' ELSE 'outdated' END AS reason
FROM manifest m LEFT JOIN installed i USING (dir, local)
WHERE i.local IS NULL OR (m.size > 0 AND m.size <> i.size)""")
def _(t):
    installed = t.part.filter("p_partkey % 11 <> 0").selectExpr(
        "p_type AS dir", "cast(p_partkey AS string) AS local",
        "cast(round(p_retailprice * 1000) AS bigint) + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS size")
    return ops.manifest_needed(manifest(t), installed)


@check("manifest_audit", """
WITH m AS (SELECT p_type AS dir, p_partkey AS local, p_brand AS repo, p_partkey AS remote_file,
                  CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 10 + 1 ELSE 0 END AS size FROM part)
SELECT 'not in manifest' AS finding, count(*) AS n, NULL::BIGINT AS bytes FROM
  (SELECT DISTINCT l_partkey * 2 AS local FROM lineitem) r WHERE local NOT IN (SELECT local FROM m) HAVING count(*) > 0
UNION ALL
SELECT CASE WHEN size > 0 THEN 'full pack' ELSE 'unresolvable' END, count(*), sum(CASE WHEN size > 0 THEN size END)::BIGINT
FROM m GROUP BY size > 0""")
def _(t):
    m = t.part.selectExpr("p_type AS dir", "p_partkey AS local", "p_brand AS repo", "p_partkey AS remote_file")
    required = t.lineitem.selectExpr("l_partkey * 2 AS local").distinct().join(
        t.part.selectExpr("p_partkey AS local", "p_type AS dir"), "local", "left")
    remote = t.part.selectExpr(
        "p_brand AS repo", "p_partkey AS remote_file",
        "CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 10 + 1 ELSE 0 END AS size")
    return ops.manifest_audit(m, required, remote)


def _ledger_sql(ledger: str, ratchet: int) -> str:
    return f"""WITH f AS (SELECT DISTINCT l_partkey AS entry FROM lineitem), l AS ({ledger}),
c AS (SELECT count(f.entry) AS entry_points, count(*) FILTER (l.entry IS NULL) AS unlisted, count(*) FILTER (f.entry IS NULL) AS stale,
  count(*) FILTER (f.entry IS NOT NULL AND covered_by IS NOT NULL) AS covered FROM f FULL JOIN l ON f.entry = l.entry)
SELECT *, unlisted = 0 AND stale = 0 AND covered >= {ratchet} AS holds FROM c"""


_SHIFTED = "SELECT p_partkey + p_partkey % 3 AS entry, CASE WHEN p_size > 20 THEN p_name END AS covered_by FROM part"


@check("ledger_audit", _ledger_sql("SELECT entry, max(covered_by) AS covered_by FROM (" + _SHIFTED + ") GROUP BY 1", 1))
def _(t):
    found = t.lineitem.select(F.col("l_partkey").alias("entry")).distinct()
    ledger = t.part.selectExpr("p_partkey + p_partkey % 3 AS entry", "CASE WHEN p_size > 20 THEN p_name END AS covered_by").groupBy("entry").agg(
        F.max("covered_by").alias("covered_by"))
    return ops.ledger_audit(found, ledger, ratchet=1)


@check("ledger_audit_holds", _ledger_sql("SELECT l_partkey AS entry, max(l_returnflag) AS covered_by FROM lineitem GROUP BY 1", 10))
def _(t):
    found = t.lineitem.select(F.col("l_partkey").alias("entry")).distinct()
    return ops.ledger_audit(found, t.lineitem.groupBy(F.col("l_partkey").alias("entry")).agg(F.max("l_returnflag").alias("covered_by")), ratchet=10)


_SENTINELS = ", ".join(f"'{s}'" for s in ops.SENTINELS)


@check("integrity_check", f"""
WITH s AS (SELECT [{_SENTINELS}] AS all_names),
want AS (SELECT c_custkey AS host_id, unnest(all_names) AS path FROM customer, s),
have AS (SELECT o_custkey AS host_id, all_names[o_orderkey % 12 + 1] AS path FROM orders, s)
SELECT host_id, path FROM want ANTI JOIN have USING (host_id, path)""")
def _(t):
    names = F.array(*[F.lit(s) for s in ops.SENTINELS])
    files = t.orders.select(
        F.col("o_custkey").alias("host_id"),
        F.coalesce(F.try_element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int")), F.lit("README")).alias("path"))
    return ops.integrity_check(t.customer.select(F.col("c_custkey").alias("host_id")), files)


TREES = """
tree AS (SELECT DISTINCT l_suppkey AS host_id, ['custom_nodes', 'input', 'user', 'models'][l_linenumber % 4 + 1] AS folder,
   'item_' || (l_partkey % 97) AS name, l_returnflag AS f FROM lineitem),
o AS (SELECT DISTINCT host_id, folder, name FROM tree WHERE f <> 'A'),
n AS (SELECT DISTINCT host_id, folder, name FROM tree WHERE f = 'A' AND NOT (folder = 'user' AND host_id % 3 = 0)),
moved AS (SELECT o.*, (host_id, folder) NOT IN (SELECT (host_id, folder) FROM n) AS whole_folder FROM o ANTI JOIN n USING (host_id, folder, name)
          WHERE folder <> 'models')"""


def _trees(t: Tables):
    tree = t.lineitem.select(
        F.col("l_suppkey").alias("host_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("custom_nodes", "input", "user", "models")]), F.col("l_linenumber") % 4 + 1).alias("folder"),
        F.concat(F.lit("item_"), F.col("l_partkey") % 97).alias("name"), F.col("l_returnflag").alias("f"))
    old = tree.filter("f <> 'A'").drop("f").distinct()
    fresh = tree.filter("f = 'A' AND NOT (folder = 'user' AND host_id % 3 = 0)").drop("f").distinct()
    return old, fresh


@check("preserve_merge", f"""WITH {TREES}
SELECT host_id, folder, name, 'fresh' AS origin, false AS whole_folder FROM n
UNION ALL SELECT host_id, folder, name, 'old', whole_folder FROM moved""")
def _(t):
    return ops.preserve_merge(*_trees(t))


@check("preserve_merge_count", f"""WITH {TREES}
SELECT host_id, sum(n)::BIGINT AS carried FROM
 (SELECT host_id, folder, CASE WHEN bool_or(whole_folder) THEN 1 ELSE count(*) END AS n FROM moved GROUP BY ALL) GROUP BY host_id""")
def _(t):
    return ops.preserved_count(ops.preserve_merge(*_trees(t)))


@check("refresh_changed", """
WITH r AS (SELECT 'doc/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.md' END AS path,
  CASE WHEN doc_id % 3 = 0 THEN '{"n": ' || n_chars || CASE WHEN doc_id % 2 = 0 THEN '}' ELSE '' END ELSE text END AS data,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' END AS tail, doc_id FROM documents)
SELECT path, sha256(data) AS new_hash FROM r
WHERE (doc_id % 3 <> 0 OR doc_id % 2 = 0) AND (doc_id % 7 = 0 OR tail <> '')""")
def _(t):
    release = t.documents.select("doc_id", F.expr(
        "concat('doc/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.md' END)").alias("path"), F.expr(
        "CASE WHEN doc_id % 3 = 0 THEN concat('{\"n\": ', n_chars, CASE WHEN doc_id % 2 = 0 THEN '}' ELSE '' END) ELSE text END").alias("data"))
    installed = release.filter("doc_id % 7 <> 0").select("path", F.expr(
        "concat(data, CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' END)").alias("data"))
    return ops.refresh_changed(release.select("path", "data"), installed)


TAGS = "CASE WHEN p_partkey % 50 = 0 THEN 'nightly' ELSE 'v' || p_size % 3 || '.' || p_size || '.' || p_partkey % 10 END"


@check("version_compare", f"""
WITH t AS (SELECT p_partkey, {TAGS} AS tag FROM part),
v AS (SELECT *, list_transform(regexp_extract_all(tag, '\\d+'), lambda x: x::BIGINT) AS nums FROM t),
p AS (SELECT p_partkey, tag, [coalesce(nums[1], 0), coalesce(nums[2], 0), coalesce(nums[3], 0), coalesce(nums[4], 0)] AS ver FROM v)
SELECT p_partkey, tag, array_to_string(ver, '.') AS version, ver > [1, 25, 4, 0]::BIGINT[] AS newer,
  ver > [1, 25, 4, 0]::BIGINT[] AND tag <> 'v2.32.7' AS offered FROM p""")
def _(t):
    tags = t.part.select("p_partkey", F.expr(TAGS).alias("tag"))
    out = ops.version_compare(tags, current="1.25.4", skipped=("v2.32.7",))
    return out.withColumn("version", F.array_join(F.transform("version", lambda v: v["digits"]), "."))


SWEEPS = """
sweeps AS (SELECT p_partkey AS sweep, p_type AS project, CASE WHEN p_partkey % 9 <> 0 THEN 'run' END AS command,
   CASE WHEN p_size % 3 = 0 THEN NULL ELSE [p_brand || ' missing', 'Not On Path'] END AS nrw,
   CASE WHEN p_size % 2 = 0 THEN '{0} checks passed, {1} failed' END AS detail FROM part),
runs AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, min(l_partkey) AS sweep, (min(l_suppkey) % 3)::INT AS code, min(l_quantity)::INT AS q,
   sum(l_suppkey)::BIGINT % 5 AS z FROM lineitem GROUP BY l_orderkey, l_linenumber),
verdicts AS (SELECT run_id, sweep, project,
  CASE WHEN command IS NULL THEN 'NOT BUILT' WHEN nrw IS NOT NULL AND z = 0 THEN 'NOT RUN' WHEN code <> 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CASE WHEN command IS NULL THEN 'not written yet' WHEN nrw IS NOT NULL AND z = 0 THEN 'tool not on path here'
       WHEN code <> 0 THEN 'the sweep found something'
       WHEN detail IS NULL THEN 'passed' WHEN z IN (0, 1) THEN detail
       ELSE q || ' checks passed, ' || z || ' failed' END AS detail FROM runs JOIN sweeps USING (sweep))"""


def _verdicts(t: Tables):
    sweeps = t.part.select(
        F.col("p_partkey").alias("sweep"), F.expr("CASE WHEN p_partkey % 9 <> 0 THEN 'run' END").alias("command"),
        F.expr("CASE WHEN p_size % 3 <> 0 THEN array(concat(p_brand, ' missing'), 'Not On Path') END").alias("not_run_when"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN '{0} checks passed, {1} failed' END").alias("detail"),
        F.lit(r"(\d+) passed, (\d+) failed").alias("detail_pattern"),
        F.lit(None).cast("string").alias("on_failure"), F.lit(None).cast("string").alias("why"))
    runs = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("sweep"), (F.min("l_suppkey") % 3).cast("int").alias("code"),
        F.min("l_quantity").cast("int").alias("q"), (F.sum("l_suppkey") % 5).alias("z"))
    said = F.when(F.col("z") == 0, F.lit("start\n  tool not on path here \nend")).when(F.col("z") == 1, F.lit("done")).otherwise(
        F.concat(F.lit("ran\n"), "q", F.lit(" passed, "), "z", F.lit(" failed\n")))
    outcomes = runs.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), "sweep", "code", said.alias("said"))
    return ops.sweep_verdicts(sweeps, outcomes)


@check("sweep_verdicts", f"WITH {SWEEPS} SELECT run_id, sweep, verdict, detail FROM verdicts")
def _(t):
    return _verdicts(t)


@check("sweep_certification", f"""WITH {SWEEPS},
c AS (SELECT project, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed,
  count(*) FILTER (verdict = 'NOT RUN') AS not_run, count(*) FILTER (verdict = 'NOT BUILT') AS not_built FROM verdicts GROUP BY project)
SELECT *, CASE WHEN failed > 0 THEN 'NOT CERTIFIED' WHEN not_run + not_built > 0 THEN 'CERTIFIED as far as it was able to check'
  ELSE 'CERTIFIED' END AS certification FROM c""")
def _(t):
    named = _verdicts(t).join(t.part.select(F.col("p_partkey").alias("sweep"), F.col("p_type").alias("project")), "sweep")
    return ops.certification(named, "project")


@check("shallowest_wins", """
WITH f AS (SELECT l_suppkey AS host_id, 'n' || l_partkey % 50 AS name, l_orderkey % 6 AS depth,
  repeat('custom_nodes/', (l_orderkey % 6)::INT) || 'n' || l_partkey % 50 || '/' || l_orderkey AS path FROM lineitem)
SELECT host_id, name, arg_min(depth, (depth, path)) AS depth, arg_min(path, (depth, path)) AS path, count(*) AS copies,
  min(depth) > 0 AS rescued FROM f GROUP BY host_id, name""")
def _(t):
    files = t.lineitem.selectExpr(
        "l_suppkey AS host_id", "concat('n', l_partkey % 50) AS name", "l_orderkey % 6 AS depth",
        "concat(repeat('custom_nodes/', cast(l_orderkey % 6 AS int)), 'n', l_partkey % 50, '/', l_orderkey) AS path")
    return ops.shallowest_wins(files)


@check("src_presets", """
WITH x AS (SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS item_no, p_partkey, p_name, p_type, p_brand FROM part)
SELECT p_size, item_no::INT AS item_no, 'preset ' || p_partkey AS name, p_name || ', "' || p_type || '"' AS style,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS negative, p_name AS example, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS model_hint FROM x""")
def _(t):
    """Preset files, one for each size, written and read back."""
    item = F.struct(
        F.concat(F.lit("preset "), "p_partkey").alias("name"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("style"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("negative"), F.col("p_name").alias("example"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("model_hint"))
    lists = t.part.groupBy("p_size").agg(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("l"))
    path = fresh_path(t.spark, "presets")
    lists.select("p_size", F.to_json(F.struct(F.col("l.item").alias("presets"))).alias("value")).write.partitionBy("p_size").text(path)
    size = F.regexp_extract("host_id", r"p_size=(\d+)", 1).cast("int")
    return catalogs.read_presets(t.spark, path).withColumn("p_size", size).drop("host_id")


@check("src_manifest", """
WITH x AS (SELECT p_partkey, p_type, p_brand, p_name, unnest(range(p_size % 4 + 1)) AS i FROM part)
SELECT 'host/' || p_partkey AS host_id, i::INT AS item_no, p_type AS dir, p_name || '_' || i || '.safetensors' AS local,
  CASE WHEN i % 2 = 0 THEN p_brand END AS repo, CASE WHEN i % 2 = 0 THEN 'f' || i END AS remote_file,
  CASE WHEN i % 2 = 1 THEN 'https://example.org/' || p_partkey END AS url FROM x""")
def _(t):
    item = lambda i: F.struct(
        F.col("p_type").alias("dir"), F.concat("p_name", F.lit("_"), i, F.lit(".safetensors")).alias("local"),
        F.when(i % 2 == 0, F.col("p_brand")).alias("repo"), F.when(i % 2 == 0, F.concat(F.lit("f"), i)).alias("remote_file"),
        F.when(i % 2 == 1, F.concat(F.lit("https://example.org/"), "p_partkey")).alias("url"))
    raw = t.part.select(
        F.concat(F.lit("host/"), "p_partkey").alias("host_id"),
        F.to_json(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), item)).alias("value"))
    return catalogs.parse_lists(raw)
