"""Catalogues and file inventories of many installs: what is missing, stale, newer or broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: files an install cannot start without
SENTINELS = (
    "main.py", "nodes.py", "server.py", "execution.py", "folder_paths.py", "comfy/options.py",
    "comfy/model_management.py", "comfy/samplers.py", "comfy/sd.py", "comfy_extras/nodes_upscale_model.py",
)
# fixed values: folders an update carries across
PRESERVED = ("custom_nodes", "input", "user")
# fixed values: verdicts of a sweep
PASS, FAIL, NOT_RUN, NOT_BUILT = "PASS", "FAIL", "NOT RUN", "NOT BUILT"


def manifest_needed(manifest: DataFrame, installed: DataFrame, keys: tuple[str, ...] = ("dir", "local")) -> DataFrame:
    """Manifest entries not installed, or installed with another size. An unknown size counts as current.

    ``keys`` may hold a host column when both sides list many installs.
    """
    have = installed.select(*keys, F.col("size").alias("have_size"), F.lit(True).alias("there"))
    size = F.col("size")
    return (
        manifest.join(have, list(keys), "left")
        .withColumn("reason", F.when(F.col("there").isNull(), "missing").when((size > 0) & (size != F.col("have_size")), "outdated"))
        .filter("reason IS NOT NULL")
        .withColumn("size", F.coalesce(size, F.lit(0).cast("long")))
        .drop("there", "have_size")
    )


def manifest_audit(manifest: DataFrame, required: DataFrame, remote: DataFrame) -> DataFrame:
    """(finding, n, bytes): required files not in the manifest, entries no remote has, the full pack."""
    missing = required.join(manifest, ["dir", "local"], "left_anti").select(
        F.lit("not in manifest").alias("finding"), F.lit(None).cast("long").alias("bytes"))
    sized = manifest.join(remote.filter("size > 0"), ["repo", "remote_file"], "left").select(
        F.when(F.col("size").isNull(), "unresolvable").otherwise("full pack").alias("finding"),
        F.col("size").alias("bytes"))
    return missing.unionByName(sized).groupBy("finding").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def ledger_audit(found: DataFrame, ledger: DataFrame, ratchet: int) -> DataFrame:
    """One row: entry points in neither state, ledger keys that name nothing, and the covered count."""
    both = (
        found.select("entry", F.lit(1).alias("f")).join(
            ledger.select("entry", "covered_by", F.lit(1).alias("l")), "entry", "full_outer")
    )
    unlisted = F.count_if(F.col("l").isNull())
    stale = F.count_if(F.col("f").isNull())
    covered = F.count_if(F.col("f").isNotNull() & F.col("covered_by").isNotNull())
    return both.agg(
        F.count_if(F.col("f").isNotNull()).alias("entry_points"), unlisted.alias("unlisted"),
        stale.alias("stale"), covered.alias("covered"),
        ((unlisted == 0) & (stale == 0) & (covered >= ratchet)).alias("holds"),
    )


def integrity_check(hosts: DataFrame, files: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(host_id, path) of every sentinel an install lacks; a host without files lacks them all.

    The fixed list is exploded inside each host's row, so nothing is joined to make the expectation,
    and only sentinel rows of the inventory are shuffled.
    """
    expected = hosts.select("host_id", F.explode(F.array(*[F.lit(s) for s in sentinels])).alias("path"))
    return expected.join(files.filter(F.col("path").isin(*sentinels)), ["host_id", "path"], "left_anti")


def preserve_merge(old: DataFrame, fresh: DataFrame, folders: tuple[str, ...] = PRESERVED) -> DataFrame:
    """A fresh tree with an old one's user folders carried across; the fresh copy of a name wins.

    Both have (host_id, folder, name). ``origin`` tells where a row comes from. A row that came from a
    folder the fresh tree lacks has ``whole_folder`` set: the folder moves as one item.
    """
    carried = old.filter(F.col("folder").isin(*folders)).join(fresh, ["host_id", "folder", "name"], "left_anti")
    present = fresh.groupBy("host_id", "folder").agg(F.lit(True).alias("present"))
    moved = carried.join(present, ["host_id", "folder"], "left").select(
        "host_id", "folder", "name", F.lit("old").alias("origin"), F.col("present").isNull().alias("whole_folder"))
    return fresh.select(
        "host_id", "folder", "name", F.lit("fresh").alias("origin"), F.lit(False).alias("whole_folder")
    ).unionByName(moved)


def preserved_count(merged: DataFrame) -> DataFrame:
    """Items that came across per host; a folder moved whole is one item."""
    per_folder = merged.filter("origin = 'old'").groupBy("host_id", "folder").agg(
        F.when(F.bool_or("whole_folder"), 1).otherwise(F.count("*")).cast("long").alias("n"))
    return per_folder.groupBy("host_id").agg(F.sum("n").alias("carried"))


def refresh_changed(release: DataFrame, installed: DataFrame) -> DataFrame:
    """Release files whose bytes differ from the installed ones; broken JSON never replaces anything.

    Hashes, not contents, go through the join.
    """
    new = release.filter(~F.col("path").endswith(".json") | F.try_parse_json("data").isNotNull()).select(
        "path", F.sha2("data", 256).alias("new_hash"))
    old = installed.select("path", F.sha2("data", 256).alias("old_hash"))
    return new.join(old, "path", "left").filter(~F.col("new_hash").eqNullSafe(F.col("old_hash"))).select("path", "new_hash")


def version_tuple(tag: Column) -> Column:
    """The first four whole numbers of a tag, zero-padded: comparable, and lowest for garbage.

    A number is (how many digits, the digits) without leading zeros, so it may be as long as it likes.
    """
    found = F.slice(F.regexp_extract_all(F.coalesce(tag, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), 1, 4)
    four = F.slice(F.concat(found, F.array_repeat(F.lit("0"), 4)), 1, 4)
    bare = F.transform(four, lambda d: F.regexp_replace(d, "^0+(?=.)", ""))
    return F.transform(bare, lambda d: F.struct(F.length(d).alias("size"), d.alias("digits")))


def version_compare(tags: DataFrame, current: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``version``, ``newer`` than the running one and whether it is ``offered``."""
    newer = F.col("version") > version_tuple(F.lit(current))
    return tags.withColumn("version", version_tuple(F.col("tag"))).withColumn("newer", newer).withColumn(
        "offered", F.col("newer") & ~F.col("tag").isin(*skipped) if skipped else F.col("newer"))


def newest_offer(compared: DataFrame, *by: str) -> DataFrame:
    """The highest offered tag per group."""
    return compared.filter("offered").groupBy(*by).agg(F.max_by("tag", F.struct("version", "tag")).alias("tag"))


def _filled(sentence: str, said: str, pattern: str) -> Column:
    """A sentence with its places filled from a pattern's groups, or null where a place has no group.

    Places are ``{0}``, ``{1}``, any number of them, or ``{}`` counted from the left, not both; ``{{`` and ``}}`` are braces.
    """
    groups = F.regexp_count(pattern, F.lit(r"(?<!\\)\((?!\?)"))
    parts = F.regexp_extract_all(F.col(sentence), F.lit(r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"), F.lit(1))
    counted, named = F.exists(parts, lambda p: p == "{}"), F.exists(parts, lambda p: p.rlike(r"^\{\d+\}$"))
    sound = F.forall(parts, lambda p: p.rlike(r"^(\{\{|\}\}|\{\d{0,9}\}|[^{}]+)$")) & ~(counted & named)

    def place(p: Column, i: Column) -> Column:
        auto = F.size(F.filter(F.slice(parts, 1, i), lambda q: q == "{}"))
        return F.coalesce(F.regexp_extract(p, r"^\{(\d+)\}$", 1).try_cast("int"), auto)

    is_place = lambda p: p.rlike(r"^\{\d*\}$")
    reached = F.array_max(F.transform(parts, lambda p, i: F.when(is_place(p), place(p, i)).otherwise(-1)))
    write = F.transform(parts, lambda p, i: F.when(p.isin("{{", "}}"), F.substring(p, 1, 1)).when(
        is_place(p), F.call_function("regexp_extract", F.col(said), F.col(pattern), F.least(place(p, i) + 1, groups))).otherwise(p))
    return F.when(sound & (F.coalesce(reached, F.lit(-1)) < groups), F.array_join(write, ""))


def sweep_verdicts(sweeps: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A verdict and a sentence per sweep outcome.

    The first rule that holds decides: no command, a phrase that means the machine cannot host the sweep, a non-zero
    code, success. ``sweeps`` is a declaration list; ``outcomes`` has one row per run.
    """
    said, low = F.col("said"), F.lower("said")
    hits = F.filter(F.coalesce("not_run_when", F.array().cast("array<string>")), lambda p: F.contains(low, F.lower(p)))
    phrase = F.try_element_at(hits, F.lit(1))
    line = F.try_element_at(
        F.filter(F.transform(F.split("said", "\\r?\\n"), lambda s: F.trim(s)), lambda s: F.contains(F.lower(s), F.lower(phrase))),
        F.lit(1))
    detail = F.coalesce("detail", F.lit("passed"))
    matched = F.col("detail_pattern").isNotNull() & F.expr("regexp_like(said, detail_pattern)")
    text = F.when(matched, F.coalesce(_filled("_detail", "said", "detail_pattern"), detail)).otherwise(detail)
    verdict = (
        F.when(F.col("command").isNull(), NOT_BUILT).when(phrase.isNotNull(), NOT_RUN)
        .when(F.col("code") != 0, FAIL).otherwise(PASS)
    )
    sentence = (
        F.when(F.col("command").isNull(), F.coalesce("why", F.lit("not written yet")))
        .when(phrase.isNotNull(), F.coalesce(line, phrase))
        .when(F.col("code") != 0, F.coalesce("on_failure", F.lit("the sweep found something")))
        .otherwise(text)
    )
    return outcomes.join(sweeps, "sweep", "left").withColumn("_detail", detail).select(
        "run_id", "sweep", verdict.alias("verdict"), sentence.alias("detail"))


def certification(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts of each verdict and the line they add up to; the four are never averaged."""
    n = {name: F.count_if(F.col("verdict") == v) for name, v in
         (("passed", PASS), ("failed", FAIL), ("not_run", NOT_RUN), ("not_built", NOT_BUILT))}
    line = (
        F.when(F.col("failed") > 0, "NOT CERTIFIED")
        .when(F.col("not_run") + F.col("not_built") > 0, "CERTIFIED as far as it was able to check")
        .otherwise("CERTIFIED")
    )
    return verdicts.groupBy(*by).agg(*[c.alias(k) for k, c in n.items()]).withColumn("certification", line)


def shallowest_wins(files: DataFrame) -> DataFrame:
    """Of nested copies of one name the shallowest stays; ``rescued`` marks one that was buried."""
    kept = files.groupBy("host_id", "name").agg(
        F.min_by(F.struct("depth", "path"), F.struct("depth", "path")).alias("w"), F.count("*").alias("copies"))
    return kept.select("host_id", "name", "w.depth", "w.path", "copies", (F.col("w.depth") > 0).alias("rescued"))
