"""The pipeline's stages against brute force on a small folder of tables."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import labelled, positive, queries, subword

from .test_jaccard import brute as groups
from .test_winnow import brute as windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_classifier_stages_keep_what_their_model_keeps(spark, stages):
    labels = queries.table(spark, SF, "labels")
    for (before, after), scores, keep in ((stages[0], subword.quality_scores, F.col("score") >= 0.3), (stages[1], positive.toxicity_scores, F.col("score") < 0.5)):
        assert ids(after) == ids(scores(before, labels).filter(keep))
        assert after.dtypes == before.dtypes
    # 200 rows hold too few toxic examples to learn every toxic word from; poor quality is learned even here
    poor = stages[0][0].join(labels.filter("quality = 0").filter(~labelled.held_out()), "doc_id", "left_semi")
    assert len(ids(poor) & ids(stages[0][1])) <= 0.2 * len(ids(poor))


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == {c for _, c in groups(rows, 5, 80).values()} and after.dtypes == before.dtypes


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    found = windows([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert ids(after) == {d for d, (_, hit, _) in found.items() if not hit} and after.dtypes == before.dtypes


def test_null_and_repeated_ids_are_judged_by_row(spark, tmp_path):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    near = long[1] + " more"
    item = queries.table(spark, SF, "benchmark").filter("length(text) > 100").first()["text"]
    rows = [(None, long[0], "0"), (None, long[0], "1"), (5, long[0], "2"), (6, long[1], "3"), (6, near, "4"), (6, long[2], "5"), (7, long[2], "6"), (7, long[3], "7"),
            (None, long[4], "8"), (None, long[4], "9"), (8, long[5], "a"), (8, long[5], "b"), (None, None, "c"), (None, "", "d"), (9, None, "e"), (9, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    df.repartition(3).write.parquet(str(tmp_path / "a"))
    for given in (df, spark.read.parquet(str(tmp_path / "a"))):
        left = corpus_pipeline.deduplicate(spark, given, SF)
        tags = {r["tag"] for r in left.collect()}
        # of each group the smallest id stays, one row of it; wordless rows are alone
        assert {x for x in tags if x in "257"} == {"2", "5", "7"} and not tags & set("016")
        assert [len(tags & set(x)) for x in ("34", "89", "ab")] == [1, 1, 1] and set("cdef") <= tags and len(tags) == 10
        assert left.dtypes == df.dtypes and left.count() == 10
    bad = "before it " + item + " and after it"
    rows = [(None, bad, "0"), (None, long[0], "1"), (1, bad, "2"), (1, long[1], "3"), (2, long[2], "4"), (2, long[2], "5"), (None, None, "6")]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, tag string"), SF)
    assert sorted(r["tag"] for r in left.collect()) == ["1", "3", "4", "5", "6"]


def test_all_tokens_are_packed(stages):
    before, after = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths, seqs = defaultdict(int), defaultdict(list)
    for r in after.collect():
        lengths[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert lengths == {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False)) + 1 for r in before.collect()}
    for parts in seqs.values():
        parts.sort()
        assert np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1] == [o for o, _ in parts] and sum(n for _, n in parts) <= 2048


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


CLASHES = ("_row", "_file", "_index", "_number", "_hash0", "held", "h", "id", "n", "score", "_metadata", "component_id", "rank", "piece", "ids")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_columns_of_other_uses_empty_tables_and_very_long_texts(spark, tmp_path, name, stage):
    rnd = np.random.default_rng(2)
    long = " ".join(f"w{i}" for i in rnd.integers(0, 50_000, 120_000))
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", None, 1), (3, "", None, None, None), (None, None, "en", "s", 0), (3, "few words here", "en", "s", 1), (3, "few words here", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain, odd, none = (str(tmp_path / x) for x in ("plain", "odd", "none"))
    df = spark.createDataFrame(rows, schema)
    df.repartition(2).write.parquet(plain)
    df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(2).write.parquet(odd)
    df.limit(0).write.parquet(none)
    wanted, empty = stage(spark, spark.read.parquet(plain), SF), stage(spark, spark.read.parquet(none), SF)
    got = stage(spark, spark.read.parquet(odd), SF)
    if name != "pack":
        assert got.columns == [*df.columns, *CLASHES]
        got = got.select(df.columns)
        assert empty.dtypes == df.dtypes
    drop = ["sequence_id", "offset"] if name == "pack" else []
    rows_kept = wanted.drop(*drop).collect()
    assert sorted(map(str, got.drop(*drop).collect())) == sorted(map(str, rows_kept))
    assert empty.count() == 0
    if name == "deduplicate":
        assert sorted(str(r["doc_id"]) for r in rows_kept) == ["1", "3", "3", "None"]
