"""Counts, ids and places against the tokenizers themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "  ", "\n", " \n", "\n ", "a", " a", "a  b", "a \n b", "a\n\nb", "a\t\tb ", "it's  we'll\n'd x", "  lead", "trail  ", "x<|endoftext|>y",
    "x  <|endoftext|>  y", "<|endoftext|>", "<|startoftext|> a", "nb sp", "a  b", "　x", "a\x1fb \x1c c", "a\x85b", "\r\n\r\nq", "日本 語 text", "é é É",
    "1234 12a3", "!!! ??", "ΑΣ ΟΔΟΣ. Σ", "😀 x😀", "\x0b\x0c a", "tab\tword " * 40, "long " * 3000, "x" * 5000,
]
ANY = st.lists(st.text(alphabet="aB '\n\t  é<|>sx1.", max_size=25), min_size=1, max_size=6)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({c: F.lit(0) for c in ("n_tokens", "ids", "length", "h")}).cache()


def test_counts_are_the_tokenizers(rows):
    tok = Tokenizer.from_file(BYTES)
    want = {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(rows, BYTES).collect()} == want


@given(ANY)
@settings(max_examples=60, deadline=None)
def test_chunks_never_change_a_count(texts):
    import pyarrow as pa

    from pagewright.llm.words import space_separated, text_blocks

    tok = Tokenizer.from_file(BYTES)
    for _, data, bounds in text_blocks(pa.array(texts)):
        s, e, owner = tokens.byte_chunks(data, bounds, space_separated())
        odd = tokens.odd_texts(data, bounds)
        for i, t in enumerate(texts):
            mine = sorted((int(a), int(b)) for a, b, o in zip(s, e, owner) if o == i)
            assert b"".join(data[a:b].tobytes() for a, b in mine) == t.encode()
            if not odd[i]:
                assert sum(len(tok.encode(data[a:b].tobytes().decode(), add_special_tokens=False)) for a, b in mine) == len(tok.encode(t, add_special_tokens=False))


def test_a_full_cache_starts_anew(rows, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    tok = Tokenizer.from_file(WORDS)
    words = tokens.WordIds(WORDS)
    for t in ("a b c d e", "d e f", "a z"):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert words.ids(raw, np.array([0, len(raw)]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids + [0]


@given(st.lists(st.text(alphabet="aB '\n\té<|>.,:!?)(1SĀ\u0301İΣ", max_size=25) | st.sampled_from(["x<|startoftext|>Y.", "<|STARTOFTEXT|>", "it's, IT'S. a.'s"]), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_never_change_the_ids(texts):
    import pyarrow as pa

    from pagewright.llm.words import text_blocks

    words = test_words_never_change_the_ids.words = getattr(test_words_never_change_the_ids, "words", None) or tokens.WordIds(WORDS)
    for _, data, bounds in text_blocks(pa.array(texts)):
        flat, size = words.ids(data, bounds)
        cuts = np.concatenate([[0], np.cumsum(size)])
        assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [words.tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_pieces_and_places(rows):
    tok = Tokenizer.from_file(WORDS)
    cap = 64
    got = packing.pack(packing.pieces(rows, WORDS, cap).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"), "ids"), cap).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [(k, s, len(ids[s:s + cap])) for k, s in enumerate(range(0, len(ids), cap))]
        assert [x for r in parts for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(zlib.crc32(bytes(r["ids"])) == r["crc"] for r in parts)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(none, BYTES).count() == 0
    assert packing.pack(packing.pieces(none, WORDS)).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=15))
@settings(max_examples=60, deadline=None)
def test_plans_hold_every_piece_once(histogram):
    patterns, least = packing.bounded_plan(histogram, 40)
    assert least <= sum(c for _, c in patterns)
    held = defaultdict(int)
    for pattern, copies in patterns:
        assert copies > 0 and sum(x * n for x, n in pattern.items()) <= 40
        for x, n in pattern.items():
            held[x] += n * copies
    assert held == histogram
    # never more than first-fit would need at worst, and never fewer than the tokens allow
    total = sum(x * n for x, n in histogram.items())
    assert -(-total // 40) <= sum(c for _, c in patterns) <= 2 * -(-total // 40)
    places, seen = packing.Places(patterns, 40), set()
    for length, n in histogram.items():
        seq, offset = places.of(np.full(n, length), np.arange(n))
        spots = {(s, o + i) for s, o in zip(seq.tolist(), offset.tolist()) for i in range(length)}
        assert len(spots) == n * length and not spots & seen
        seen |= spots


def test_pricing_is_the_best_multiset():
    rng = np.random.default_rng(1)
    for _ in range(20):
        price = np.where(rng.random(13) < 0.5, rng.random(13) * np.arange(13), 0.0)
        price[0] = 0
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1], *(best[c - x] + price[x] for x in range(1, c + 1) if price[x] > 0)])
        taken = packing.best_pattern(price, 12)
        assert (taken * np.arange(13)).sum() <= 12 and abs((taken * price).sum() - best[12]) < 1e-9


def test_dual_bound_meets_the_best_packing():
    assert packing.bounded_plan({6: 10, 4: 10}, 10)[1] == 10 == sum(c for _, c in packing.plan({6: 10, 4: 10}, 10))
    assert packing.bounded_plan({6: 10}, 10)[1] == 10  # two do not fit: the bound knows, the sum of lengths does not
    rnd = np.random.default_rng(3)
    many = {int(x): int(n) for x, n in zip(*np.unique(rnd.integers(1, 500, 4000), return_counts=True))}
    patterns, least = packing.bounded_plan(many, 512)
    assert least <= sum(c for _, c in patterns) <= 1.02 * least


def test_frequent_chunks_are_those_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SKETCH", 40)
    monkeypatch.setattr(tokens, "FREQUENT", 8)
    rnd = np.random.default_rng(4)
    often = [f"often{i}" for i in range(8)]
    texts = [" ".join(["first only"] * 3)] * 5 + [" ".join([*(f"w{x}" for x in rnd.integers(0, 10**9, 60)), *often, "x" * 5000]) for _ in range(200)]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(3)
    hashes, lengths = tokens.frequent_lengths(docs, BYTES)
    hasher, tok = tokens.SpanHash(3), Tokenizer.from_file(BYTES)
    want = {}
    for w in often:
        raw = np.frombuffer(f" {w}".encode(), np.uint8)
        want[int(hasher.of(hasher.sums(raw), np.array([0]), np.array([len(raw)]))[0])] = len(tok.encode(f" {w}", add_special_tokens=False).ids)
    assert dict(zip(hashes.tolist(), lengths.tolist())) == want
