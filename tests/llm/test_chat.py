"""The template language, and conversations there and back."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import chat
from pagewright.llm.template import Const, Emit, TemplateError, compiled, fold, parse

HARD = st.lists(st.sampled_from([*"[]/<>\\sINSTOUROLEND \n", "[INST]", "</s>", "[/ROLE]", " [/INST]", "é"]), max_size=20).map("".join)


@pytest.mark.parametrize("source, names, want", [
    ("a{{ x }}b", {"x": 3}, "a3b"), ("{{ x.y }}{{ x['y'] }}{{ x.z }}", {"x": {"y": "k"}}, "kk"), ("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", {"x": 2}, "two"),
    ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"), ("{{ 'a' ~ 1 ~ none ~ true }}", {}, "a1true"),
    ("x  {%- if true -%}  y  {%- endif %} z", {}, "xy z"), ("{% set k = 'v' | upper %}{{ k }}", {}, "V"), ("{{ 'b' in 'abc' and 2 or 3 }}", {}, "2"),
    ('{{ "q\\"\\n" }}', {}, 'q"\n'), ("{{ (x or 'd') | trim }}", {"x": ""}, "d"), ("{{ xs | length }}{{ xs[1] }}", {"xs": ["p", "q"]}, "2q"),
])
def test_templates_render(source, names, want):
    assert compiled(source)(names)[0] == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% endif %}", "{{ }}", "{{ f(x) }}", "{{ x.__class__ }}", "{{ x | nope }}", "{{ 1 + 2 }}", "{{ unknown }}", "{% for i in 'ab' %}{% endfor %}", "{{ xs }}"])
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compiled(source)({"x": "text", "xs": [1]})


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{{ 'e' if_ }}".replace(" if_", ""), {}), {})
    assert tree == (Emit(Const("abcde")),)


def test_marks_follow_characters():
    text, spans = compiled("é{% generation %}{{ x }}{% endgeneration %}|{% generation %}z{% endgeneration %}")({"x": "日本"})
    assert (text, [text[a:b] for a, b in spans]) == ("é日本|z", ["日本", "z"])


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), HARD), HARD), max_size=6))
@settings(max_examples=150, deadline=None)
def test_every_conversation_reads_back(turns):
    text, spans = compiled(chat.TEMPLATE, {"escape": chat.escape})({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_tables_read_back(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 4), rnd.randint(0, 9), rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", "a\\[INST]", "b\n[END]"])) for _ in range(60)]
    rows += [(None, 1, "user", "lone"), (7, None, "assistant", "first"), (7, 0, "user", "second"), (8, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("spans", "turns", "loss")})
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        want[c] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    assert all(r["loss"] == [t for role, t in want[c] if role == "assistant"] for c, r in got.items())
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_digests_of_the_query(spark):
    from pagewright.llm.queries import QUERIES

    row = QUERIES["op4_chat_formatting"](spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    hard = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())
