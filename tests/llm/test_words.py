"""Word spans and hashes equal plain regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm.words import SpanHash, grams, letters_and_digits, lower_table, space_separated, spans, text_blocks

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZ9é \n\t\x0b-_|日", max_size=30)), max_size=8)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_words_equal_the_expression(texts, block):
    for table, rule in ((space_separated(), r"[^\x20\x09-\x0D]+"), (letters_and_digits(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = [[] for _ in texts]
        for row, data, bounds in text_blocks(pa.array(texts, pa.string()), block):
            low = lower_table()[data]
            s, e, text = spans(low, bounds, table)
            for a, b, t in zip(s, e, text):
                got[row + t].append(low[a:b].tobytes().decode())
        assert got == [re.findall(rule, lowered(t)) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    column = pa.array(["one two", None, "", "xx two one", "two"])
    hasher, found = SpanHash(), {}
    for size in (1, 5, 1000):
        for _, data, bounds in text_blocks(column, size):
            s, e, _ = spans(data, bounds, space_separated())
            for h, a, b in zip(hasher.of(hasher.sums(data), s, e).tolist(), s, e):
                found.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == 3


def test_grams_stay_inside_a_text():
    words = np.arange(10, dtype=np.uint64)
    _, at = grams(words, np.array([0, 0, 0, 1, 1, 1, 1, 2, 2, 3]), 3)
    assert at.tolist() == [0, 3, 4]
