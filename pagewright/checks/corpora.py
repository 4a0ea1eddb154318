"""Whole-corpus jobs over the sheets."""

from __future__ import annotations


from ..plans import corpus
from ..session import cut
from .registry import check
from .sheets import line_sums, sheet_pixels


@check("clean_corpus")
def _(t):
    return line_sums(corpus.clean_corpus(sheet_pixels(t)), "r", "g", "b", "a")


@check("clean_corpus_kinds")
def _(t):
    p = sheet_pixels(t)
    backing = cut(corpus.page_backing(p))
    return line_sums(corpus.clean_corpus(p, backing, corpus.page_kinds(p, backing)), "r", "g", "b", "a")


@check("assess_corpus")
def _(t):
    return corpus.assess_corpus(sheet_pixels(t), gap=4)


@check("census_corpus")
def _(t):
    # one page in nine lost its last line
    p = sheet_pixels(t).filter("NOT (page_id % 9 = 4 AND y = height - 1)")
    return corpus.census_corpus(p)
