"""The trigram index against a scan of all texts."""

import random

import pytest

from weftline.operators import grams, search


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "License", "naïve", "日本語", "x", "a.b", "foo(bar)"]
    rows = [(i, " ".join(r.choices(words[:3] if i % 7 else words, k=r.randint(0, 9)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "al"), (5, "License"), (5, "License")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(docs):
    return grams.build_index(docs, "doc_id", "text")


@pytest.mark.parametrize("literal", ["License", "日本語", "al", "", "foo(bar)", "ma Lic", "nothing", "ïve"])
def test_literals(docs, index, literal):
    want = sorted(r.doc_id for r in search.exact(docs, "text", literal).collect())
    assert sorted(r.key for r in grams.search(index, literal).collect()) == want


@pytest.mark.parametrize("regex", ["Lic.nse", "(?i)license", "gam+a Li", "(beta )+License", "foo\\(bar\\)$", "alpha|License", "^$", "[Ll]icense x?", "\\bbeta\\b", "(alpha){2,}x", "nai?\\u00efve", "(?<n>beta) x", "\\0114icense"])
def test_patterns(docs, index, regex):
    want = sorted(r.doc_id for r in search.exact(docs, "text", regex=regex).collect())
    assert sorted(r.key for r in grams.search(index, regex=regex).collect()) == want


def test_few_texts_are_tried(docs, index):
    matching = search.exact(docs, "text", "License").count()
    assert grams.candidates(index, grams.needed("License", None)).count() == matching < docs.count() / 5


def test_no_texts(spark):
    empty = grams.build_index(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert grams.search(empty, "License").collect() == [] and grams.search(empty, "").collect() == []
