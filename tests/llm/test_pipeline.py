"""The stages and run() of the pipeline against plain Python on a small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from weftline.llm import mix, near_texts, quality  # noqa: E402

R = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, size double, node string, `a.b` int"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def prose(n):
    return " ".join(f"w{R.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = [prose(R.randint(60, 160)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[3]) for i in range(4)] + [(7, texts[7])] + [(None, texts[9]), (None, prose(80))]  # exact copies, a repeated row, null ids
    near = texts[5].split(" ")
    for i in range(3):
        w = list(near)
        w[10 + i] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "too short"), (304, "again and again " * 60), (305, "# " * 90 + prose(60)), (306, prose(4000))]
    data = [(i, t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4], k, k % 2 == 0, "x", 1.5, "n", k) for k, (i, t) in enumerate(rows)]
    data.append(data[7])
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def good(text):
    w = words(text)
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w) >= 50 and 2 * len(covered) <= len(w)


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = docs.collect()

    kept = corpus_pipeline.quality_stage(spark, docs, corpus)
    assert kept.columns == docs.columns
    # too few labels for a cutoff: the base rules alone decide
    assert plain(kept.collect()) == plain(r for r in rows if good(r.text))

    unique = corpus_pipeline.near_dedup_stage(spark, kept, corpus)
    before, after = kept.collect(), unique.collect()
    assert unique.columns == docs.columns and not plain(after) - plain(before)
    code = {w: i for i, w in enumerate({w for r in before for w in words(r.text)})}
    coded = [np.array([code[w] for w in words(r.text)]) for r in before]
    group = list(range(len(before)))
    for j in range(len(before)):
        for i in range(j):
            if group[i] != group[j] and (before[i].text == before[j].text or near_texts.similar(coded[i], coded[j], 0.8)):
                group = [group[i] if g == group[j] else g for g in group]
    group_of = {r.text: g for r, g in zip(before, group, strict=True)}
    assert Counter(group_of[r.text] for r in after) == Counter(set(group))

    mixed = corpus_pipeline.mixing_stage(spark, unique, corpus)
    assert mixed.columns == docs.columns
    times, out = Counter(tuple(r) for r in mixed.collect()), plain(after)
    assert not set(times) - set(out) and all(n <= mix.EPOCHS * out[r] for r, n in times.items())
    target = {r.source: r.target for r in mix.mix_plan(unique).collect()}
    for source, want in target.items():  # a document at the cut is taken or left whole
        longest = max(len(words(r.text)) for r in after if r.source == source)
        taken = sum(n * len(words(r[1])) for r, n in times.items() if r[3] == source)
        assert abs(taken - want) <= longest / 2 + 2 * mix.PACKET


def test_run(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got, place = Counter(), 0
    for r in sorted(corpus_pipeline.run(spark, corpus).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == place and zlib.crc32(r.ids) == r.ids_crc32
        place += r.length
        got[r.doc_id] += r.length
    assert got == want


def test_empty_table(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_columns_that_clash_with_features(spark):
    docs = spark.createDataFrame([(1, "x " * 60, "en", 5, False)], "doc_id long, text string, lang string, n_words int, kept boolean")
    (row,) = quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert row.document_n_words == 5 and row.document_kept is False and row.n_words == 60 and row.base_failed
