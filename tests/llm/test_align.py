"""Alignment of two tokenizers against whole texts that the tokenizers' own libraries encode."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tokenizers import Tokenizer
from weftline.llm import align
from weftline.llm.token_count import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the cat sat on the mat", None, "", " ", "   ", "\n", "a", " leading", "trailing ", "two  spaces  and\ttabs \n lines\n\n end\n",
    "naïve café über Straße ñandú", "中文字符 混合 text", "emoji 😀😀 and ﬁ ligature", "a▁b has a mark", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "x" * 3000, "word " * 500, "a b  c　d", "1234567890 3.14159 1,000", "it's WE'LL don't", "\x00\x01 control", "the cat sat on the mat", "é combining", "\u001c x \u001c y",
]


def groups(text, a, b):
    """(end, A's ids, B's ids) of each group, by the sets of ends of whole-text encodings."""
    symbols = byte_symbols()
    one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    first = [bytes(symbols[c] for c in a.id_to_token(i)) for i in one]
    second = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
    whole = (" " + text).encode()
    if not text or b"".join(first) != whole or b"".join(second) != whole:
        return []
    ends = lambda tokens: [sum(map(len, tokens[: i + 1])) for i in range(len(tokens))] if len(tokens) < 2000 else list(__import__("itertools").accumulate(map(len, tokens)))
    e1, e2 = ends(first), ends(second)
    out, i, j = [], 0, 0
    for end in sorted(set(e1) & set(e2)):
        x = [t for t, e in zip(one[i:], e1[i:]) if e <= end]
        y = [t for t, e in zip(two[j:], e2[j:]) if e <= end]
        out.append((end, x, y))
        i, j = i + len(x), j + len(y)
    return out


def expected(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found = [(i, groups(t or "", a, b)) for i, t in rows]
    links = [(i, g, Counter((x, y) for _, xs, ys in g for x in xs for y in ys)) for i, g in found]
    counts = Counter(k for _, _, c in links for k in c)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, g, c in links:
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, x, y in g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for _, x, _ in g), sum(len(y) for _, _, y in g), len(g), c.total(), sum(n for k, n in c.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in c.items()), digest))
    return Counter(out)


def test_edge_texts(spark):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (0, "the cat sat on the mat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("clash"), "block": F.lit(1), "pair": F.lit(2)}).repartition(3)
    got = align.align_tokens(docs, A, B)
    assert Counter(map(tuple, got.collect())) == expected(rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, align.align_tokens(docs.repartition(5), A, B).collect())) == expected([tuple(r) for r in docs.collect()])


def test_small_blocks_and_a_forgetful_worker(spark, monkeypatch):
    """Blocks of a few texts and a memory of no parts change nothing: the functions are called here, without workers."""
    import pyarrow as pa

    parts = align.Parts(align.pair_of(A, B))
    whole, each = align.Block(parts), []
    whole.add(list(range(len(TEXTS))), TEXTS)
    for i, t in enumerate(TEXTS):
        block = align.Block(align.Parts(align.pair_of(A, B)))
        block.add([i], [t])
        each += block.rows
        block.packed(i, pa.int64())
    assert whole.rows == each
    monkeypatch.setattr(align, "LARGE", 0)
    counted = align.Block(align.Parts(align.pair_of(A, B)))
    counted.add(list(range(len(TEXTS))), TEXTS)
    assert counted.rows == whole.rows


def test_groups_of_texts(spark):
    rows = [r for r in enumerate(TEXTS) if r[1] != "x" * 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    want = Counter((i, g[0], tuple(g[1]), tuple(g[2])) for i, t in rows for g in groups(t or "", a, b))
    got = Counter((r.doc_id, r.end, tuple(r.a_ids), tuple(r.b_ids)) for r in align.token_groups(docs, A, B).collect())
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokens(docs, A, B).collect() == []
    assert align.token_groups(docs, A, B).collect() == []


@pytest.mark.parametrize("text", ["a b", "über  x", "▁"])
def test_parts_join_to_the_text(text):
    assert "".join(align.pair_of(A, B).parts(text)) == " " + text


def test_a_task_holds_few_blocks_at_a_time(spark, monkeypatch):
    """Blocks are rows of some MB each, and Parquet by itself looks at sizes after 100 rows only."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    def blocks(docs, a, b):
        block = align.Block(align.Parts(align.pair_of(A, B)))
        block.add([1], ["the cat"])
        row = block.packed(0, pa.int64())
        names, kinds = row.schema.names, ["long", "binary", "binary", "array<long>", "binary", "array<string>", *["binary"] * 6]

        def large(batches):
            for i in (i for x in batches for i in x["id"].to_pylist()):
                own = {"block": pa.array([i]), "digests": pa.array([[os.urandom(1_500_000).hex()]])}
                yield pa.RecordBatch.from_arrays([own.get(n, row[n]) for n in names], names)

        return spark.range(0, 40, 1, 1).mapInArrow(large, ", ".join(map(" ".join, zip(names, kinds, strict=True))))

    def saved(df, name, **more):
        tables[name] = real(df, name, **more)
        return tables[name]

    tables, real = {}, align.saved
    monkeypatch.setattr(align, "_blocks", blocks)
    monkeypatch.setattr(align, "saved", saved)
    align.align_tokens(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), A, B)
    parts = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables["aligned-blocks"].inputFiles()]
    groups = [m.row_group(i) for m in parts for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and max(g.total_byte_size for g in groups) < 32 << 20
