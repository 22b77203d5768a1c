import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import token_counts as T
from ledgerline.llm.queries import vocabulary

from .helpers import docs_of, odd_texts, with_clashing_columns

END = 9


def scan(ids: list[int]) -> list[tuple[int, int]]:
    """Start and size of each document of a file."""
    out, start = [], 0
    for i, t in enumerate(ids):
        if t == END:
            out.append((start, i + 1 - start))
            start = i + 1
    return out + ([(start, len(ids) - start)] if start < len(ids) else [])


@pytest.mark.parametrize("group", [1, 3, 4096])
@pytest.mark.parametrize("block", [1, 4, 50])
def test_boundaries_across_blocks(many_chunks, block, group):
    rng = np.random.default_rng(block + group)
    files = [rng.integers(0, 10, n).tolist() for n in (0, 1, 37, 120)]
    files += [[END] * 5, [1] * 30, [1] * 10 + [END], [END] + [1] * 10]
    rows = []
    for f, ids in enumerate(files):
        data = np.array(ids, "<u2").tobytes()
        rows += [(f, n, bytearray(data[2 * i : 2 * (i + block)])) for n, i in enumerate(range(0, len(ids), block))]
    rows += [(2, 10_000, None)]
    blocks = many_chunks.createDataFrame(rows, "file int, block long, ids binary").repartition(5)
    got = T.separator_scan(blocks, END, group=group).collect()
    for f, ids in enumerate(files):
        mine = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.file == f)
        assert mine == [(i, a, n) for i, (a, n) in enumerate(scan(ids))]


def test_documents_are_found_again(spark):
    from tokenizers import Tokenizer

    one = Tokenizer.from_str(vocabulary())
    one.encode_special_tokens = True
    texts = odd_texts() | {30: "x <|endoftext|> y"}
    docs = with_clashing_columns(docs_of(spark, texts))
    got = T.count_tokens(docs, vocabulary(), 50256).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {
        i: len(one.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()
    }
    assert T.count_tokens(docs.filter("false"), vocabulary(), 50256).collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = T.count_tokens(docs, vocabulary(), 50256).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2)]


def test_files_on_disk(spark, tmp_path):
    ids = np.array([1, 2, END, 3, END, END, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = T.separator_scan(T.blocks_of(files, block=2), END).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens) for r in got] == scan(ids.tolist())
    assert T.blocks_of(files, block=2).agg(F.count("*")).first()[0] == 4
