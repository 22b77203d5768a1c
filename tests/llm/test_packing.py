import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import packing
from ledgerline.llm.queries import vocabulary
from ledgerline.llm.tokens import encoder

from .helpers import docs_of, odd_texts, prose, with_clashing_columns


def check(spark, docs, texts, size):
    from tokenizers import Tokenizer

    one = Tokenizer.from_str(vocabulary())
    ids = {i: np.array(one.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    rows = packing.pack(docs, vocabulary(), size=size).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        used += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / (used + padded)


@pytest.mark.parametrize("size", [64, 2048])
def test_every_id_lies_in_one_piece(spark, size):
    texts = odd_texts()
    assert check(spark, with_clashing_columns(docs_of(spark, texts)), texts, size) < 0.02


def test_little_padding_over_many_tasks(many_chunks):
    texts = {i: prose(i, 5 + (i * 37) % 400) for i in range(600)}
    docs = docs_of(many_chunks, texts).repartition(7)
    assert check(many_chunks, docs, texts, 512) < 0.02


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(docs, vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.start) for r in rows) == [(0, 0), (1, 0), (1, 0)]
    assert packing.pack(docs.filter("false"), vocabulary()).collect() == []


def test_knapsack_against_all_combinations():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(3, 30), 6, replace=False))
        prices = rng.random(6) * lengths
        value, counts = packing.knapsack(lengths, prices, 60)
        best = np.zeros(61)
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [best[c - n] + p for n, p in zip(lengths, prices) if n <= c])
        assert value == pytest.approx(best[60]) and lengths @ counts <= 60


def test_patterns_fill_sequences_and_keep_to_the_demand():
    rng = np.random.default_rng(6)
    limits = packing.class_limits(256)
    demand = np.bincount(rng.integers(0, len(limits), 20_000), minlength=len(limits))
    patterns, counts = packing.plan(limits, demand, 256)
    assert (counts @ patterns <= demand).all() and (patterns @ limits <= 256).all()
    assert (patterns @ limits >= packing.FILL * 256).all()
    assert counts @ patterns @ limits > 0.2 * (demand @ limits)


def test_the_last_ids_end_at_powers_of_two():
    for total in (0, 1, 63, 64, 100, 129):
        ends = packing.ends(total, 64)
        assert ends[0] == total // 64 * 64 and ends[-1] == total
        assert all(n & (n - 1) == 0 for n in np.diff(ends))


def test_ids_are_those_of_the_library():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from ledgerline.llm.words import flat

    rnd, parts = random.Random(1), " |  |\n|\t| |　|\x85| |a|é|B|1|23|!|###|'s|'ll|日本|😀|\x00| the| of ".split("|")
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += [None, "", " ", " a", "a ", "a  ", "é  x", "   x", *filter(None, odd_texts().values())]
    one = Tokenizer.from_str(vocabulary())
    for _ in range(2):  # the second time from memory
        ids, where = encoder(vocabulary()).encode(*flat(pa.array(texts, pa.string())))
        for i, e in enumerate(one.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[where[i] : where[i + 1]].tolist() == e.ids


def test_added_tokens_in_a_text_become_their_ids(spark):
    from tokenizers import Tokenizer

    texts = {1: "a <|endoftext|> b", 2: "plain text", 3: "<|endoftext|>", 4: "x<|endoftext|><|endoftext|>y", 5: "<|endoftext", 6: "|>"}
    library = Tokenizer.from_str(vocabulary())
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    placed = defaultdict(int)
    for r in packing.pack(docs_of(spark, texts), vocabulary()).collect():
        piece = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        placed[r.doc_id] += len(piece)
    assert placed == {i: len(ids) for i, ids in want.items()}


def test_the_driver_loads_no_vocabulary(spark):
    encoder.cache_clear()
    texts = {i: prose(i, 50) for i in range(20)}
    rows = packing.pack(docs_of(spark, texts), vocabulary(), size=64).collect()
    assert {r.doc_id for r in rows} == set(texts) and not encoder.cache_info().currsize


def test_values_of_classes_are_one_literal(spark):
    """Hundreds of literals took 50 MB of the driver's heap each time a plan with them was built."""
    values = np.arange(385) * 10**12
    got = spark.range(385).select(F.col("id").cast("int").alias("kind")).select("kind", packing._of_kind(values).alias("v"))
    assert all(r.v == r.kind * 10**12 for r in got.collect())
    texts = {i: prose(i, 5 + (i * 37) % 400) for i in range(200)}
    plan = packing.pack(docs_of(spark, texts), vocabulary(), size=512)._jdf.queryExecution().analyzed()
    assert "array(" not in plan.toString()
