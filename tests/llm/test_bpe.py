import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe
from ledgerline.llm.queries import QUERIES, vocabulary
from ledgerline.llm.words import flat

from .helpers import docs_of, odd_texts, with_clashing_columns

SF = "/root/testdata/sf0.001"


@functools.cache
def library():
    return Tokenizer.from_str(vocabulary())


@pytest.fixture(scope="module")
def theirs():
    return library()


@pytest.fixture(scope="module")
def ours():
    return bpe.codec(vocabulary())


def ids_of(ours, texts):
    ids, at = ours.encode(*flat(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def same(ours, theirs, texts):
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = ids_of(ours, texts)
    assert got == want
    flat_ids = np.array([i for row in want for i in row], np.int64)
    at = np.concatenate([[0], np.cumsum([len(r) for r in want])]).astype(np.int64)
    assert ours.decode(flat_ids, at) == [theirs.decode(r, skip_special_tokens=False) for r in want]


def test_corners(ours, theirs):
    same(ours, theirs, [
        None, "", " ", "  ", "\n", " \n a", "a  ", "a \n\n b\t\tc", "it's we'll I'd 've ' s '' 's's 're", "don't'x 'tis",
        "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endof", "text|>", " <|endoftext|>\n", "x'<|endoftext|>s",
        "é", "日本語 text 123abc", "　a b c", "\x00\x1c\x1f \x7f\x85", "😀 👩‍👩‍👧 é", "٣٤ ½ Ⅷ",
    ])


def test_runs_merge_from_the_left(ours, theirs):
    same(ours, theirs, [c * n for c in ("a", "ab", "=", " ", "aab", "zz ", "-_") for n in range(1, 70)])


def test_long_words(ours, theirs):
    rnd = random.Random(4)
    same(ours, theirs, ["".join(rnd.choice("abcdehinorst") for _ in range(n)) for n in (255, 256, 257, 5000, 30_000)] + ["a" * 20_000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aabcdehinorst  ''.,\n\té 中0123\x1c<|endoftx>", max_size=40), max_size=4))
def test_any_text(texts):
    same(bpe.codec(vocabulary()), library(), [*texts, "".join(texts)])


def test_guesses_that_fail_are_merged_exactly(ours, theirs):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdehinorst") for _ in range(rnd.randrange(2, 30))) for _ in range(3000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    guess, at = ours.propose(data, start, end)
    exact, exact_at = ours.merged(data, start, end)
    wrong = right = 0
    for n, w in enumerate(words):
        ids = guess[at[n] : at[n + 1]]
        fits = ours.compatible(ids[:-1], ids[1:]).all()
        truth = theirs.encode(w, add_special_tokens=False).ids
        assert exact[exact_at[n] : exact_at[n + 1]].tolist() == truth
        assert fits == (ids.tolist() == truth)
        wrong, right = wrong + (not fits), right + fits
    assert wrong > 100 and right > 100


def test_vocabularies_that_do_not_fit_are_refused():
    import json

    file = json.loads(vocabulary())
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(file | {"normalizer": {"type": "NFC"}}))
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(file | {"added_tokens": [file["added_tokens"][0] | {"lstrip": True}]}))


def test_operator_on_odd_texts(spark, theirs):
    texts = odd_texts()
    docs = with_clashing_columns(docs_of(spark, texts)).union(with_clashing_columns(docs_of(spark, {5: texts[5], 6: None})))
    rows = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = texts[r.doc_id] or ""
        assert (r.doc_id == 6 and ids == []) or (ids == theirs.encode(text, add_special_tokens=False).ids and r.text == text)
    assert bpe.encode(docs.filter("false"), vocabulary()).collect() == []
    nameless = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert bpe.encode(nameless, vocabulary()).first().doc_id is None


def test_unknown_and_missing_ids_decode(spark):
    rows = [(1, None), (2, np.array([64, 4_000_000, 65], "<u4").tobytes()), (3, b"")]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe.decode(coded, vocabulary()).collect()} == {1: "", 2: "ab", 3: ""}


def test_query_against_the_library(spark, theirs):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    rows = QUERIES["op11_speculative_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
