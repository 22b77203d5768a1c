import pytest

from ledgerline.llm.substring import remove_repeats

from .helpers import docs_of, odd_texts, prose, with_clashing_columns

K = 13


def brute(texts: dict) -> dict:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - K + 1):
            first.setdefault(tuple(words[i][j : j + K]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - K + 1):
            if first[tuple(w[j : j + K])] < i:
                gone |= set(range(j, j + K))
        out[i] = (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone])
    return out


def check(spark, texts, **parameters):
    rows = remove_repeats(with_clashing_columns(docs_of(spark, texts)), **parameters).collect()
    want = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text.encode().split()) == (n, gone, kept)
        if not gone:
            assert r.kept_text == (texts[r.doc_id] or "")
        assert sum(x.n for x in r.removed) == gone


def test_odd_texts(spark):
    check(spark, odd_texts())


def test_passages_of_all_lengths_and_places(spark):
    base = prose(5, 300, 10**6)
    words = base.split()
    texts = {0: base}
    for n in range(10, 17):
        texts[n] = " ".join(["p%d" % n, *words[n : n + n], "q%d" % n])
    texts[50] = " ".join(words[:13] + ["x"] + words[200:240])
    texts[51] = " ".join(words[100:160]) + "\n\n" + prose(6, 20, 10**6)
    texts[52] = "a " * 40
    texts[53] = "a " * 13 + "b"
    check(spark, texts)


def test_a_passage_of_very_many_documents(many_chunks):
    passage = prose(7, 30, 10**6)
    check(many_chunks, {i: f"{prose(100 + i, 20, 10**6)} {passage} {prose(500 + i, 5, 10**6)}" for i in range(200)})


@pytest.mark.parametrize("hot", [2, 5, 10**6])
def test_hot_windows_go_by_partial_minima(many_chunks, hot):
    passage, copy = prose(7, 30, 10**6), prose(9, 25, 10**6)
    texts = {i: f"{prose(100 + i, 20, 10**6)} {passage} {'a ' * 30}" for i in range(40)}
    texts |= {i: copy for i in range(40, 60)} | odd_texts()
    check(many_chunks, texts | {70: "a " * 60, 71: prose(9, 13, 10**6)}, hot=hot)


def test_rows_that_share_an_id_or_have_none(spark):
    text = prose(8, 30, 10**6)
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (2, text)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 30)]


def test_empty_table_and_carried_columns(spark):
    empty = docs_of(spark, {1: "a"}).filter("false")
    out = remove_repeats(empty, carry=("lang", "source"))
    assert out.collect() == []
    assert out.columns == ["doc_id", "text", "lang", "source", "kept_text", "n_words", "n_removed", "removed"]


def test_a_full_sieve_changes_nothing(spark):
    texts = odd_texts()
    few = remove_repeats(docs_of(spark, texts), bits=16).select("doc_id", "kept_text").collect()
    many = remove_repeats(docs_of(spark, texts)).select("doc_id", "kept_text").collect()
    assert sorted(few) == sorted(many)


def test_anchor_longer_than_window(spark):
    with pytest.raises(ValueError):
        remove_repeats(docs_of(spark, {1: "a"}), window=5, k=5)
