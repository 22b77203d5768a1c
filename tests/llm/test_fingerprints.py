import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import fingerprints as P

from .helpers import docs_of, odd_texts, prose, with_clashing_columns


def naive(text: str, k: int, w: int) -> list[tuple[int, int]]:
    """Hash of each gram by itself, windows one by one."""
    if not text:
        return []
    k = min(k, len(text))
    grams = [int(P.mix(P.gram_hashes(P.code_points(text[i : i + k]), k))[0] >> np.uint64(32)) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(len(grams) - w + 1, 1)):
        window = grams[i : i + w]
        at = max(j for j, h in enumerate(window) if h == min(window)) + i
        if not out or out[-1][1] != at:
            out.append((grams[at], at))
    return out


@given(st.text(alphabet="ab é日", max_size=90), st.integers(1, 9), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_selected_hashes_and_positions(text, k, w):
    hashes, at = P.winnow(P.code_points(text), k, w)
    assert list(zip(hashes.tolist(), at.tolist())) == naive(text, k, w)


def test_a_shared_run_of_the_guaranteed_length_shares_a_hash():
    size = P.GRAM + P.WINDOW - 1
    for seed in range(40):
        shared = prose(seed, 30)[:size]
        a = P.winnow(P.code_points(prose(seed + 100, 40) + shared + prose(seed + 200, 40)))[0]
        b = P.winnow(P.code_points(prose(seed + 300, 40) + shared + prose(seed + 400, 40)))[0]
        assert np.intersect1d(a, b).size


def test_against_brute_force(many_chunks):
    texts = odd_texts() | {i: prose(i, i % 50) for i in range(100, 260)}
    docs = with_clashing_columns(docs_of(many_chunks, texts)).repartition(5)
    got = {r.doc_id: r for r in P.edited_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    sets = lambda t: {h for h, _ in naive(t, P.GRAM, P.WINDOW)} if len(t) < 2000 else set(P.winnow(P.code_points(t))[0].tolist())
    near = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    for i, doc in enumerate(order):
        text, after = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(sets(text), sets(edited))) < 1e-12
        assert abs(r.near_next - near(sets(text), sets(after))) < 1e-12
    assert got[4].fingerprint == got[5].fingerprint != got[7].fingerprint


def test_one_row_repeated_ids_null_ids_and_no_row(spark):
    one = P.edited_likeness(docs_of(spark, {5: "abcdef"})).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abcdab").hexdigest())]
    docs = spark.createDataFrame([(2, "aaaaaaa"), (2, "aaaaaaa"), (2, "bbbbbbb"), (None, "ccccccc"), (9, None)], "doc_id long, text string")
    got = P.edited_likeness(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 7), (2, 7), (2, 7), (2, 7), (9, 0)]
    last = next(r for r in got if r.doc_id is None)
    assert last.edited_sha256 == hashlib.sha256(b"ccccc").hexdigest()  # the first, whose text is null, follows
    assert P.edited_likeness(docs.filter("false")).collect() == []


def test_the_operator_keeps_hashes_and_positions(spark):
    got = {r.doc_id: r for r in P.fingerprints(docs_of(spark, odd_texts())).collect()}
    for i, text in odd_texts().items():
        hashes, at = P.winnow(P.code_points(text or ""))
        assert (got[i].hashes, got[i].positions) == (hashes.tolist(), at.tolist())


def test_texts_of_all_lengths_can_be_compared():
    """A text and itself without the last character share all hashes but one at most."""
    for seed in range(30):
        text = prose(seed, 60)
        of = lambda n: P.winnow(P.code_points(text[:n]))[0]  # noqa: E731, B023
        for n in (11, 12, 13, 20, 32, 62, 63, 64, 65, 100, 200):
            shorter, longer = set(of(n - 1).tolist()), set(of(n).tolist())
            assert len(longer - shorter) <= 1
        assert P.likeness(of(63), of(64)) > 0.9 and P.likeness(of(199), of(200)) > 0.95
