import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.words import ALNUM, SPACED, Words, flat, slices, sliding_min

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \t\n\x00\x0b.é日'-", max_size=30)), max_size=8)


def cut(text: str, kind) -> list[bytes]:
    if kind is SPACED:
        return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)]


@pytest.mark.parametrize("kind", [SPACED, ALNUM], ids=["spaced", "alnum"])
@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(kind, texts):
    words = Words(*flat(pa.array(texts, pa.string())), kind)
    found = [[] for _ in texts]
    for r, a, b in zip(words.row, words.start, words.end):
        found[r].append(words.bytes[a:b].tobytes())
    assert found == [cut(t or "", kind) for t in texts]
    assert words.count.tolist() == [len(f) for f in found]


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_equal_grams_have_equal_hashes_and_others_differ(texts):
    words = Words(*flat(pa.array(texts, pa.string())), SPACED)
    all_words = [w for t in texts for w in cut(t or "", SPACED)]
    seen = {}
    for i, h in enumerate(words.grams(2)):
        assert seen.setdefault(tuple(all_words[i : i + 2]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_place():
    one = Words(*flat(pa.array(["alpha beta gamma"])), SPACED)
    two = Words(*flat(pa.array(["x" * 5000, "some words before alpha beta gamma"])), SPACED)
    assert one.grams(3)[0] == two.grams(3)[-1]


@given(st.lists(st.integers(0, 9), max_size=40), st.integers(1, 12))
@settings(deadline=None)
def test_sliding_min(values, w):
    got = sliding_min(np.array(values, np.int64), w).tolist()
    assert got == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_slices_keep_every_row_in_order():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 900, 3, 3)]), pa.array(range(5))], ["text", "n"])
    parts = list(slices(batch, "text", 8))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(5))
    assert len(parts) > 2
