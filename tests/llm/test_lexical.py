import math
import random
import re
from collections import Counter

import numpy as np

from ledgerline.llm import lexical
from ledgerline.llm.lexical import _EXACT, _IMPACT, Asked

from .helpers import docs_of, odd_texts, prose, with_clashing_columns

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=20):
    """docs: (id, text), items: (id, text); sorted rows (item_id, rank, doc_id, score)."""
    every = [(i, Counter(terms(t))) for i, t in docs]
    every = [(i, c) for i, c in every if c]
    n = len(every)
    length = sum(sum(c.values()) for _, c in every)
    df = Counter(t for _, c in every for t in c)
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for doc, c in every:
            m = 75 + (25 * sum(c.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in asked
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n string")


def test_against_brute_force(spark):
    docs = {i: prose(i, random.Random(i).randrange(1, 300), 300) for i in range(200)} | {900: "Ünï W1 w1 @w2[w3"}
    items = [(i, prose(1000 + i, 25, 300)) for i in range(70)] + [(500, "w1 w1 w1 W2 ünï"), (501, None), (502, "…none…")]
    got = rows_of(lexical.search(docs_of(spark, docs).repartition(5), items_of(spark, items)))
    assert got == brute(docs.items(), items)


def test_ties_in_every_task(spark):
    # most documents are equal: only their ids decide
    docs = {i: "alpha beta" if i % 5 else "alpha gamma delta" for i in range(300)}
    items = [(1, "alpha beta"), (2, "gamma"), (3, "alpha alpha")]
    got = rows_of(lexical.search(docs_of(spark, docs).repartition(7), items_of(spark, items)))
    assert got == brute(docs.items(), items)
    assert [r[2] for r in sorted(r for r in got if r[0] == 2)] == list(range(0, 100, 5))


def test_several_groups_of_items(spark):
    docs = {i: prose(i, 60, 100) for i in range(60)}
    items = [(i, prose(2000 + i, 20, 100)) for i in range(9)]
    got = rows_of(lexical.search(docs_of(spark, docs), items_of(spark, items), group=300))
    assert got == brute(docs.items(), items)


def test_odd_rows(spark):
    texts = odd_texts()
    docs = with_clashing_columns(docs_of(spark, texts)).union(with_clashing_columns(docs_of(spark, {5: texts[5], None: texts[4]})))
    rows = [*texts.items(), (5, texts[5]), (None, texts[4])]
    items = [(1, texts[4]), (1, texts[4]), (None, "é é W1"), (2, ""), (3, None), (4, prose(1, 3000, 5000))]
    want = brute(rows, [items[0], *items[2:]])
    asked = items_of(spark, items)
    assert rows_of(lexical.search(docs, asked)) == want
    assert lexical.search(docs.filter("false"), asked).collect() == []
    assert lexical.search(docs.filter("text is null"), asked).collect() == []
    assert lexical.search(docs, asked.filter("false")).collect() == []


def test_different_texts_under_one_id_are_ranked_apart(spark):
    docs = {1: "red", 2: "blue blue", 3: "other"}
    got = rows_of(lexical.search(docs_of(spark, docs), items_of(spark, [(7, "red"), (7, "blue")])))
    assert [(r[0], r[1], r[2]) for r in got] == [(7, 1, 1), (7, 1, 2)]


def test_tiles_hold_all_weights_below_the_limit(monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 50)
    asked = Asked([prose(1, 400, 300), prose(2, 3, 300), "", "w1 " * 1000])
    weight = np.random.default_rng(1).integers(1, 60_000, len(asked.hash)) * 40_000
    total = np.zeros((asked.items, len(weight)), np.int64)
    for items, parts in asked.tiles(weight):
        for terms_, tile in parts:
            assert len(terms_) <= 50 and tile.sum(axis=0).max() * _IMPACT <= _EXACT
            for col, item in enumerate(items):
                total[item, terms_] += tile[:, col].astype(np.int64)
    want = np.zeros_like(total)
    want[asked.item, asked.term] = asked.count * weight[asked.term]
    assert (total == want).all()
