import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import components

from .helpers import docs_of, odd_texts, prose, with_clashing_columns


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near) -> dict:
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def clustered(seed: int, n: int) -> list[int]:
    """Fingerprints around a few centres, many of them within two bits of others."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    out = set(centres)
    while len(out) < n:
        v = rnd.choice(sorted(out) if rnd.random() < 0.7 else centres)
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            v ^= 1 << b
        out.add(v)
    return sorted(out | {rnd.getrandbits(64) for _ in range(30)})


@pytest.mark.parametrize("bucket,parts", [(10_000, 1), (10_000, 2), (10_000, 3), (3, 2), (3, 3)])
def test_links_connect_what_lies_within_two_bits(many_chunks, bucket, parts):
    values = clustered(bucket + parts, 300)
    prints = many_chunks.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    links = simhash.links(prints, 2, bucket, parts)
    mask = (1 << 64) - 1
    assert all(0 < ((r.a ^ r.b) & mask).bit_count() <= 2 for r in links.collect())
    want = groups(values, lambda a, b: (a ^ b).bit_count() <= 2)
    label = {r.node & mask: r.label & mask for r in components(links, "a", "b").collect()}
    sizes = lambda of: sorted(sorted(v for v in values if of.get(v, v) == t) for t in {of.get(v, v) for v in values})
    assert sizes(label) == sizes(want)


def test_thresholds_are_the_cheapest_that_add_up():
    rng = np.random.default_rng(3)
    for parts in (1, 2, 3):
        costs = [rng.random((50, 3)).cumsum(axis=1) for _ in range(parts)]
        got = simhash.allocate(costs, 2)
        assert ((got + 1).sum(axis=1) == 3).all()
        price = lambda row, ts: sum(costs[i][row, t] if t >= 0 else 0.0 for i, t in enumerate(ts))
        from itertools import product

        for row in range(50):
            best = min(price(row, ts) for ts in product(range(-1, 3), repeat=parts) if sum(ts) + parts == 3)
            assert price(row, got[row]) == pytest.approx(best)


def test_partitions_cover_the_bits_and_keep_correlated_ones_together():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 7]
    groups_ = simhash.correlated_partitions((bits.T @ bits).astype(float), 4000, 3)
    assert sorted(b for g in groups_ for b in g) == list(range(64))
    assert any({7, 40} <= set(g) for g in groups_)


def test_documents(spark):
    texts = odd_texts() | {20: "A B c d", 21: "a b C d", 22: "a b", 23: "A  b"}
    rows = simhash.near_duplicates(with_clashing_columns(docs_of(spark, texts))).collect()
    prints = {i: fingerprint(t) for i, t in texts.items()}
    top = groups(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint & ((1 << 64) - 1) == prints[r.doc_id]
        assert r.component_id == min(i for i, f in prints.items() if top[f] == top[prints[r.doc_id]])


def test_one_row_of_each_group_stays(spark):
    text = prose(21, 50)
    rows = [(3, text), (1, text), (1, text), (None, text), (None, None), (None, ""), (7, prose(22, 50)), (7, prose(23, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.representatives(docs).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == sorted(
        [(1, len(text)), (0, 0), (7, len(rows[6][1])), (7, len(rows[7][1]))]
    )
    assert simhash.representatives(docs.filter("false")).collect() == []


def test_components_of_chains_stars_and_repeated_edges(many_chunks):
    rnd = random.Random(9)
    chain = list(range(1000, 1200))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, n) for n in range(6, 300)] + [(6, 5), (7, 7), (None, 3)]
    got = components(many_chunks.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r.node for r in got})
    label = {r.node: r.label for r in got}
    assert {label[n] for n in chain} == {1000} and {label[n] for n in range(5, 300)} == {5}
