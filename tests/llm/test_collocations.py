import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ledgerline.llm import collocations
from ledgerline.llm.collocations import Counts, united

from .helpers import docs_of, odd_texts, with_clashing_columns

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows of (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and p in (q[:2], q[1:]) for q, b in often.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def chatter(seed, n, words=14):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["da", "DO", "di", "é", "x", "the", "Ö", "sol"] + [f"w{i}" for i in range(words)]) + rnd.choice("      ,.\n\t") for _ in range(n))


def test_against_brute_force(spark):
    rows = [(chatter(i, 400), ["en", "de", None, "en"][i % 4]) for i in range(24)]
    rows += [(None, "en"), ("", None), (" \t\n.,", "fr"), ("one", "it"), ("a b c " * 30, "xé"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(t, lang, "1", "2") for t, lang in rows], "text string, lang string, range string, f string").repartition(5)
    got = rows_of(collocations.mine(docs))
    assert got == brute(rows) and {r[0] for r in got} == {"en", "und", "xé"}


def test_many_ranges_shards_and_a_hot_word(spark, monkeypatch):
    rows = [("the " + " the ".join(f"w{(i * j) % 30}" for j in range(300)), "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    want = brute(rows)
    assert rows_of(collocations.mine(docs)) == want and want
    # several steps of ranges
    monkeypatch.setattr(collocations, "RANGE_WORDS", 4)
    monkeypatch.setattr(collocations, "STEP", 4)
    assert rows_of(collocations.mine(docs, bits=20)) == want


def test_top_and_ties(spark):
    # equal counts and scores everywhere: the phrases' bytes decide
    rows = [(f"{a} {b}.", "en") for a, b in zip("abcdef", "uvwxyz") for _ in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.mine(docs, top=3)) == brute(rows, top=3)
    assert [r[2] for r in rows_of(collocations.mine(docs, top=3))] == ["a u", "b v", "c w"]


def test_longer_phrases_take_the_place_of_their_parts(spark):
    rows = [("new york city.", "en")] * 20 + [("new york.", "en")] * 20 + [("york city.", "en")] * 21
    got = rows_of(collocations.mine(spark.createDataFrame(rows, "text string, lang string")))
    assert got == brute(rows)
    assert [r[2] for r in got] == ["york city", "new york city"]


def test_products_beyond_64_bits(spark):
    big = 3_000_000_019
    df = spark.createDataFrame([(big, big + 5, big + 11)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first().s == 1000000 * big * big // ((big + 5) * (big + 11))


def test_odd_rows(spark):
    odd = odd_texts()
    docs = with_clashing_columns(docs_of(spark, odd))
    assert rows_of(collocations.mine(docs)) == brute([(t, "en") for t in odd.values()])
    assert collocations.mine(docs.filter("false")).collect() == []
    assert collocations.mine(docs.filter("doc_id < 3")).collect() == []


def paths(counts):
    labels = counts.labels.to_pylist()
    return {tuple(labels[i] for i in p): w for p, w in zip(zip(*(c.tolist() for c in counts.columns)), counts.weight.tolist())}


def test_automata_keep_paths_and_add_weights():
    rnd = random.Random(3)
    parts, want = [], Counter()
    for _ in range(5):
        rows = [("en", rnd.choice("abcde"), rnd.choice("abcdefgh"), rnd.choice("abé")) for _ in range(300)]
        want.update(rows)
        labels = [x for row in rows for x in row]
        columns = [np.arange(300) * 4 + j for j in range(4)]
        part = Counts.summed(pa.array(labels, pa.large_string()), columns, np.ones(300, np.int64))
        assert paths(part) == Counter(rows)
        again = Counts.read(part.automaton())
        assert paths(again) == paths(part)
        parts.append(again)
    whole = united(parts)
    assert paths(whole) == want
    assert list(paths(whole)) == sorted(paths(whole), key=lambda p: [x.encode() for x in p])


def test_equal_states_are_stored_once():
    words = [f"w{i:04}" for i in range(1000)]
    labels = pa.array(["en", "tail", *words], pa.large_string())
    n = np.arange(1000)
    one = Counts.summed(labels, [n * 0, n + 2, n * 0 + 1], n * 0 + 3)
    other = Counts.summed(labels, [n * 0, n + 2, n[::-1] + 2], n + 3)
    shared, apart = collocations._unpacked(one.automaton()), collocations._unpacked(other.automaton())
    # the last states: a thousand beginnings lead to one of them, or to one each
    assert len(shared[2]) == 1 and len(apart[2]) == 1000
    assert paths(Counts.read(one.automaton())) == paths(one)
