import re

from pyspark.sql import functions as F

from ledgerline.llm.decontamination import _union, find_leaks

from .helpers import docs_of, odd_texts, prose, with_clashing_columns

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts: dict, items: dict) -> dict:
    windows = []
    for item, text in items.items():
        w = cut(text)
        size = min(len(w), 10)
        if size:
            windows += [(item, size, tuple(w[j : j + size])) for j in range(len(w) - size + 1)]
    out = {}
    for i, text in texts.items():
        w, hit, found = cut(text), set(), set()
        for item, size, words in windows:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) == words:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
        out[i] = (len(w), hit, sorted(found))
    return out


def check(spark, texts, items):
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute(texts, items)
    rows = find_leaks(with_clashing_columns(docs_of(spark, texts)), bench).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = want[r.doc_id]
        covered = {p for s in r.spans for p in range(s.start, s.start + s.n)}
        assert (r.n_words, covered, r["items"]) == (n, hit, found)
        assert sum(s.n for s in r.spans) == len(hit)
        assert all(a.start + a.n < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_items_of_all_sizes(spark):
    base = prose(11, 60, 10**6)
    words = base.split()
    items = {n: " ".join(words[n : n + n]) for n in range(0, 14)} | {20: None, 21: "", 22: "...", 23: base.upper()}
    texts = odd_texts() | {
        30: base,
        31: base.replace(" ", ", "),
        32: " ".join(words[:9]),
        33: " ".join(words[5:15]) + " x " + " ".join(words[9:20]),
        34: " ".join([words[1]] * 5),
        35: prose(12, 80, 10**6),
    }
    check(spark, texts, items)


def test_items_that_share_windows_and_a_hot_passage(many_chunks):
    passage = prose(13, 12, 10**6)
    items = {1: passage, 2: passage, 10: passage + " end"}
    check(many_chunks, {i: f"{prose(200 + i, 8, 10**6)} {passage}" for i in range(120)}, items)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    item = prose(14, 12, 10**6)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (1, item), (1, "clean"), (None, item)], "doc_id long, text string")
    got = find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, len(r["items"])) for r in got) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert find_leaks(docs.filter("false"), bench).collect() == []
    assert all(not r["items"] for r in find_leaks(docs, bench.filter("false")).collect())


def test_a_phrase_of_many_items_and_documents(many_chunks):
    phrase = prose(15, 14, 10**6)
    items = {i: f"{phrase} {prose(300 + i, 12, 10**6)}" if i % 3 == 0 else prose(300 + i, 12, 10**6) for i in range(60)}
    texts = {i: f"{prose(400 + i, 6, 10**6)} {phrase if i % 3 else items[i % 60]} {items[1] if i == 7 else ''}" for i in range(90)}
    check(many_chunks, texts, items | {100: None})


def test_spans_of_long_documents_take_linear_time(spark):
    import time

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda x: F.struct((x * 12).cast("int").alias("start"), F.lit(10).alias("size"))).alias("w"))
    start = time.time()
    row = df.select(_union(F.col("w")).alias("s")).select(F.size("s").alias("n"), F.col("s")[99_999].alias("last")).first()
    assert row.n == 100_000 and tuple(row["last"]) == (12 * 99_999, 10) and time.time() - start < 30
