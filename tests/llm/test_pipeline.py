import zlib

import pytest

import corpus_pipeline as C
from ledgerline.llm import language
from ledgerline.llm.queries import QUERIES, SQL

from .helpers import prose
from .test_decontamination import brute as leaks
from .test_near_copies import jaccard, shingles
from .test_simhash import groups
from .test_substring import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, passages, benchmark windows and junk."""
    path = str(tmp_path_factory.mktemp("tables"))
    passage, item = prose(900, 60, 10**6), prose(901, 15, 10**6)
    texts = {i: prose(i, 60, 3000) for i in range(60)}
    texts |= {100: texts[3], 101: texts[3].upper(), 102: texts[4].replace(" ", "\n"), 103: texts[5] + " and three more"}
    texts |= {110: f"{prose(700, 30)} {passage}", 111: f"{passage}\n{prose(701, 30)}", 112: passage}
    texts |= {120: f"{prose(702, 30)} {item} end", 130: None, 131: "", 132: "1234 !!", 133: prose(703, 20_000, 10**6)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, {1: item}


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = dict(texts)
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert tuple(docs.columns) == C.COLUMNS
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            left = {i: t for i, t in left.items() if i not in (130, 131, 132)}
        if name == "simhash_near_dedup":
            top = groups(sorted(left), lambda a, b: jaccard(shingles(left[a]), shingles(left[b])) >= 0.8)
            left = {i: left[i] for i in sorted(left) if top[i] == i}
            assert not {100, 101, 102, 103} & set(left)
        if name == "substring_dedup":
            found = repeats(left)
            assert found[111][1] >= 60 and found[112][1] == 60
            assert {i: t.split() for i, t in got.items()} == {i: [w.decode() for w in f[2]] for i, f in found.items() if f[2]}
            assert all(got[i] == left[i] for i, f in found.items() if not f[1])
            left = got
        if name == "decontamination":
            left = {i: left[i] for i, (_, _, hit) in leaks(left, items).items() if not hit}
            assert 120 not in left
        assert got == left
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    pieces = C.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(left)


def test_whole_run_gives_the_pieces_of_the_stages(spark, folder):
    path, texts, _ = folder
    rows = C.run(spark, path).collect()
    kept = {r.doc_id for r in rows}
    assert {0, 1, 2, 3, 110} <= kept and not {100, 101, 102, 103, 112, 120, 130, 131, 132} & kept
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)


def test_stages_on_no_rows(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_each_operator_has_its_query():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert not set(SQL) - set(QUERIES)


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    got = QUERIES["op7_nearest_centroid_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.lang_pred == r.lang for r in got if r.held_out and r.lang]
    assert sum(right) / len(right) > 0.95 and language.UNKNOWN == "und"


def test_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for key, sql in SQL.items():
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted(cur.fetchall())
        assert sorted(tuple(r[n] for n in names) for r in QUERIES[key](spark, SF).collect()) == want
