import random
import tracemalloc

import numpy as np

from ledgerline.llm import language
from ledgerline.llm.sample import least_hashed

from .helpers import with_clashing_columns

SYLLABLES = {"aa": "ba do ki lu", "bb": "schr ung ein ver", "cc": "été oux eau ié"}


def text(lang: str, seed: int, n: int) -> str:
    rnd, parts = random.Random(f"{lang}{seed}"), SYLLABLES[lang].split()
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(n))


def labelled(spark, n=120):
    rows = [(i, text(lang, i, 5 + i), lang) for i in range(n) for lang in SYLLABLES]
    rows = [(3 * i + j, t, lang) for j, lang in enumerate(SYLLABLES) for i, (_, t, l) in enumerate(rows[j::3])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learned_languages_and_what_has_none(spark):
    model = language.fit(labelled(spark), per_language=60)
    assert model.languages == sorted(SYLLABLES) and model.centroids.shape[1] <= 3 * language.CENTROIDS
    cases = {i: text(lang, 9000 + i, 40) for i, lang in enumerate(SYLLABLES)}
    cases |= {10: None, 11: "", 12: " 12 ... \n", 13: "жизнь и судьба " * 30, 14: text("aa", 1, 40_000), 15: "x"}
    rows = [(i, t) for i, t in cases.items()] + [(0, cases[0])]
    docs = with_clashing_columns(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "'zz' lang_pred")
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, lang in enumerate(SYLLABLES):
        assert by[i].lang_pred == lang and not by[i].lang_rejected and 0.5 < by[i].lang_score <= 1
    for i in (10, 11, 12):
        assert (by[i].lang_pred, by[i].lang_score, by[i].lang_rejected) == ("und", 0.0, True)
    assert by[13].lang_rejected and by[13].lang_pred in SYLLABLES
    assert by[14].lang_pred == "aa" and not by[14].lang_rejected


def test_without_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
    got = language.identify(docs, None).collect()
    assert {(r.lang_pred, r.lang_score, r.lang_rejected) for r in got} == {("und", 0.0, True)}
    assert language.fit(docs.filter("false")) is None and language.identify(docs.filter("false"), None).collect() == []


def test_grams_do_not_cross_texts():
    import pyarrow as pa

    one, _ = language.vectors(pa.array(["abc def"]))
    many, _ = language.vectors(pa.array(["xyz", "abc def", None, "", "uvw"]))
    assert np.array_equal(one[0], many[1]) and not many[2].any() and not many[3].any()


def test_sample_is_bounded_repeatable_and_per_label(many_chunks):
    rows = [(i, "big" if i % 10 else "small") for i in range(5000)] + [(1, "big")] * 50 + [(7, None)]
    df = many_chunks.createDataFrame(rows, "id long, lang string")
    first = sorted(least_hashed(df, "id", "lang", 100).collect())
    assert first == sorted(least_hashed(df.repartition(3), "id", "lang", 100).collect())
    assert {k: sum(r.lang == k for r in first) for k in ("big", "small")} == {"big": 100, "small": 100}
    assert len(least_hashed(df, "id", "lang", 10_000).collect()) == 5000


def test_any_number_of_languages_is_learned(spark):
    """600 labels, one of them with most of the rows; none is left out."""
    rows = [(i, f"l{i % 600}" if i % 3 else "hot") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, lang string")
    found = least_hashed(df, "id", "lang", 5).collect()
    labels = {lang for _, lang in rows}
    assert {r.lang for r in found} == labels and len(labels) > 400
    assert max(sum(r.lang == "hot" for r in found), 0) == 5


def test_learning_keeps_the_sample_off_the_driver(spark):
    """2,000 texts are learned from; the driver gets the centroids of 20 languages, 1.3 MB, and no texts' vectors."""
    rows = [(i, f"{text('aa', i, 8)} {'xyz'[i % 3] * (i % 20 + 1)}", f"l{i % 20}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language.fit(df, per_language=100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 20 and model.centroids.shape[1] > 20
    assert peak < 16e6
