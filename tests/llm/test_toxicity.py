import numpy as np
import pyarrow as pa

from ledgerline.llm import toxicity as T
from ledgerline.llm.words import ALNUM, Words, _letters, flat

from .helpers import docs_of, odd_texts, prose, with_clashing_columns


def symbols(words: str) -> tuple[list[int], list[float]]:
    lists = {w: s for s, text in T._LISTS.items() for w in text.split()}
    found = [T.INSULT if w == "moron" else lists.get(w, T.OTHER) for w in words.split()]
    return found, [2.0 if s == T.INSULT else 0.0 for s in found]


def weight(words: str) -> float:
    return T.clause_weight(*symbols(words))


def test_the_grammar_weighs_clauses():
    plain = weight("what a moron")
    assert plain == 2.0
    assert weight("you are a moron") == weight("moron that you are") == 1.5 * plain
    assert weight("x not a moron") == 0.3 * plain and weight("not x x x moron") == plain
    assert weight("x said moron") == weight("said x x x x x x moron") == 0.5 * plain
    assert weight("x said you are not a moron") == 2.0 * 1.5 * 0.3 * 0.5
    assert weight("kill the process") == 0 and weight("i kill you") == T.THREAT_WEIGHT * 1.5
    assert weight("not a word") == 0 and weight("") == 0


def model(words: dict) -> tuple[np.ndarray, np.ndarray]:
    found = Words(*flat(pa.array(list(words))), ALNUM)
    keys = T._beginning(_letters()[found.bytes], found.start, found.end, 0)
    order = np.argsort(keys)
    return keys[order], np.array(list(words.values()))[order]


def test_arc_weights_are_learned_only_where_they_tell():
    rnd = np.random.default_rng(3)
    y = np.tile([0.0, 1.0], 300)
    negated = 1 << 1
    marks = np.zeros((len(y), 2 * T._STATES))
    odd = rnd.random(len(y)) < 0.1  # one text of ten says it the other way round
    marks[:, 0] = np.where((y == 1) != odd, 2.0, 0.0)
    marks[:, negated] = 2.0 - marks[:, 0]
    got = T.learn_arcs(marks, y)
    assert got.factors[1] < 0.5 and got.factors[0] == got.factors[2] == 1.0 and got.threat == 0.0
    same = np.zeros_like(marks)
    same[np.arange(len(y)), rnd.integers(0, T._STATES, len(y))] = 1.0 + y
    assert T.learn_arcs(same, y) == T.NEUTRAL
    assert T.learn_arcs(np.zeros_like(marks), y) == T.NEUTRAL


def test_clauses_end_at_their_marks_and_texts_at_their_ends():
    lexicon = model({"moron": 2.0})
    texts = ["not. moron", "not moron", "moron! moron", None, "", "x moron", "you\nmoron", "you moron"]
    got = T.clause_features(pa.array(texts), *lexicon)
    assert [round(float(v), 6) for v in got[:, 0]] == [2.0, 0.6, 2.0, 0, 0, 2.0, 2.0, 3.0]
    assert np.rint(np.expm1(got[:, 2])).tolist() == [1, 1, 2, 0, 0, 1, 1, 1]


def test_learned_insults_decide_held_out_documents(spark):
    clean = {i: prose(i, 40) for i in range(300)}
    bad = {i: prose(i, 20) + f" zonk{'abc'[i % 3]} you. " + prose(i + 7, 20) for i in range(300, 500)}
    docs = docs_of(spark, clean | bad)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(500)] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    fitted = T.fit(docs.filter("doc_id % 3 <> 1"), labels)
    got = {r.doc_id: r.score for r in T.score(with_clashing_columns(docs), fitted).collect()}
    assert all(got[i] < 0.3 for i in clean) and all(got[i] > 0.7 for i in bad)

    odd = {r.doc_id: r for r in T.score(docs_of(spark, odd_texts()), fitted).collect()}
    assert set(odd) == set(odd_texts()) and all(0 <= r.score < 0.3 and r.clauses == 0 for r in odd.values())
    again = spark.createDataFrame([(1, "Zonka you!"), (1, "Zonka you!"), (None, "zonka you")], "doc_id long, text string")
    assert [r.clauses for r in T.score(again, fitted).collect()] == [1, 1, 1]


def test_pieces_of_the_sample_without_a_match(many_chunks):
    texts = {i: prose(i, 40) for i in range(60)} | {i: "zonk you. " + prose(i, 20) for i in range(60, 100)}
    labels = many_chunks.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int")
    docs = docs_of(many_chunks, texts).repartition(100, "doc_id")
    got = {r.doc_id: r.score for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert all((got[i] > 0.5) == (i >= 60) for i in texts)


def test_without_labels_or_rows(spark):
    docs = docs_of(spark, {1: "a b", 2: None})
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 3) for r in T.score(docs, none).collect()} == {0.047}
    assert T.score(docs.filter("false"), none).collect() == []
