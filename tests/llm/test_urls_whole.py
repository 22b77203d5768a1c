import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import urls


def brute_force(rows, enough, confidence):
    """Least rules over (tokens, bad), where no two tokens stand in the same rows."""
    seen, hit = {}, {}
    for tokens, bad in rows:
        for n in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), n):
                seen[c], hit[c] = seen.get(c, 0) + 1, hit.get(c, 0) + bad
    want = {c for c, n in seen.items() if hit[c] >= enough and hit[c] / n >= confidence}
    return {c: hit[c] / seen[c] for c in want if not any(set(c[:i] + c[i + 1 :]) >= set(d) for d in want for i in range(len(c)))}


@pytest.mark.parametrize("joint", [0, 20])
def test_all_least_rules_of_long_urls(spark, joint):
    """Both ways find each least rule of up to twelve tokens, also of tokens that tell nothing alone."""
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        has = [k for k in range(11) if rnd.random() < 0.55]
        odd = (0 in has) + (1 in has) == 2 or {8, 9, 10} <= set(has) or not set(has) & {2, 3}
        rows.append((f"http://h/{'/'.join('t' + chr(97 + k) for k in has)}", odd if rnd.random() < 0.85 else rnd.random() < 0.3))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = urls.mine(df, "url", "bad", support=0.03, confidence=0.75, least=10, joint=joint).collect()
    tokens = [(r.t, r.bad) for r in df.select(urls.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    want = brute_force(tokens, 0.03 * len(tokens), 0.75)
    assert {tuple(r.antecedent): r.confidence for r in got} == pytest.approx(want)
    assert {len(c) for c in want} >= {2, 3} and ("path:ta", "path:tb") in want


def test_tokens_beyond_those_that_tell_most(spark):
    """Nine tokens that are likelier among unwanted URLs don't keep two others from making a rule."""
    rows = []
    for i in range(360):
        near = ["n" + chr(97 + k) for k in range(9) if i % 4 == 3 or i % 4 == 1 and i < 20 or i % 4 == 0 and i < 240 and i // 4 % 9 != k]
        rows.append((f"http://{'p' if i % 2 else 'q'}/{'/'.join(['x' if i % 4 > 1 else 'y', *near])}", i % 4 == 3))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert {tuple(r.antecedent) for r in urls.mine(df, "url", "bad", confidence=0.99).collect()} >= {("host:p", "path:x")}
