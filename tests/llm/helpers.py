"""Small tables for the corpus operators."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark: SparkSession, texts: dict, lang: str = "en") -> DataFrame:
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS)


def prose(seed: int, n: int, size: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def odd_texts() -> dict:
    """Null, empty, blank, very long, repeated and tied texts."""
    long = prose(1, 30_000, 5000)
    return {
        0: None,
        1: "",
        2: " \n\t ",
        3: "one",
        4: prose(2, 60),
        5: prose(2, 60),
        6: long,
        7: prose(3, 40) + " " + prose(2, 30),
        8: "é " * 20,
        9: "\x00a\x1cb   c",
    }


def with_clashing_columns(df: DataFrame) -> DataFrame:
    """Extra columns named like what the operators use inside."""
    from pyspark.sql import functions as F

    names = ["text_key", "n_words", "start", "size", "fingerprint", "block", "tail", "kind", "task", "score", "host", "component"]
    return df.withColumns({n: F.lit("x") for n in names})
