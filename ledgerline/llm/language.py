"""Language identification by nearest centroid.

A text is a vector of byte n-grams (1 to 4) hashed into 4096 places, weighted by square-rooted counts
and inverse document frequency, of length one. Each language has several centroids, found by spherical
k-means over a bounded sample of its labelled documents. A text belongs to the language of the nearest
centroid by cosine; one that is farther from all of them than labelled texts of its size ever are is
rejected.

The sample takes up to ``PER_LANGUAGE`` documents for each language, those with the least hash of their
id; each language's centroids are found in a task, and only they and a few sums come to the driver.
Prediction reads every text whole, in one pass without a shuffle. The model's size is fixed by its
parameters and the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.sample import least_hashed
from ledgerline.llm.ship import ship
from ledgerline.llm.words import Kind, flat, slices
from ledgerline.session import durable

PLACES = 4096
LONGEST = 4
PER_LANGUAGE = 500
CENTROIDS = 4
#: Share of the least similarity seen for a size below which a text is rejected.
SLACK = 0.5
#: Sizes with fewer labelled texts than this, below those that have them, reject nothing but cosine 0.
ENOUGH = 20
UNKNOWN = "und"
#: Letters are A-Z, a-z and everything beyond ASCII; the rest parts words.
LETTERS = Kind([range(0, 65), range(91, 97), range(123, 128)], lower=True)
_SIZES = 32


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams for each text, and the number of letters as a power of two."""
    data, offsets = flat(column)
    rows = len(offsets) - 1
    letter = LETTERS.keep[data]
    # a run of other bytes counts as one space
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    text = np.where(letter, LETTERS.fold[data], 0x20)[keep].astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(place[offsets]))
    counts = np.zeros(rows * PLACES, np.float32)
    gram = np.zeros(len(text), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(text) < n:
            break
        size = len(text) - n + 1
        gram = gram[:size] * np.uint32(257) + text[n - 1 :] + np.uint32(1)
        one_row = row[:size] == row[n - 1 :]
        spot = (gram * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount((row[:size] * PLACES + spot)[one_row], minlength=rows * PLACES).astype(np.float32)
    letters = np.bincount(row[text != 0x20], minlength=rows) if len(text) else np.zeros(rows, np.int64)
    return counts.reshape(rows, PLACES), np.minimum(np.log2(letters + 1).astype(np.int64), _SIZES - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Centroids as columns, the language of each, term weights, and the least similarity by text size."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    weights: np.ndarray
    least: np.ndarray

    def similarities(self, counts: np.ndarray) -> np.ndarray:
        """Cosine to the nearest centroid of each language."""
        near = _unit(np.sqrt(counts) * self.weights) @ self.centroids
        return np.stack([near[:, self.owner == i].max(axis=1) for i in range(len(self.languages))], axis=1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the mean and then from whatever is farthest."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[mine == i].sum(axis=0) if (mine == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def _weights(texts: int, having: np.ndarray) -> np.ndarray:
    """Term weights from the number of texts and of those that have each place."""
    return np.log((1 + texts) / (1 + having)).astype(np.float32) + np.float32(1)


def _least(counts: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least similarity of a size or a larger one, so that it never falls as texts grow longer.

    ``counts`` and ``best`` have the number of labelled texts and their least similarity for each size."""
    least = np.zeros(_SIZES)
    known = np.flatnonzero(counts >= ENOUGH)
    for s in range(known[0] if len(known) else _SIZES, _SIZES):
        least[s] = best[min(s, known[-1]) :].min() * SLACK
    return least


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            counts, sizes = vectors(part.column("text"))
            cells = [np.flatnonzero(c).astype(np.int32) for c in counts]
            yield pa.record_batch(
                [
                    part.column("lang"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(cells, pa.list_(pa.int32())),
                    pa.array([v[c].tobytes() for v, c in zip(counts, cells)], pa.binary()),
                ],
                ["lang", "size", "places", "counts"],
            )


def _of_language(weights: np.ndarray, centroids: int):
    """Centroids of one language's sample, and for each size the number of its texts and their least similarity."""

    def run(sample: pa.Table) -> pa.Table:
        places = [np.array(p, np.int32) for p in sample.column("places").to_pylist()]
        values = sample.column("counts").to_pylist()
        sizes = sample.column("size").to_numpy()
        order = sorted(range(len(places)), key=lambda i: (sizes[i], places[i].tobytes(), values[i]))
        x = np.zeros((len(places), PLACES), np.float32)
        for row, i in enumerate(order):
            x[row, places[i]] = np.frombuffer(values[i], np.float32)
        x = _unit(np.sqrt(x) * weights)
        found = _clusters(x, centroids).astype(np.float32)
        near = (x @ found.T).max(axis=1).astype(np.float64)
        best = np.full(_SIZES, np.inf)
        np.minimum.at(best, sizes[order], near)
        numbers = np.bincount(sizes, minlength=_SIZES)
        return pa.table(
            {"lang": sample.column("lang")[:1], "centroids": [found.tobytes()], "numbers": [numbers.tolist()], "best": [best.tolist()]}
        )

    return run


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    centroids: int = CENTROIDS,
) -> Model | None:
    """Learn from up to ``per_language`` rows of each language; None without a labelled text that has letters.

    There may be any number of languages: the driver gets their centroids, not their texts."""
    ship(labelled.sparkSession)
    rows = labelled.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).filter("lang is not null and text is not null")
    chosen = least_hashed(rows, "doc_id", "lang", per_language)
    sample = rows.join(chosen, ["doc_id", "lang"], "left_semi").filter(F.col("text").rlike(r"\p{L}"))
    kinds = "lang string, size int, places array<int>, counts binary"
    learned = durable(sample.mapInArrow(_training_rows, kinds))
    # one place more, that every text has, counts the texts
    place = F.explode(F.concat("places", F.array(F.lit(PLACES)))).alias("place")
    having = np.zeros(PLACES + 1, np.int64)
    for row in learned.select(place).groupBy("place").agg(F.count("*").alias("n")).collect():
        having[row["place"]] = row["n"]
    if not having[PLACES]:
        return None
    weights = _weights(having[PLACES], having[:PLACES])
    kinds = "lang string, centroids binary, numbers array<long>, best array<double>"
    found = learned.groupBy("lang").applyInArrow(_of_language(weights, centroids), kinds).toArrow().sort_by("lang")
    own = [np.frombuffer(c, np.float32).reshape(-1, PLACES) for c in found.column("centroids").to_pylist()]
    return Model(
        found.column("lang").to_pylist(),
        np.repeat(np.arange(len(own)), [len(c) for c in own]),
        np.vstack(own).T,
        weights,
        _least(np.sum(found.column("numbers").to_pylist(), axis=0), np.min(found.column("best").to_pylist(), axis=0)),
    )


def _predict(shared):
    added = [pa.field("lang_pred", pa.string()), pa.field("lang_score", pa.float64()), pa.field("lang_rejected", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = pa.array(model.languages)
        for batch in batches:
            schema = pa.schema([*batch.schema, *added])
            for part in slices(batch, "text", 1 << 20):
                counts, sizes = vectors(part.column("text"))
                near = model.similarities(counts)
                best = near.argmax(axis=1)
                score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
                far = (score < model.least[sizes]) | (score <= 0)
                columns = [part.column(n) for n in part.schema.names]
                yield pa.record_batch([*columns, names.take(pa.array(best)), pa.array(score), pa.array(far)], schema=schema)

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_rejected``; columns of these names
    are replaced.

    A text that is null or has no letter is ``und`` with score 0 and is rejected, and so is every text
    without a model. A text far from all centroids keeps the nearest language but is rejected. Ties go to
    the language that comes first by name. Rows are neither dropped nor merged.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    blank = F.coalesce(~F.col(text_col).rlike(r"\p{L}"), F.lit(True))
    if model is None:
        return docs.withColumns(
            {"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)}
        )
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    plain = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    schema = f"{kinds}, lang_pred string, lang_score double, lang_rejected boolean"
    out = plain.mapInArrow(_predict(shared), schema)
    if text_col != "text":
        out = out.withColumnRenamed("text", text_col)
    return out.withColumns(
        {
            "lang_pred": F.when(blank, UNKNOWN).otherwise(F.col("lang_pred")),
            "lang_score": F.when(blank, 0.0).otherwise(F.col("lang_score")),
            "lang_rejected": blank | F.col("lang_rejected"),
        }
    )

