"""Document fingerprints by winnowing.

A text's k-grams of code points are hashed with a rolling polynomial; of each window of ``w``
neighbouring hashes the least is selected, the rightmost one on ties, and its position kept. Two texts
that share ``w + k - 1`` code points in a row select a common hash there. Gram and window are the same for all
texts, so that any two can be compared. A text with fewer hashes than a window keeps its least one, a text
shorter than a gram has the hash of the whole, and an empty text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.ship import ship
from ledgerline.llm.words import mix

GRAM = 6
WINDOW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each place on, by doubling."""
    out, have, power = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    while have < k:
        step = min(have, k - have)
        # the last ``step`` of the next ``have`` are appended: H(a + b) = H(a) * base^|b| + H(b)
        if step == have:
            out = out[:-step] * power + out[step:]
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
        else:
            tail = gram_hashes(points, step)
            out = out[: len(tail) - have] * np.uint64(pow(int(_BASE), step, 1 << 64)) + tail[have:]
        have += step
    return out


def winnow(points: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected 32-bit hashes and their positions, in text order."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = (mix(gram_hashes(points, min(k, len(points)))) >> np.uint64(32)).astype(np.uint32)
    w = min(w, len(hashes))
    best, have = np.arange(len(hashes)), 1
    while have < w:
        step = min(have, w - have)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        have += step
    at = best[np.append(True, best[1:] != best[:-1])]
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hashes that two fingerprints have in common (Dice); 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW
) -> DataFrame:
    """``doc_id, hashes, positions`` of each text; a null text counts as empty. Other columns play no part."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(code_points(t or ""), k, w) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())),
                    pa.array([p for _, p in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "hashes", "positions"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, hashes array<long>, positions array<long>"
    )


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, block, tail``: rows laid out so that each task reads whole blocks in descending order
    of ``doc_id`` (nulls last, then by a hash of the text), each block followed by a copy of the row that
    comes after it (``tail``); the first row comes after the last.

    Blocks are ranges of ids at quantiles, a few for each shuffle partition; the driver has one row for
    each block. The texts are shuffled once.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("doc_id").dropna().approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    blocks = Bucketizer(splits=splits, inputCol="place", outputCol="block")
    placed = blocks.transform(
        keyed.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
    ).withColumn("block", F.col("block").cast("int")).drop("place")
    firsts = sorted(
        placed.groupBy("block").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect(), key=lambda r: -r["block"]
    )
    above = [(r["block"], r["top"]["doc_id"], r["top"]["h"], up["block"]) for r, up in zip(firsts, [firsts[-1], *firsts])] if firsts else []
    edges = spark.createDataFrame(above, "block int, edge_id long, edge_h long, goes int")
    marked = placed.join(
        F.broadcast(edges),
        (placed.block == edges.block) & placed.doc_id.eqNullSafe(edges.edge_id) & (placed.h == edges.edge_h),
        "left",
    ).drop(edges.block)
    own = F.struct(F.col("block"), F.lit(False).alias("tail"))
    extra = F.struct(F.col("goes").alias("block"), F.lit(True).alias("tail"))
    spread = marked.select(
        "doc_id", "text", "h", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("to")
    ).select("doc_id", "text", "h", "to.block", "to.tail")
    return spread.repartition("block").sortWithinPartitions(
        "block", "tail", F.desc_nulls_last("doc_id"), F.desc("h")
    ).select("doc_id", "text", "block", "tail")


def _compare(k: int, w: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))

    def row(now, after) -> tuple:
        doc_id, text, mine = now
        _, other, theirs = after
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        changed = winnow(code_points(edited), k, w)[0]
        return (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            as_text(mine),
            as_text(changed),
            likeness(mine, changed),
            likeness(mine, theirs),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_block, closed = None, None, None
        for batch in batches:
            rows = []
            for doc_id, text, block, tail in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "block", "tail"))):
                if tail and block == closed:
                    continue
                text = text or ""
                now = (doc_id, text, winnow(code_points(text), k, w)[0])
                if held is not None and block == held_block:
                    rows.append(row(held, now))
                held, held_block = (None, None) if tail else (now, block)
                closed = block if tail else None
            if rows:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], schema=schema)

    return run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW
) -> DataFrame:
    """How fingerprints follow an edit: each text against itself with its last third replaced by the start
    of the next document's text, and against the next document, in descending order of the ids.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``;
    fingerprints are the selected hashes in text order, 8 hexadecimal digits each. A null text counts as
    empty. A null id comes last; rows that share an id follow each other by a hash of their text; after the
    last row comes the first. Every row yields one row. Other columns play no part.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, schema = _compare(k, w)
    return in_order(plain).mapInArrow(rows, schema)
