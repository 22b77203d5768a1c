"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item, or a shorter item as a whole. From each window
the least hash of five neighbouring words is kept, so every shared window shares a fingerprint. The
benchmark's fingerprints make a bitmap of fixed size; the documents are read once, and only windows
around a fingerprint of the benchmark go on to the join with its windows, where 96-bit hashes of all
words decide. Neighbouring windows extend each other to the hit spans.

Scale: the texts are read once and not shuffled; the shuffle grows with the shared windows. Each different
set of items that hold a window has a number, and documents meet numbers: a phrase that many items share is
one row for each place in a document, and its items are listed once for each document. Only the bitmap is
broadcast by hand, and Spark splits a window that very many documents share, as that is a plain join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import sieve
from ledgerline.llm.ship import ship
from ledgerline.llm.words import ALNUM, Words, flat, slices, window_anchors
from ledgerline.session import durable

WINDOW = 10
ANCHOR = 5
_SALT = 0x2545F491


def _wide(words: Words, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1 = words.grams(size)[at].view(np.int64)
    w2 = (words.grams(size, _SALT)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return w1, w2


def _item_windows(window: int, k: int):
    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("seed", pa.int64()), ("w1", pa.int64()), ("w2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), ALNUM)
                ids = part.column("item_id")
                for size in range(1, window + 1):
                    if size == window:
                        seed, ok = window_anchors(words, window, k)
                        at = np.flatnonzero(ok)
                    else:
                        at = words.first[words.count == size]
                        seed = words.grams(size)
                    if len(at):
                        w1, w2 = _wide(words, size, at)
                        yield pa.record_batch(
                            [
                                ids.take(pa.array(words.row[at])),
                                pa.array(np.full(len(at), size, np.int32)),
                                pa.array(seed[at].view(np.int64)),
                                pa.array(w1),
                                pa.array(w2),
                            ],
                            schema=schema,
                        )

    return run, "item_id long, size int, seed long, w1 long, w2 int"


def _document_rows(window: int, k: int, bits, sizes: tuple[int, ...]):
    names = ["doc_id", "text_key", "n_words", "start", "size", "w1", "w2"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), ALNUM)
                ids, keys = part.column("doc_id"), part.column("text_key")
                empty = [pa.nulls(part.num_rows, kind) for kind in kinds[3:]]
                yield pa.record_batch([ids, keys, pa.array(words.count.astype(np.int64)), *empty], schema=schema)
                for size in sizes:
                    if size == window:
                        seed, ok = window_anchors(words, window, k)
                    else:
                        seed, ok = words.grams(size), words.whole(size)
                    at = np.flatnonzero(ok & sieve.passes(seen, seed))
                    if not len(at):
                        continue
                    w1, w2 = _wide(words, size, at)
                    row = pa.array(words.row[at])
                    yield pa.record_batch(
                        [
                            ids.take(row),
                            keys.take(row),
                            pa.nulls(len(at), pa.int64()),
                            pa.array(words.position()[at].astype(np.int32)),
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(w1),
                            pa.array(w2),
                        ],
                        schema=schema,
                    )

    return run, "doc_id long, text_key int, n_words long, start int, size int, w1 long, w2 int"


def _union(spans):
    """Maximal spans of an array of (start, size), in time linear in the words they cover."""
    words = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    # where no word before is covered a span starts, where none after is it ends
    starts = F.array_sort(F.array_except(words, F.transform(words, lambda x: x + 1)))
    ends = F.array_sort(F.array_except(words, F.transform(words, lambda x: x - 1)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = ANCHOR,
    bits: int = sieve.BITS,
) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, items, spans``.

    ``items`` are the ids of the items that share a window, sorted as strings; ``spans`` the covered words
    as maximal (first word, number of words). ``text_key`` is ``hash`` of the text and tells apart texts
    under one id. A null text has no words. A null document id is kept as it is. An item without an id
    covers words but is not listed. Other columns, whatever their names, play no part. Without any window
    in ``items`` all documents are clean.
    """
    if not 0 < k < window:
        raise ValueError("an anchor must be shorter than the window")
    spark = ship(docs.sparkSession)
    rows, schema = _item_windows(window, k)
    theirs = durable(
        items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
        .mapInArrow(rows, schema)
        .distinct()
    )
    sizes = tuple(sorted(r["size"] for r in theirs.select("size").distinct().collect()))
    seen = spark.sparkContext.broadcast(sieve.bitmap(theirs, F.col("seed"), bits))
    rows, schema = _document_rows(window, k, seen, sizes)
    ours = durable(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("text_key", F.hash("text"))
        .mapInArrow(rows, schema)
    )
    # windows of one phrase are held by the same items
    held = durable(theirs.groupBy("size", "w1", "w2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("members")))
    sets = durable(held.select("members").distinct().withColumn("set", F.monotonically_increasing_id()))
    hits = durable(
        ours.filter("start is not null")
        .join(held.join(sets, "members").select("size", "w1", "w2", "set"), ["size", "w1", "w2"])
        .select("doc_id", "text_key", "start", "size", "set")
    )
    spans = hits.groupBy("doc_id", "text_key").agg(_union(F.collect_set(F.struct("start", "size"))).alias("spans"))
    listed = (
        hits.select("doc_id", "text_key", "set")
        .distinct()
        .join(sets, "set")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("items"))
        .select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "items")
    )
    found = spans.join(listed, spans.doc_id.eqNullSafe(listed.of) & (spans.text_key == listed.of_key)).select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "items", "spans"
    )
    every = ours.filter("start is null").select("doc_id", "text_key", "n_words")
    return every.join(
        found, every.doc_id.eqNullSafe(found.hit_id) & (every.text_key == found.hit_key), "left"
    ).select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, n: int>>)")).alias("spans"),
    )
