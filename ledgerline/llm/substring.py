"""Substring dedup by seed and extend.

Seeds are winnowed anchors: in each window of 13 words the least hash of 5 neighbouring words. Equal
windows have equal anchors, so a window that occurs twice has an anchor that occurs in two documents.
Anchors that do are found by one aggregate; the windows around them are the extensions, compared as
128-bit-wide hashes (96 bits are kept) of all their words; runs of repeated windows are the maximal
repeats of at least 13 words.

Scale: one row per anchor in the first shuffle (about a fifth of the words), one per window around a
shared anchor in the second, the texts once in the third. A task first settles what repeats among its
own documents, so a passage that a third of all documents share reaches the second shuffle once per
few megabytes of text, not once per document. Windows around an anchor that very many pieces of text
hold go another way: their least document comes from partial minima and is joined back, so that no
window's places have to meet in one task. The sieves of shared and of hot anchors have fixed sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import sieve
from ledgerline.llm.ship import ship
from ledgerline.llm.words import SPACED, Words, flat, mix, slices, window_anchors
from ledgerline.session import durable

WINDOW = 13
ANCHOR = 5
#: An anchor is hot if it counts this much: 1 for each piece of text (about 2 MB) that holds it, 2 if
#: several documents of the piece do.
HOT = 1000
_SALT = 0x5DEECE66D


def _anchor_rows(window: int, k: int):
    schema = pa.schema([("anchor", pa.int32()), ("n", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), SPACED)
                least, ok = window_anchors(words, window, k)
                anchor = (least[ok] >> np.uint64(32)).astype(np.uint32)
                row = words.row[: len(least)][ok]
                order = np.argsort(anchor, kind="stable")
                anchor, row = anchor[order], row[order]
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                other = np.zeros(len(anchor), bool)
                other[1:] = (row[1:] != row[:-1]) & ~new[1:]
                start = np.flatnonzero(new)
                several = np.add.reduceat(other, start) > 0 if len(start) else other[:0]
                yield pa.record_batch(
                    [pa.array(anchor[start].view(np.int32)), pa.array((1 + several).astype(np.int8))], schema=schema
                )

    return run, "anchor int, n byte"


def _window_rows(window: int, k: int, bits, hot_bits=None, hot: bool = False):
    """Rows of windows around shared anchors: the unsettled ones of hot anchors, or all others."""
    # what varies from row to row stands together: the shuffle's codec then finds the rest repeated
    names = ["w1", "w2_start", "doc_id", "text_key", "known"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), SPACED)
                least, ok = window_anchors(words, window, k)
                at = np.flatnonzero(ok & sieve.passes(seen, least))
                if not len(at):
                    continue
                w1 = words.grams(window)[at]
                w2 = words.grams(window, _SALT)[at] >> np.uint64(32)
                row, start = words.row[at], words.position()[at].astype(np.uint64)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                key = part.column("text_key").to_numpy(zero_copy_only=False)[row]
                order = np.lexsort((doc, w2, w1))
                new = np.ones(len(order), bool)
                new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
                known = np.zeros(len(order), bool)
                known[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                # settled rows need no partner: they travel by document
                w1 = np.where(known, mix(doc.view(np.uint64) ^ mix(key.astype(np.uint64))), w1)
                w2 = np.where(known, np.uint64(0), w2)
                columns = [w1.view(np.int64), ((w2 << np.uint64(32)) | start).view(np.int64), doc, key, known]
                if hot_bits is not None:
                    use = (sieve.passes(hot_bits.value, least[at]) & ~known) == hot
                    columns = [c[use] for c in columns]
                yield pa.record_batch([pa.array(c) for c in columns], schema=schema)

    return run, "w1 long, w2_start long, doc_id long, text_key int, known boolean"


def _apart(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"w2": F.shiftrightunsigned("w2_start", 32), "start": F.col("w2_start").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")}
    )


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, bits: int = sieve.BITS, hot: int = HOT
) -> DataFrame:
    """``doc_id, text_key, start``: each window that also starts in a document with a smaller id.

    ``docs`` has ``doc_id`` (long, not null), ``text_key`` (int, tells apart texts under one id) and ``text``.
    Fewer than ``hot`` pieces of text hold a window that is judged in one group; results don't depend on it.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select("doc_id", "text_key", "text")
    rows, schema = _anchor_rows(window, k)
    shared = docs.mapInArrow(rows, schema).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    top = F.shiftleft(F.col("anchor").cast("long"), 32)
    several, many = sieve.bitmaps(shared, top, ["true", f"n >= {hot}"], min(bits, 32))
    seen = spark.sparkContext.broadcast(several)
    hot_bits = spark.sparkContext.broadcast(sieve.coarser(many)) if many.any() else None

    rows, schema = _window_rows(window, k, seen, hot_bits)
    same = Window.partitionBy("w1", "w2")
    wanted = ["doc_id", "text_key", "start"]
    found = (
        _apart(docs.mapInArrow(rows, schema).repartition("w1"))
        .withColumn("first", F.min("doc_id").over(same))
        .filter("known or first < doc_id")
        .select(*wanted)
    )
    if hot_bits is None:
        return found
    rows, schema = _window_rows(window, k, seen, hot_bits, hot=True)
    places = _apart(durable(docs.mapInArrow(rows, schema)))
    least = (
        places.groupBy("w1", "w2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("w1", "w2", "first")
    )
    return found.union(places.join(least, ["w1", "w2"]).filter("first < doc_id").select(*wanted))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut_part(part, window)

    return run


def _cut_part(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    data, offsets = flat(part.column("text"))
    words = Words(data, offsets, SPACED)
    starts = part.column("starts")
    where = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = words.first[np.repeat(np.arange(part.num_rows), sizes)] + where
    n = len(words.start)
    level = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + window, minlength=n + 1)[: n + 1]
    gone = np.cumsum(level)[:n] > 0
    removed = np.bincount(words.row[gone], minlength=part.num_rows)

    # runs of removed words within a row
    edge = np.ones(n, bool)
    edge[1:] = (words.row[1:] != words.row[:-1]) | (gone[1:] != gone[:-1])
    run_at = np.flatnonzero(edge)
    run_len = np.diff(np.append(run_at, n))
    hit = gone[run_at] if n else np.zeros(0, bool)
    run_at, run_len = run_at[hit], run_len[hit]
    run_row = words.row[run_at]
    ends = np.concatenate([[0], np.cumsum(np.bincount(run_row, minlength=part.num_rows))])
    runs = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array((run_at - words.first[run_row]).astype(np.int32)), pa.array(run_len.astype(np.int32))], ["start", "n"]
        ),
    )

    # a removed word takes the white space after it along
    follow = np.append(words.start[1:], 0)
    last = np.ones(n, bool)
    last[:-1] = words.row[1:] != words.row[:-1]
    follow = np.where(last, offsets[words.row + 1] if n else 0, follow)
    drop = np.zeros(len(data) + 1, np.int64)
    np.add.at(drop, words.start[gone], 1)
    np.add.at(drop, follow[gone], -1)
    stay = np.cumsum(drop)[: len(data)] == 0
    kept_before = np.concatenate([[0], np.cumsum(stay)])
    kept = pa.LargeStringArray.from_buffers(
        part.num_rows, pa.py_buffer(kept_before[offsets].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[stay]))
    ).cast(pa.string())
    columns = {name: part.column(name) for name in part.schema.names if name != "starts"}
    columns |= {
        "kept_text": kept,
        "n_words": pa.array(words.count.astype(np.int64)),
        "n_removed": pa.array(removed.astype(np.int64)),
        "removed": runs,
    }
    return pa.RecordBatch.from_pydict(columns)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    window: int = WINDOW,
    k: int = ANCHOR,
    bits: int = sieve.BITS,
    hot: int = HOT,
) -> DataFrame:
    """Cut out of each text the words covered by a window that also starts in a document with a smaller id.

    Returns ``doc_id, text``, the columns named in ``carry``, then ``kept_text`` (the text without the
    removed words and the white space after each), ``n_words``, ``n_removed`` and ``removed``, an array of
    (first word, number of words). Windows are judged on the input.

    A null text counts as empty and yields an empty ``kept_text``. Rows with a null id are returned whole
    and are no source for others. Rows that share an id do not remove each other's words; each is judged
    by itself. Other columns of ``docs``, whatever their names, are left out unless carried.
    """
    if not 0 < k < window:
        raise ValueError("an anchor must be shorter than the window")
    whole = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("text_key", F.hash("text"))
    found = repeated_windows(whole.filter("doc_id is not null"), window, k, bits, hot)
    starts = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    joined = whole.join(starts, ["doc_id", "text_key"], "left").drop("text_key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "starts")
    out = joined.mapInArrow(
        _cut(window),
        f"{kinds}, kept_text string, n_words long, n_removed long, removed array<struct<start: int, n: int>>",
    )
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
