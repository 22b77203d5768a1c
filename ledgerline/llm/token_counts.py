"""Token counts by separator scan.

A flat token file is a run of ids without an index: documents end at an end-of-document id and nothing
says where. Files come as blocks, cut anywhere: ``file``, ``block`` (its number in the file) and ``ids``
(little-endian, two bytes each by default). Each block is searched for the separator by itself; what it leaves open, the
ids after its last separator, is carried to the blocks after it by a prefix scan over block summaries.

The scan runs on one small row per block, in two levels: within groups of ``GROUP`` blocks, then over the
groups' totals, so that a file of any length leaves no task more than one group of blocks or one group's
worth of totals for each ``GROUP`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.llm.shelf import shelve
from ledgerline.llm.ship import ship
from ledgerline.llm.tokens import encoder
from ledgerline.llm.words import flat, slices
from ledgerline.session import durable

#: Ids in a block as this module writes them.
BLOCK = 1 << 16
#: Blocks in a group of the prefix scan.
GROUP = 1 << 12


def flatten(docs: DataFrame, vocabulary: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Flat token files of the texts, one file for each task, without an index.

    ``file, block, ids`` rows are the files; ``file, ordinal, doc_id`` rows say which document is a file's
    n-th, as a list beside the files does. A null text counts as empty. The result is meant to be written
    once and reread, as its files are named after tasks. Two bytes hold the ids of a vocabulary of 65,536.
    """
    ship(docs.sparkSession)
    names = ["file", "block", "ids", "ordinal", "doc_id"]
    kind = f"<u{width}"
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, nth, rest = TaskContext.get().partitionId(), 0, 0, np.zeros(0, kind)

        def blocks(ids: np.ndarray, n: int) -> pa.RecordBatch:
            nonlocal at
            parts = [ids[i : i + block].tobytes() for i in range(0, len(ids), block)][:n]
            numbers = pa.array(range(at, at + len(parts)), pa.int64())
            at += len(parts)
            k = len(parts)
            return pa.record_batch(
                [pa.array([file] * k, pa.int32()), numbers, pa.array(parts, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                schema=schema,
            )

        for batch in batches:
            for part in slices(batch, "text"):
                ids, where = encoder(vocabulary).encode(*flat(part.column("text")))
                n = part.num_rows
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                rest = np.concatenate([rest, np.insert(ids, where[1:], separator).astype(kind)])
                full = len(rest) // block
                if full:
                    yield blocks(rest[: full * block], full)
                    rest = rest[full * block :]
                yield pa.record_batch(
                    [pa.array([file] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(nth, nth + n)), part.column("doc_id")],
                    schema=schema,
                )
                nth += n
        if len(rest):
            yield blocks(rest, 1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        run, "file int, block long, ids binary, ordinal long, doc_id long"
    )


def blocks_of(files: DataFrame, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file, block, ids`` of token files as Spark's ``binaryFile`` source reads them (``path, content``);
    a file is named by a hash of its path. That source reads files of up to 2 GB."""
    step = block * width
    return files.filter("length(content) > 0").select(
        F.hash("path").alias("file"),
        F.col("content"),
        F.explode(F.expr(f"sequence(0L, cast((length(content) - 1) div {step} as bigint))")).alias("block"),
    ).select(
        "file", "block", F.expr(f"substring(content, cast(block * {step} + 1 as int), {step})").alias("ids")
    )


def _search(separator: int, width: int):
    schema = pa.schema(
        [("file", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", f"<u{width}")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.record_batch(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def separator_scan(blocks: DataFrame, separator: int, width: int = 2, group: int = GROUP) -> DataFrame:
    """``file, ordinal, start, n_tokens``: each document of each file, in file order, with the place of its
    first id in the file and its number of ids, the separator included.

    Ids after a file's last separator are a document too, without a separator. A null or empty block holds
    nothing. Blocks are taken in the order of their numbers, which need not be gapless; of rows that repeat
    a block's number one is read. ``width`` is the bytes of an id. An empty table gives no rows.
    """
    ship(blocks.sparkSession)
    found = durable(
        blocks.select("file", F.col("block").cast("long").alias("block"), "ids").mapInArrow(
            _search(separator, width), "file int, block long, size long, ends array<long>"
        )
        .dropDuplicates(["file", "block"])
    )
    part = F.floor(F.col("block") / group).alias("part")
    short = found.select(
        "file",
        "block",
        part,
        "size",
        F.size("ends").cast("long").alias("n"),
        F.when(F.size("ends") > 0, F.try_element_at("ends", F.lit(-1)) + 1).alias("last"),
    )

    def before(by: list[str], order: str) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    inner = before(["file", "part"], "block")
    short = short.select(
        "file",
        "block",
        "part",
        F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("ids_before"),
        F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("ends_before"),
        "size",
        "n",
        "last",
    ).withColumn(
        "open_at", F.last(F.when(F.col("n") > 0, F.col("ids_before") + F.col("last")), ignorenulls=True).over(inner)
    )
    totals = short.groupBy("file", "part").agg(
        F.sum("size").alias("size"),
        F.sum("n").alias("n"),
        F.max(F.when(F.col("n") > 0, F.col("ids_before") + F.col("last"))).alias("last"),
    )
    outer = before(["file"], "part")
    totals = totals.select(
        "file",
        "part",
        F.coalesce(F.sum("size").over(outer), F.lit(0)).alias("part_ids"),
        F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("part_ends"),
        "last",
    )
    totals = totals.withColumn(
        "part_open", F.coalesce(F.max(F.col("part_ids") + F.col("last")).over(outer), F.lit(0))
    ).drop("last")
    carried = short.join(totals, ["file", "part"]).select(
        "file",
        "block",
        (F.col("part_ids") + F.col("ids_before")).alias("base"),
        (F.col("part_ends") + F.col("ends_before")).alias("nth"),
        F.coalesce(F.col("part_ids") + F.col("open_at"), "part_open").alias("open"),
    )
    placed = found.join(carried, ["file", "block"])
    ends = placed.select("file", "base", "nth", "open", "ends", F.posexplode("ends").alias("i", "end"))
    closed = ends.select(
        "file",
        (F.col("nth") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open"))
        .otherwise(F.col("base") + F.try_element_at("ends", F.col("i")) + 1)
        .alias("start"),
        (F.col("base") + F.col("end") + 1).alias("stop"),
    ).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    whole = carried.join(found.select("file", "block", "size", "ends"), ["file", "block"])
    tails = (
        whole.groupBy("file")
        .agg(
            F.max(F.col("base") + F.col("size")).alias("length"),
            F.max(F.col("nth") + F.size("ends")).alias("ordinal"),
            F.max(F.when(F.size("ends") > 0, F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1)).alias("closed"),
        )
        .select("file", "ordinal", F.coalesce("closed", F.lit(0)).alias("start"), "length")
        .filter("length > start")
        .select("file", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("length") - F.col("start")).alias("n_tokens"))
    )
    return closed.union(tails)


def count_tokens(docs: DataFrame, vocabulary: str, separator: int) -> DataFrame:
    """``doc_id, n_tokens, file, start``: the ids of each text with its separator, found again in the flat
    files made of all texts. The separator must be an id that no text yields."""
    files = shelve(flatten(docs, vocabulary, separator), "tokens")
    scanned = separator_scan(files.filter("block is not null"), separator)
    listed = files.filter("ordinal is not null").select("file", "ordinal", "doc_id")
    return listed.join(scanned, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
