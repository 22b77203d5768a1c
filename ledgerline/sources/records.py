"""Delimited text whose quoted values may hold line breaks, read by many tasks.

Whether a line break ends a record depends on all quotes before it in the file. So the quotes of each block
(a file split as Spark cuts it) are counted first, and a prefix scan over the blocks of a file tells whether
a block starts inside quotes. Then every block is cut into records alone; only what crosses an edge, at most
two pieces for each block, is shuffled and put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import durable

#: A record put together from several blocks may have this many bytes; pieces of a longer one (a quote that
#: is never closed) are broken rows each.
LONGEST = 64 << 20
WHOLE, HEAD, TAIL, OPEN = 0, 1, 2, 3
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )


def block_starts(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: 1 if a block starts within quotes; one row for each block."""
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    counts = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside"))


def _cutter():
    """Records of the blocks in a task; the lines of a block come in order, one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, opened, first = None, 0, [], False, False

        def left() -> list[tuple]:
            """What a block ends with: an unfinished record, or nothing but the middle of one."""
            if now is None or not held:
                return []
            return [(*now, OPEN if opened else TAIL, first, "\n".join(held))]

        for batch in batches:
            out: list[tuple] = []
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            starts, lines = batch.column("inside").to_pylist(), batch.column("line").to_pylist()
            odd = pc.bit_wise_and(pc.count_substring(batch.column("line"), '"'), 1).to_pylist()
            for file, block, start, line, turn in zip(files, blocks, starts, lines, odd):
                if (file, block) != now:
                    out += left()
                    now, inside, held = (file, block), start, []
                    # a block that starts within quotes starts with the end of an earlier block's record
                    opened, first = start == 1, block == 0
                held.append(line)
                inside ^= turn
                if not inside:
                    out.append((file, block, HEAD if opened else WHOLE, first, "\n".join(held)))
                    held, opened, first = [], False, False
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, _PIECES.types)], schema=_PIECES)
        if rest := left():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest), _PIECES.types)], schema=_PIECES)

    return run


def _joined(pieces: DataFrame, longest: int) -> DataFrame:
    """``first, record, broken`` of the records that cross blocks.

    In the order of the blocks a record is an unfinished piece, blocks without any end, and a first piece.
    """
    begins = (F.col("kind") == TAIL).cast("int")
    # the head of a block ends what came before it, also if the block ends with another unfinished record
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    parts = pieces.withColumn("part", F.sum(begins).over(order)).withColumn("bytes", F.octet_length("record"))
    sizes = parts.groupBy("file", "part").agg(F.sum("bytes").alias("all"), F.max(F.col("kind") == HEAD).alias("ended"))
    parts = parts.join(sizes, ["file", "part"])
    short = parts.filter(F.col("all") <= longest).groupBy("file", "part").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("rows"),
        F.max("ended").alias("ended"),
    )
    whole = short.select("first", F.array_join(F.transform("rows", lambda r: r["record"]), "\n").alias("record"), (~F.col("ended")).alias("broken"))
    return whole.union(parts.filter(F.col("all") > longest).select("first", "record", F.lit(True)))


def records(spark: SparkSession, path: str, longest: int = LONGEST) -> DataFrame:
    """``first, record, broken``: the records of text files, with the line breaks inside quotes as ``\\n``.

    ``first`` marks the record that a file starts with. A quote counts wherever it stands; a doubled one
    changes nothing. A record whose quotes are not closed at the end of its file, and each piece of one that
    has more than ``longest`` bytes over several blocks, is ``broken``. An empty file has no records.
    """
    lines = _lines(spark, path)
    # one small row for each block at most, as in the list of blocks that every scan is planned from; the join
    # leaves the lines where they are, in order
    starts = F.broadcast(block_starts(lines).filter("inside = 1"))
    placed = lines.join(starts, ["file", "block"], "left").select("file", "block", F.coalesce("inside", F.lit(0)).alias("inside"), "line")
    pieces = placed.mapInArrow(_cutter(), "file string, block long, kind int, first boolean, record string")
    whole = pieces.filter(F.col("kind") == WHOLE).select("first", "record", F.lit(False).alias("broken"))
    # at most two for each block; written down, as three steps read them
    return whole.union(_joined(durable(pieces.filter(F.col("kind") != WHOLE)), longest))
