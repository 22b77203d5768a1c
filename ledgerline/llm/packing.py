"""Packing documents into training sequences as a cutting-stock problem, by column generation.

A document's ids are cut into pieces of a whole sequence and a rest. Rests fall into length classes (at
most 1/64 of a length apart); a pattern says how many pieces of each class share a sequence. A linear
program over patterns covers the histogram of classes with the fewest sequences; its columns come from a
knapsack solved by dynamic programming over the current prices. Patterns that fill a sequence well are
used as often as the rounded solution says, and the documents, ranked within their class, take the places
they offer. The pieces left, of classes that don't combine, are cut where sequences end: laid one after
the other they fill sequences completely, the very last ones being powers of two.

The histogram, the program and the patterns have a size fixed by the sequence length, whatever the
number of documents; only they are on the driver. Ranks and places come from sums by task and class, so
no class is gathered anywhere, and a sequence has at most ``size`` pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.shelf import shelve
from ledgerline.llm.ship import ship
from ledgerline.llm.tokens import encoder
from ledgerline.llm.words import flat, slices

SIZE = 2048
KEPT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Stop when the program is within this share of its lower bound.
GAP = 2e-3
#: Rounds of column generation at most; fewer leave more pieces to be cut, not to be padded.
ROUNDS = 600
#: Share of a sequence that a pattern's longest pieces must fill for the pattern to be used.
FILL = 0.99


def class_limits(size: int, fine: int = 64) -> np.ndarray:
    """The largest length of each class: single lengths up to ``2 * fine``, then ``fine`` classes for each
    doubling; ``size`` is one."""
    limits, step, at = list(range(1, min(2 * fine, size) + 1)), 2, 2 * fine
    while at < size:
        limits += range(at + step, min(2 * at, size) + 1, step)
        step, at = step * 2, at * 2
    return np.array(sorted({*limits, size}))


def knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pieces of the highest total price that fit into ``size``, each any number of times."""
    best = np.zeros(size + 1)
    use = np.flatnonzero(prices > 1e-12)
    use = use[np.argsort(lengths[use])]
    if len(use):
        # a length that costs more room for no higher price is never needed
        use = use[np.append(True, prices[use][1:] > np.maximum.accumulate(prices[use])[:-1] + 1e-15)]
    for i in use:
        # 1, 2, 4, ... pieces of a length at once, so that few steps reach any number
        room, price = int(lengths[i]), prices[i]
        while room <= size:
            np.maximum(best[room:], best[: size + 1 - room] + price, out=best[room:])
            room, price = 2 * room, 2 * price
    counts, at, tolerance = np.zeros(len(lengths), np.int64), size, 1e-11
    while best[at] > tolerance:
        fits = use[lengths[use] <= at]
        short = best[at] - best[at - lengths[fits]] - prices[fits]
        i = fits[int(np.argmin(short))]
        counts[i] += 1
        at -= int(lengths[i])
    return float(prices @ counts), counts


def relaxed(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = GAP, rounds: int = ROUNDS):
    """Patterns (columns) and how often each is used, of the linear program; by revised simplex, the first
    basis being the patterns of a single class."""
    m = len(lengths)
    columns = np.diag(size // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    bound = 0.0
    for turn in range(rounds):
        prices = np.full(m, 1.0) @ inverse
        value, pattern = knapsack(lengths, np.maximum(prices, 0), size)
        total = use.sum()
        # every sequence is worth ``value`` at most, which bounds the number of sequences from below
        bound = max(bound, float(prices @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or total - bound <= gap * total:
            break
        change = inverse @ pattern
        rising = change > 1e-9
        ratio = np.where(rising, use / np.where(rising, change, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = np.maximum(use - step * change, 0)
        use[out] = step
        columns[:, out] = pattern
        pivot = inverse[out] / change[out]
        inverse = inverse - np.outer(change, pivot)
        inverse[out] = pivot
        if turn % 200 == 199:
            inverse = np.linalg.inv(columns)
            use = np.maximum(inverse @ demand, 0)
    return columns.astype(np.int64), use


def plan(lengths: np.ndarray, demand: np.ndarray, size: int, fill: float = FILL) -> tuple[np.ndarray, np.ndarray]:
    """Well-filled patterns as rows, and how many sequences of each; they use up to the demand."""
    have = np.flatnonzero(demand)
    rows, counts = [], []
    if len(have):
        columns, use = relaxed(lengths[have], demand[have].astype(float), size)
        left = demand[have].copy()
        good = lengths[have] @ columns >= fill * size
        for j in np.flatnonzero(good)[np.argsort(-use[good])]:
            parts = np.flatnonzero(columns[:, j])
            n = min(int(round(use[j])), int((left[parts] // columns[parts, j]).min()))
            if n > 0:
                rows.append(columns[:, j])
                counts.append(n)
                left = left - n * columns[:, j]
    full = np.zeros((len(rows), len(lengths)), np.int64)
    if rows:
        full[:, have] = np.array(rows)
    return full, np.array(counts, np.int64)


def ends(total: int, size: int) -> np.ndarray:
    """Where sequences end in a run of ``total`` ids: whole ones, then powers of two."""
    tail = total % size
    powers = [1 << b for b in reversed(range(size.bit_length())) if tail >> b & 1]
    return (total - tail) + np.cumsum([0, *powers])


def _kept() -> list[str]:
    return [c.split()[0] for c in KEPT.split(", ")]


def _of_kind(values: np.ndarray) -> Column:
    """The value of a row's class. One literal, as hundreds of them fill the driver with copies of the plan."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",")[F.col("kind")].cast("long")


def _pieces(vocabulary: str, size: int, end: int, limits: np.ndarray):
    schema = pa.schema(
        [("task", pa.int32()), ("nth", pa.int64()), ("before", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64())]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
        + [("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = "<u2" if encoder(vocabulary, ordinary=False).width.size <= 1 << 16 else "<u4"
        task = TaskContext.get().partitionId()
        seen, passed = np.zeros(len(limits), np.int64), np.zeros(len(limits), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, where = encoder(vocabulary, ordinary=False).encode(*flat(part.column("text")))
                ids = np.insert(ids, where[1:], end).astype("<u4")
                where = where + np.arange(len(where))
                total = np.diff(where)
                n = -(-total // size)
                row = np.repeat(np.arange(part.num_rows), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(total[row] - start, size)
                kind = np.searchsorted(limits, length)
                # pieces and ids of the same class that this task has had before
                order = np.argsort(kind, kind="stable")
                counts = np.bincount(kind, minlength=len(limits))
                reach = np.concatenate([[0], np.cumsum(length[order])])
                first = np.repeat(np.cumsum(counts) - counts, counts)
                nth, before = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
                nth[order] = np.arange(len(kind)) - first + seen[kind[order]]
                before[order] = reach[:-1] - reach[first] + passed[kind[order]]
                seen += counts
                passed += np.bincount(kind, weights=length, minlength=len(limits)).astype(np.int64)
                raw, at = ids.tobytes(), where[row] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                small, step = ids.astype(wide).tobytes(), np.dtype(wide).itemsize
                rests = [
                    small[step * a : step * (a + k)] if k < size else None for a, k in zip(at.tolist(), length.tolist())
                ]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(row), task, np.int32)),
                        pa.array(nth),
                        pa.array(before),
                        pa.array(kind.astype(np.int32)),
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                        pa.array(total[row]),
                        pa.array(rests, pa.binary()),
                    ],
                    schema=schema,
                )

    return run, f"task int, nth long, before long, kind int, {KEPT}, ids binary"


def _places(limits: np.ndarray, patterns: np.ndarray, counts: np.ndarray):
    """Gives the piece of each rank in each class its sequence: the places that patterns offer for a class
    follow each other, pattern by pattern and sequence by sequence."""
    base = np.concatenate([[0], np.cumsum(counts)])
    offers = []
    for kind in range(len(limits)):
        which = np.flatnonzero(patterns[:, kind])
        each = patterns[which, kind]
        offers.append((np.concatenate([[0], np.cumsum(each * counts[which])]), each, base[which]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                at = np.flatnonzero(kind == k)
                reach, each, first = offers[k]
                which = np.searchsorted(reach, rank[at], "right") - 1
                inside = rank[at] - reach[which]
                sequence[at] = first[which] + inside // each[which]
                slot[at] = inside % each[which]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"]
            )

    return run


def _cut(total: int, size: int, first: int):
    """Cuts pieces, laid out from ``at`` in a run of ``total`` ids, where sequences end."""
    tail = ends(total, size)
    whole = int(tail[0]) // size
    names = [*_kept(), "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, start, length, doc_tokens, at, raw in zip(
                *(batch.column(n).to_pylist() for n in ("doc_id", "start", "length", "doc_tokens", "at", "ids"))
            ):
                ids, done = np.frombuffer(raw, f"<u{len(raw) // length}").astype("<u4"), 0
                while done < length:
                    here = at + done
                    if here < tail[0]:
                        sequence, begins = here // size, here // size * size
                        stops = begins + size
                    else:
                        i = int(np.searchsorted(tail, here, "right")) - 1
                        sequence, begins, stops = whole + i, int(tail[i]), int(tail[i + 1])
                    n = min(length - done, stops - here)
                    rows.append(
                        (doc_id, start + done, n, zlib.crc32(ids[done : done + n].tobytes()), doc_tokens, first + sequence, here - begins)
                    )
                    done += n
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end: int = 1,
    fill: float = FILL,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is the text of a tokenizer file; ``end`` is the id put after each document. Strings of added
    tokens in a text become their ids. ``start``
    counts the document's ids before the piece, ``offset`` the ids of the sequence before it. A null or
    empty text is the end id alone. Repeated rows and rows without an id are packed like any other. Pieces
    of one class are taken in the order in which tasks read them. An empty table gives no rows. Other
    columns play no part.
    """
    spark = ship(docs.sparkSession)
    limits = class_limits(size)
    rows, schema = _pieces(vocabulary, size, end, limits)
    pieces = shelve(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema),
        "pieces",
    )
    by_task = pieces.groupBy("kind", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_task.select("kind", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    demand = np.zeros(len(limits), np.int64)
    for row in by_task.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        demand[row["kind"]] = row["n"]
    patterns, counts = plan(limits, demand, size, fill)
    offered = _of_kind(counts @ patterns)
    ranked = pieces.join(shifts, ["kind", "task"]).withColumn("rank", F.col("nth") + F.col("shift"))

    placed = (
        ranked.filter(F.col("rank") < offered)
        .select("kind", *_kept(), "rank")
        .mapInArrow(_places(limits, patterns, counts), f"kind int, {KEPT}, sequence_id long, slot long")
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("kind", "slot")

    loose = ranked.filter(F.col("rank") >= offered)
    runs = loose.groupBy("kind", "task").agg(F.min("before").alias("first"), F.sum("length").alias("ids"))
    of_kind = {r["kind"]: r["ids"] for r in runs.groupBy("kind").agg(F.sum("ids").alias("ids")).collect()}
    total = sum(of_kind.values())
    if not total:
        return whole
    sums = np.concatenate([[0], np.cumsum([of_kind.get(k, 0) for k in range(len(limits))])])
    base = _of_kind(sums)
    runs = runs.select(
        "kind", "task", (base + F.coalesce(F.sum("ids").over(earlier), F.lit(0)) - F.col("first")).alias("move")
    )
    cut = (
        loose.join(runs, ["kind", "task"])
        .select(*_kept(), (F.col("before") + F.col("move")).alias("at"), "ids")
        .mapInArrow(_cut(total, size, int(counts.sum())), f"{KEPT}, sequence_id long, offset long")
    )
    return whole.union(cut)
