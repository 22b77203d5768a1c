"""Ranked lexical search by dense blocked matrix products.

Documents become vectors over the terms that the items ask for, and are written down once. Then blocks of
documents times blocks of items are multiplied: a tile of impacts (documents by the terms of a few items)
with a tile of weights (those terms by the items), in float64. All entries are whole numbers, and the
terms of a tile are cut where a sum could pass 2^53, so every product is exact whatever the order of its
sums; sums of several tiles are 64-bit integers. Of each block an item keeps the documents that reach its
twentieth score, ties included, and a task keeps one list for each item.

Scale: the texts are read once for each group of items; the items of a group hold at most ``GROUP``
bytes of text (or are one item) and only they and their weights are sent to the tasks. What is shuffled
is a count for each asked term and task, and twenty rows for each item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.shelf import shelve
from ledgerline.llm.ship import ship
from ledgerline.llm.words import ALNUM, Words, _letters, flat, mix, slices, spans

TOP = 20
#: Bytes of item texts that are looked up in one pass over the documents.
GROUP = 8 << 20
#: Items and documents of a tile.
ITEMS, DOCS = 64, 1024
#: Largest number of terms of a tile; a tile of impacts then has at most 16 MB.
TERMS = 2048
#: An impact is below this, as 1000 * tf is less than what it is divided by.
_IMPACT = 1_000_000
_EXACT = 1 << 53


def _check(words: Words, at: np.ndarray) -> np.ndarray:
    """A second hash of the words at ``at``."""
    values = _letters()[words.bytes]
    return mix(spans(values ^ (values >> np.uint64(19)), words.start[at], words.end[at]) + np.uint64(7))


class Asked:
    """Items of a group as counts of terms; terms are numbered in the order of their hashes."""

    def __init__(self, texts: list[str]):
        words = Words(*flat(pa.array(texts, pa.string())), ALNUM)
        self.hash, first, term = np.unique(words.hash, return_index=True, return_inverse=True)
        self.check = _check(words, first)
        pair, self.count = np.unique(words.row.astype(np.int64) << 32 | term, return_counts=True)
        self.item, self.term = pair >> 32, pair & 0xFFFFFFFF
        self.items = len(texts)

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Rows and terms of the words that are asked for."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[place] == words.hash)
        at = at[_check(words, at) == self.check[place[at]]]
        return words.row[at], place[at]

    def tiles(self, weight: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each few items their numbers and tiles: terms, and weights of those terms by item.

        A tile has at most ``TERMS`` terms and no item's weights times the largest impact pass 2^53 in it.
        A single weight that would is split over several tiles.
        """
        most = _EXACT // _IMPACT
        out = []
        for a in range(0, self.items, ITEMS):
            here = (self.item >= a) & (self.item < a + ITEMS)
            item, term = self.item[here] - a, self.term[here]
            left = self.count[here] * weight[term]
            item, term, left = item[left > 0], term[left > 0], left[left > 0]
            parts = []
            while len(term):
                cap = np.minimum(left, most - 1)
                order = np.lexsort((term, item))
                # what the items have taken before, in order of their terms
                total = np.cumsum(cap[order])
                new = np.append(True, item[order][1:] != item[order][:-1])
                before = total - cap[order]
                total -= before[np.flatnonzero(new)][np.cumsum(new) - 1]
                fits = np.zeros(len(term), bool)
                fits[order] = total < most
                terms = np.unique(term[fits])[:TERMS]
                fits &= np.isin(term, terms)
                tile = np.zeros((len(terms), min(ITEMS, self.items - a)))
                tile[np.searchsorted(terms, term[fits]), item[fits]] = cap[fits]
                parts.append((terms, tile))
                left = left - np.where(fits, cap, 0)
                item, term, left = item[left > 0], term[left > 0], left[left > 0]
            out.append((np.arange(a, min(a + ITEMS, self.items)), parts))
        return out


_VECTORS = "doc_id long, n long, terms binary, counts binary"


def _vectors(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), ALNUM)
                row, term = asked.value.look_up(words)
                pair, count = np.unique(row << 32 | term, return_counts=True)
                filled = np.flatnonzero(words.count)
                at = np.searchsorted(pair, np.append(filled, part.num_rows) << 32) * 4
                terms, counts = (pair & 0xFFFFFFFF).astype("<u4").tobytes(), count.astype("<u4").tobytes()
                cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(filled)),
                        pa.array(words.count[filled].astype(np.int64)),
                        pa.array([terms[a:b] for a, b in cut], pa.binary()),
                        pa.array([counts[a:b] for a, b in cut], pa.binary()),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


def _joined(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column one after the other, and the row of each."""
    rows = batch.column(column).to_pylist()
    values = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
    return values, np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])


def _frequencies(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(_joined(batch, "terms")[0], minlength=terms)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], names=["term", "df"])

    return run


class _Best:
    """The best rows of each item so far: score, then document id (null last)."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.rows = [np.zeros((4, 0), np.int64)]  # item, score, document, whether it has no id

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Scores by document and item; rows below the item's last place can't come in, equal ones can."""
        least = self.least[items]
        if len(ids) > self.top:
            least = np.maximum(least, np.partition(scores, -self.top, axis=0)[-self.top])
        doc, item = np.nonzero(scores >= least)
        self.rows.append(np.stack([items[item], scores[doc, item], ids[doc], missing[doc]]))

    def settle(self) -> np.ndarray:
        """Keep the first rows of each item."""
        rows = np.concatenate(self.rows, axis=1)
        item, score, doc, missing = rows
        order = np.lexsort((doc, missing, -score, item))
        rows = rows[:, order]
        new = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if rows.shape[1] else np.zeros(0, np.int64)
        nth = np.arange(rows.shape[1]) - np.repeat(new, np.diff(np.append(new, rows.shape[1])))
        full = nth == self.top - 1
        self.least[rows[0][full]] = np.maximum(rows[1][full], 1)
        rows = rows[:, nth < self.top]
        self.rows = [rows]
        return rows


def _scores(model, docs: int, length: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, tiles = model.value
        best = _Best(items, top)
        local = np.full(terms, -1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                term, row = _joined(batch, "terms")
                tf, _ = _joined(batch, "counts")
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                m = 75 + (25 * n * docs) // length
                impact = ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row])).astype(np.float64)
                ids = batch.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for of, parts in tiles:
                    scores = np.zeros((batch.num_rows, len(of)), np.int64)
                    for asked, weights in parts:
                        local[asked] = np.arange(len(asked))
                        place = local[term]
                        on = np.flatnonzero(place >= 0)
                        tile = np.zeros((batch.num_rows, len(asked)))
                        tile[row[on], place[on]] = impact[on]
                        scores += (tile @ weights).astype(np.int64)
                        local[asked] = -1
                    best.add(of, scores, ids, missing)
                best.settle()
        item, score, doc, missing = best.settle()
        yield pa.record_batch(
            [pa.array(item), pa.array(score), pa.array(doc, mask=missing.astype(bool))], names=["item", "score", "doc_id"]
        )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    group: int = GROUP,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0.

    Equal scores are ranked by ascending ``doc_id``, a null id last. Every row of ``docs`` is a document of
    its own, also where ids or texts repeat; null and empty texts have no terms, are not counted and are
    never found. Items equal in id and text count once; different texts under one id (or without an id) are
    ranked on their own. Items without terms have no rows, and without documents no item has. Other columns
    play no part.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    asked = asked.filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / group))
    found = spark.createDataFrame([], "item_id long, item long, doc_id long, score long")
    for number in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == number)
        found = found.union(_ranked(texts, part, top).withColumn("item", F.col("item") + (number << 32)))
    first = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )


def _ranked(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """The best rows of each task for the items of a group."""
    spark = docs.sparkSession
    # a group's texts are bounded by GROUP bytes, about; that is what the driver sees
    rows = sorted(items.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
    names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], "item long, item_id long")
    asked = Asked([r["text"] for r in rows])
    vectors = shelve(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(asked)), _VECTORS), "term-vectors")
    total = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(asked.hash), np.int64)
    if len(df):
        held = vectors.select("terms").mapInArrow(_frequencies(len(df)), "term long, df long")
        for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    model = spark.sparkContext.broadcast((asked.items, len(df), asked.tiles(weight)))
    run = _scores(model, total[0], max(total[1] or 0, 1), top)
    best = vectors.mapInArrow(run, "item long, score long, doc_id long")
    # one name for each item of the group, bounded as the group is
    return best.join(F.broadcast(names), "item").select("item_id", "item", "doc_id", "score")
