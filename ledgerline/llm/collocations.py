"""Phrase collocations by weighted acyclic automata.

The n-grams of a shard (what a task has read, up to a bound) are sorted and made an automaton: a state for
each different beginning, an arc for each next word, the count on the last arc; states with the same arcs
are one. Shards are cut by ranges of beginnings and travel as automata; those of one range are united and
their weights summed. Parts of a phrase are looked up by composing the phrases with the counts, that is by
joins on the part.

Three passes, for one, two and three words. A phrase of ten occurrences has only parts of ten or more, so a
pass leaves out n-grams with a part that the pass before has found to be rarer. Parts that are not are kept
as a bitmap of fixed size; others may pass it too, which costs shuffle, not results, as counts are exact.

Scale: the texts are read three times and never shuffled; a shard sends each n-gram once. The ring of
beginnings is cut into ranges step by step, 256 at a time, until a range has a bounded share of all words;
between two steps the automata of a range are united up to the size of a shard, so that the pieces that
travel never get small. The continuations of one word are spread over a quarter of the ring, so no range
grows with a single frequent word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import sieve
from ledgerline.llm.shelf import shelve
from ledgerline.llm.ship import ship
from ledgerline.llm.words import Kind, Words, _letters, flat, mix, slices, spans

LEAST = 10
TOP = 2000
#: A phrase goes if a longer one holds at least this percentage of its occurrences.
HELD = 50
UNKNOWN = "und"
#: Different n-grams that a task gathers before it sends them.
SHARD = 1_000_000
#: Occurrences of words for which a range of beginnings is cut, and the ranges (as bits) of one step.
RANGE_WORDS = 1 << 21
STEP = 8
#: What ends a piece: these signs and line breaks; words are parted by spaces and tabs.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
PIECES = Kind([range(c, c + 1) for c in (0x09, 0x20, *np.flatnonzero(_BREAKS).tolist())], lower=True)


def _label_hashes(labels: pa.Array) -> np.ndarray:
    data, offsets = flat(labels.cast(pa.large_string()))
    return mix(spans(_letters()[data], offsets[:-1], offsets[1:]))


def _path_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of the labels of a path, in order."""
    out = mix(hashes[0] + np.uint64(0x632BE59BD9B4E019))
    for h in hashes[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def _place(hashes: list[np.ndarray]) -> np.ndarray:
    """A place on the ring: continuations of a beginning lie in a quarter of the ring behind it."""
    out = mix(hashes[0] * np.uint64(3) + hashes[1])
    for depth, h in enumerate(hashes[2:], 1):
        out = out + (mix(h + np.uint64(depth)) >> np.uint64(2 * depth))
    return out


class Counts:
    """A set of paths of labels with weights, in order, as columns of label numbers.

    The first label is the language, the others are words. Labels are sorted, each once.
    """

    def __init__(self, labels: pa.Array, columns: list[np.ndarray], weight: np.ndarray):
        self.labels, self.columns, self.weight = labels, columns, weight

    @classmethod
    def summed(cls, labels: pa.Array, columns: list[np.ndarray], weight: np.ndarray) -> Counts:
        """Equal paths become one, weights are added; paths and labels in order (labels may repeat)."""
        coded = labels.dictionary_encode()
        sort = pc.sort_indices(coded.dictionary)
        number = np.empty(len(coded.dictionary), np.int64)
        number[sort.to_numpy()] = np.arange(len(number))
        number = number[coded.indices.to_numpy(zero_copy_only=False)] if len(labels) else number
        # beginnings are told apart in order: as many labels as fit a key at once, then as their states
        each = max(len(number).bit_length(), 1)
        key, bits = np.zeros(len(weight), np.int64), 0
        for column in columns:
            if bits + each > 63:
                states, key = np.unique(key, return_inverse=True)
                bits = len(states).bit_length()
            key, bits = key << each | number[column], bits + each
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight[order], new) if len(key) else weight
        return cls(coded.dictionary.take(sort), [number[column[order[new]]] for column in columns], total)

    def hashes(self) -> list[np.ndarray]:
        each = _label_hashes(self.labels)
        return [each[c] for c in self.columns]

    def take(self, rows: np.ndarray) -> Counts:
        """Some paths, with the labels they use."""
        used, number = np.unique(np.concatenate([c[rows] for c in self.columns]), return_inverse=True)
        return Counts(self.labels.take(pa.array(used)), np.split(number, len(self.columns)), self.weight[rows])

    def automaton(self) -> bytes:
        """The paths as an automaton, from its last states to its first; equal states are stored once."""
        depth = len(self.columns)
        changes = np.zeros(len(self.weight), bool)
        starts = []
        for column in self.columns:
            changes = changes | np.append(True, column[1:] != column[:-1])
            starts.append(np.flatnonzero(changes))
        out = []
        label, value = self.columns[-1], self.weight
        for level in range(depth - 1, -1, -1):
            # arcs leave from the states that beginnings of this length lead to
            first = np.searchsorted(starts[level], starts[level - 1]) if level else np.zeros(1, np.int64)
            last = np.append(first[1:], len(label))
            sign = spans(mix(label.astype(np.uint64) << np.uint64(32) ^ value.astype(np.uint64)), first, last)
            _, pick, target = np.unique(mix(sign + (last - first).astype(np.uint64)), return_index=True, return_inverse=True)
            size = (last - first)[pick]
            arcs = np.arange(size.sum()) + np.repeat(first[pick] - np.cumsum(size) + size, size)
            out += [size, label[arcs], value[arcs]]
            if level:
                label, value = self.columns[level - 1][starts[level - 1]], target
        text, offsets = flat(self.labels.cast(pa.large_string()))
        return _packed([text, np.diff(offsets), *out])

    @classmethod
    def read(cls, blob: bytes) -> Counts:
        text, sizes, *rest = _unpacked(blob)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        labels = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text.tobytes()))
        columns: list[np.ndarray] = []
        state = np.zeros(1, np.int64)
        for level in range(len(rest) // 3 - 1, -1, -1):
            size, label, value = (x.astype(np.int64) for x in rest[3 * level : 3 * level + 3])
            many = size[state]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])[state]
            arcs = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            columns = [np.repeat(c, many) for c in columns] + [label[arcs]]
            state = value[arcs]
        return cls(labels, columns, state)


def _packed(arrays: list[np.ndarray]) -> bytes:
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype != np.uint8 or a is not arrays[0]:
            most = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
        head += [a.dtype.itemsize, len(a)]
        body.append(a.tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], "<i8")[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    head = np.frombuffer(raw[8 : 8 + 16 * n], "<i8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for width, size in head:
        out.append(np.frombuffer(raw[at : at + width * size], f"<u{width}"))
        at += width * size
    return out


def united(parts: list[Counts]) -> Counts:
    """The union of several automata: labels are matched, weights of equal paths added."""
    shift = np.cumsum([0, *(len(p.labels) for p in parts)])
    labels = pa.concat_arrays([p.labels.cast(pa.large_string()) for p in parts])
    columns = [np.concatenate([c + s for c, s in zip(cs, shift)]) for cs in zip(*(p.columns for p in parts))]
    return Counts.summed(labels, columns, np.concatenate([p.weight for p in parts]))


def _grams(part: pa.RecordBatch, size: int, seen: np.ndarray | None) -> Counts | None:
    """The n-grams of a few megabytes of text."""
    words = Words(*flat(part.column("text")), PIECES)
    n = len(words.start) - size + 1
    if n < 1:
        return None
    breaks = np.cumsum(_BREAKS[words.bytes])
    at, to = np.arange(n), np.arange(n) + size - 1
    # all words of an n-gram lie in one piece of one text
    ok = (words.row[at] == words.row[to]) & (breaks[words.start[at]] == breaks[words.start[to]])
    langs = part.column("lang")
    hash_of_lang = _label_hashes(langs.cast(pa.large_string()))
    if seen is not None:
        for part_at in (0, 1):
            path = [hash_of_lang[words.row[at]]] + [words.hash[at + part_at + j] for j in range(size - 1)]
            ok &= sieve.passes(seen, _path_hash(path))
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    inside = PIECES.keep[words.bytes]
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    text = pa.LargeStringArray.from_buffers(len(words.start), pa.py_buffer(ends), pa.py_buffer(words.bytes[inside].tobytes()))
    labels = pa.concat_arrays([langs.cast(pa.large_string()), text])
    # equal words of the slice once, so that columns are narrow
    columns = [words.row[at], *(len(langs) + at + j for j in range(size))]
    return Counts.summed(labels, columns, np.ones(len(at), np.int64))


class _Shard:
    """N-grams that a task gathers until there are enough of them, and sends by range."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.size = bits, [], 0

    def add(self, part: Counts) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.size += len(part.weight)
        if self.size > SHARD:
            self._unite()
            if self.size > SHARD / 2:
                yield from self.sent()

    def _unite(self) -> None:
        if len(self.parts) > 1:
            self.parts = [united(self.parts)]
        self.size = sum(len(p.weight) for p in self.parts)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._unite()
        (shard,), self.parts, self.size = self.parts, [], 0
        place = (_place(shard.hashes()) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        ranges, first = np.unique(place[order], return_index=True)
        blobs = [shard.take(rows).automaton() for rows in np.split(order, first[1:])]
        yield pa.record_batch([pa.array(ranges), pa.array(blobs, pa.binary())], names=["range", "automaton"])


_SHARDS = "range long, automaton binary"


def _shards(size: int, bits: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if seen is None else seen.value
        shard = _Shard(bits)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _grams(part, size, known)
                if found is not None:
                    yield from shard.add(found)
        yield from shard.sent()

    return run


def _finer(bits: int):
    """Cuts ranges into finer ones; rows come sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard(bits)
        for batch in batches:
            for number, blob in zip(batch.column("range").to_pylist(), batch.column("automaton").to_pylist()):
                if number != now:
                    yield from shard.sent()
                now = number
                yield from shard.add(Counts.read(blob))
        yield from shard.sent()

    return run


_TOTALS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("hash", pa.int64())])


def _unions(least: int, totals: bool):
    """Adds up the automata of a range; rows come sorted by range. Frequent paths, and each language's sum."""

    def rows(held: list[Counts]) -> pa.RecordBatch:
        whole = united(held)
        langs = whole.columns[0]
        strings = whole.labels.cast(pa.string())
        often = np.flatnonzero(whole.weight >= least)
        few = whole.take(often)
        words = np.stack(few.columns[1:], axis=1).ravel() if len(often) else np.zeros(0, np.int64)
        step = len(whole.columns) - 1
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(often) + 1, dtype=np.int32) * step), few.labels.cast(pa.string()).take(pa.array(words)))
        key = _path_hash(few.hashes()) if len(often) else np.zeros(0, np.uint64)
        parts = [few.labels.cast(pa.string()).take(pa.array(few.columns[0])), lists, pa.array(few.weight), pa.array(key.view(np.int64))]
        if totals:
            each = np.unique(langs)
            sums = np.zeros(len(strings), np.int64)
            np.add.at(sums, langs, whole.weight)
            more = [strings.take(pa.array(each)), pa.nulls(len(each), pa.list_(pa.string())), pa.array(sums[each]), pa.nulls(len(each), pa.int64())]
            parts = [pa.concat_arrays([a, b]) for a, b in zip(parts, more)]
        return pa.record_batch(parts, schema=_TOTALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for number, blob in zip(batch.column("range").to_pylist(), batch.column("automaton").to_pylist()):
                if number != now and held:
                    yield rows(held)
                    held = []
                now = number
                held.append(Counts.read(blob))
                if len(held) > 1 and sum(len(c.weight) for c in held) > SHARD and len(held[-1].weight) * 4 > len(held[0].weight):
                    held = [united(held)]
                elif len(held) > 256:
                    held = [united(held)]
        if held:
            yield rows(held)

    return run, "lang string, words array<string>, f long, hash long"


def count(docs: DataFrame, size: int, least: int, seen=None, bits: int = STEP) -> DataFrame:
    """``lang, words, f, hash`` of all n-grams of ``size`` words with at least ``least`` occurrences.

    For single words there is also a row without ``words`` for each language and range: a share of its sum.
    ``seen`` is a broadcast bitmap of frequent n-grams of one word less.
    """
    done = min(bits, STEP)
    shards = docs.mapInArrow(_shards(size, done, seen), _SHARDS).repartition("range").sortWithinPartitions("range")
    while done < bits:
        done = min(bits, done + STEP)
        shards = shards.mapInArrow(_finer(done), _SHARDS).repartition("range").sortWithinPartitions("range")
    run, schema = _unions(least, size == 1)
    return shelve(shards.mapInArrow(run, schema), f"phrases-{size}")


def _composed(phrases: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """The count ``out`` of each phrase's ``part``."""
    parts = counts.select(F.col("lang").alias("_lang"), F.col("words").alias("_part"), F.col("f").alias(out))
    return phrases.join(parts, (F.col("lang") == F.col("_lang")) & (F.expr(part) == F.col("_part"))).drop("_lang", "_part")


def _score(a: str, l: str, r: str):
    """floor(1000000 * a * a / (l * r)), exactly: products of numbers up to 10^15 fit into 38 digits."""
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
        f" div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))"
    )


def _near_top(found: DataFrame, top: int) -> DataFrame:
    """Rows that can be among the ``top`` highest scores of their language.

    Scores go up to 1000000, so a language has at most 1001 classes of them; what lies below the class in
    which the place ``top`` falls is left out before a language's rows come together.
    """
    classes = found.withColumn("_class", F.expr("score div 1000"))
    counts = classes.groupBy("lang", "_class").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("lang").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1))
    least = (
        counts.withColumn("_above", F.coalesce(above, F.lit(0)))
        .filter(F.col("_above") < top)
        .groupBy("lang")
        .agg(F.min("_class").alias("_least"))
    )
    return classes.join(least, "lang").filter("_class >= _least").drop("_class", "_least")


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    held: int = HELD,
    bits: int = sieve.BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of two and three words per language.

    A null text is empty; a null language is ``und``. Rows that repeat count each time. Equal scores are
    ranked by count, then by the phrase's bytes. A language without phrases has no rows, and an empty table
    gives none. Other columns play no part.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    rows = count(texts, 1, least)
    sums = rows.filter("words is null").groupBy("lang").agg(F.sum("f").alias("n"))
    every = sums.agg(F.sum("n")).first()[0] or 0
    ranges = min(max(STEP, (every // RANGE_WORDS).bit_length()), 48)
    sizes = [rows.filter("words is not null")]
    for size in (2, 3):
        seen = spark.sparkContext.broadcast(sieve.bitmap(sizes[-1], F.col("hash"), bits))
        sizes.append(count(texts, size, least, seen, ranges))
    one, two, three = sizes
    pairs = _composed(_composed(two, one, "slice(words, 1, 1)", "l"), one, "slice(words, 2, 1)", "r")
    pairs = pairs.withColumn("score", _score("f", "l", "r"))
    triples = functools.reduce(
        lambda df, x: _composed(df, *x),
        [
            (one, "slice(words, 1, 1)", "l1"),
            (two, "slice(words, 2, 2)", "r1"),
            (two, "slice(words, 1, 2)", "l2"),
            (one, "slice(words, 3, 1)", "r2"),
        ],
        three,
    ).withColumns({"s1": _score("f", "l1", "r1"), "s2": _score("f", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", "words", "f",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    inside = three.select("lang", "f", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("part"))
    longer = inside.groupBy("lang", "part").agg(F.max("f").alias("most")).withColumnRenamed("lang", "_lang")
    pairs = pairs.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("words") == F.col("part")), "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < held * F.col("f"))
    )
    both = pairs.select("lang", "words", "f", "l", "r", "score").union(triples)
    found = both.select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "l", "r", "score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _near_top(found, top).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
