"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits share a partition. Two fingerprints within ``d`` bits
agree to within ``t_i`` bits in some partition ``i`` whenever the ``t_i + 1`` add up to ``d + 1`` (a
partition with -1 is not probed). Each fingerprint gets its own thresholds: dynamic programming over the
partitions minimises probes plus candidates, estimated from value counts of the partitions' bytes over
all fingerprints. Probes meet the indexed partition values in an equi-join, and the whole fingerprints
are compared.

Exact copies fall together before anything else: the search sees different fingerprints only. Where
more than ``bucket`` fingerprints share a partition value, their own pairs are not enumerated: they and
the fingerprints that probe them are linked by shared neighbours at one bit's distance (two fingerprints
are within 2a bits when a flip of up to a bits takes both to one value), 1 + 64 rows each for d <= 2, so
no group makes a number of rows that grows with its square. Links are contracted to components by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.ship import ship
from ledgerline.llm.words import Kind, Words, flat, slices
from ledgerline.session import durable

#: Words between ASCII white space, A-Z as a-z.
FOLDED = Kind([range(0x09, 0x0E), range(0x20, 0x21)], lower=True)
SEED = 42
BITS = 64
BUCKET = 128


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and its row; a row of fewer words has one shingle, a row of none has none."""
    inside = np.bincount(words.start, minlength=len(words.bytes) + 1) - np.bincount(words.end, minlength=len(words.bytes) + 1)
    keep = np.cumsum(inside)[:-1] > 0
    gap = words.end[words.end < len(keep)]
    space = gap[~keep[gap]]
    keep[space] = True
    text = words.bytes.copy()
    text[space] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    start, end = place[words.start], place[words.end]
    data = text[keep].tobytes()
    full = np.flatnonzero(words.whole(size))
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    first = np.concatenate([full, words.first[short]])
    last = np.concatenate([full + size - 1, words.first[short] + words.count[short] - 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())]
    return np.array(hashes, np.uint64), np.concatenate([words.row[full], short])


def majority_bits(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row the bits that are set in over half of its hashes; zero without hashes."""
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    n = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    have = np.flatnonzero(n)
    if len(have):
        starts = np.concatenate([[0], np.cumsum(n[have])[:-1]])
        for bit in range(BITS):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
            out[have] |= (2 * ones > n[have].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*flat(part.column("text")), FOLDED)
                found = majority_bits(*shingle_hashes(words, size), part.num_rows)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_key"), pa.array(found.view(np.int64))],
                    ["doc_id", "text_key", "fingerprint"],
                )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, text_key, fingerprint`` (64 bits as a long); ``text_key`` is ``xxhash64`` of the text. A null
    or empty text has fingerprint zero."""
    ship(docs.sparkSession)
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")
    ).mapInArrow(_fingerprints(size), "doc_id long, text_key long, fingerprint long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = _bits(batch.column("fingerprint").to_numpy(zero_copy_only=False)).astype(np.float32)
        for at in range(0, len(bits), 1 << 20):
            total += bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]
        n += len(bits)
    if n:
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])


def correlated_partitions(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits grouped by correlation: a group grows by the bit that correlates most with its members."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    strength = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        want = BITS // parts + (i < BITS % parts)
        rest = sorted(free)
        group = [rest[int(np.argmax(strength[np.ix_(rest, rest)].max(axis=1)))]]
        while len(group) < want:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].mean(axis=1)))])
        groups.append(sorted(group))
        free -= set(group)
    return groups


def masks(width: int, most: int) -> list[int]:
    """All flips of up to ``most`` of ``width`` bits, fewer first."""
    return [sum(1 << b for b in c) for t in range(most + 1) for c in combinations(range(width), t)]


def _variants(width: int, t: int) -> int:
    return len(masks(width, t)) if t >= 0 else 0


def choose_parts(n: int, distance: int) -> int:
    """The number of partitions with the least probes and candidates for ``n`` evenly spread fingerprints."""

    def cost(parts: int) -> float:
        width = BITS // parts
        each = [0.0] + [_variants(width, t) * (1 + n / 2.0**width) for t in range(distance + 1)]
        best = [0.0] + [np.inf] * (distance + 1)
        for _ in range(parts):
            best = [min(best[b - s] + each[s] for s in range(b + 1)) for b in range(distance + 2)]
        return best[-1] + parts

    return min(range(1, distance + 2), key=cost)


def extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, packed in order."""
    out = np.zeros(len(values), np.uint64)
    for to, at in enumerate(bits):
        out |= ((values >> np.uint64(at)) & np.uint64(1)) << np.uint64(to)
    return out


def near_counts(keys: np.ndarray, width: int, histogram: list[np.ndarray], n: int, distance: int) -> np.ndarray:
    """Estimated fingerprints within 0..distance bits of each key in one partition, from the counts of its
    bytes taken as independent: rows are keys, columns distances."""
    spread = np.zeros((len(keys), distance + 1))
    spread[:, 0] = 1.0
    values = np.arange(256)
    for block, counts in enumerate(histogram):
        far = np.bitwise_count(np.bitwise_xor.outer(values, values))
        share = np.stack([(counts * (far == d)).sum(axis=1) / max(n, 1) for d in range(distance + 1)], axis=1)
        mine = share[((keys >> np.uint64(8 * block)) & np.uint64(255)).astype(np.int64)]
        spread = np.stack([(spread[:, : d + 1] * mine[:, d::-1]).sum(axis=1) for d in range(distance + 1)], axis=1)
    return np.cumsum(spread, axis=1) * n


def allocate(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds of least cost for each fingerprint, by dynamic programming over the partitions.

    ``costs[i][:, t]`` is the cost of probing partition i with threshold t; -1 costs nothing. The
    thresholds plus one add up to ``distance + 1``.
    """
    n, goal = len(costs[0]), distance + 1
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        step = np.concatenate([np.zeros((n, 1)), cost], axis=1)
        options = np.full((goal + 1, n, goal + 1), np.inf)
        for spend in range(goal + 1):
            options[spend, :, spend:] = best[:, : goal + 1 - spend] + step[:, spend : spend + 1]
        picks.append(options.argmin(axis=0))
        best = options.min(axis=0)
    left, out = np.full(n, goal), np.zeros((n, len(costs)), np.int64)
    for i in reversed(range(len(costs))):
        out[:, i] = picks[i][np.arange(n), left]
        left = left - out[:, i]
    return out - 1


def _rows(part: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))],
        ["part", "key", "fingerprint"],
    )


def _index(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for part, bits in enumerate(groups):
                yield _rows(part, extract(values, bits), values)

    return run


def _probes(groups: list[list[int]], histograms: list[list[np.ndarray]], n: int, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [np.array(masks(len(bits), distance), np.uint64) for bits in groups]
        sizes = [np.array([_variants(len(bits), t) for t in range(distance + 1)]) for bits in groups]
        for batch in batches:
            every = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2000):
                values = every[at : at + 2000]
                keys = [extract(values, bits) for bits in groups]
                costs = [
                    sizes[i] + near_counts(keys[i], len(bits), histograms[i], n, distance)
                    for i, bits in enumerate(groups)
                ]
                thresholds = allocate(costs, distance)
                for part in range(len(groups)):
                    for t in range(distance + 1):
                        which = np.flatnonzero(thresholds[:, part] == t)
                        if len(which):
                            use = flips[part][: sizes[part][t]]
                            yield _rows(part, (keys[part][which][:, None] ^ use).ravel(), np.repeat(values[which], len(use)))

    return run


def _neighbours(flips_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(masks(BITS, flips_each), np.uint64)
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 2000):
                some = values[at : at + 2000]
                near = (some[:, None] ^ flips).ravel()
                yield pa.record_batch(
                    [pa.array(np.repeat(some, len(flips)).view(np.int64)), pa.array(near.view(np.int64))],
                    ["fingerprint", "middle"],
                )

    return run


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET, parts: int | None = None) -> DataFrame:
    """``a, b``: edges between different fingerprints that connect all that lie within ``distance`` bits.

    Every edge joins fingerprints within ``distance``, and every such pair is joined by an edge or through
    one common neighbour. ``prints`` has one row per different ``fingerprint``; the distance is even.
    """
    if distance % 2 or distance < 0:
        raise ValueError("the distance must be even")
    cells = prints.mapInArrow(_co_occurrence, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat_cells = np.zeros(BITS * BITS + 1, np.int64)
    for row in cells:
        flat_cells[row["cell"]] = row["n"]
    n = int(flat_cells[-1])
    groups = correlated_partitions(flat_cells[:-1].reshape(BITS, BITS), n, parts or choose_parts(n, distance))

    index = prints.mapInArrow(_index(groups), "part int, key long, fingerprint long")
    blocks = max((len(bits) + 7) // 8 for bits in groups)
    counted = index.select(
        "part",
        F.posexplode(F.array([F.shiftright("key", 8 * b).bitwiseAND(F.lit(255)) for b in range(blocks)])).alias("block", "value"),
    )
    histograms = [[np.zeros(256) for _ in range((len(bits) + 7) // 8)] for bits in groups]
    for row in counted.groupBy("part", "block", "value").count().collect():
        if row["block"] < len(histograms[row["part"]]):
            histograms[row["part"]][row["block"]][row["value"]] = row["count"]

    crowded = durable(index.groupBy("part", "key").agg(F.count("*").alias("size")).filter(F.col("size") > bucket)).drop("size")
    probes = prints.mapInArrow(_probes(groups, histograms, n, distance), "part int, key long, fingerprint long")
    sparse = index.join(crowded, ["part", "key"], "left_anti").withColumnRenamed("fingerprint", "other")
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    found = (
        probes.join(sparse, ["part", "key"])
        .filter((apart <= distance) & (F.col("fingerprint") != F.col("other")))
        .select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
    )
    if crowded.isEmpty():
        return found
    dense = (
        index.join(crowded, ["part", "key"], "left_semi")
        .union(probes.join(crowded, ["part", "key"], "left_semi"))
        .select("fingerprint")
        .distinct()
    )
    met = dense.mapInArrow(_neighbours(distance // 2), "fingerprint long, middle long")
    least = met.groupBy("middle").agg(F.min("fingerprint").alias("a"))
    through = met.join(least, "middle").filter("a <> fingerprint").select("a", F.col("fingerprint").alias("b"))
    return found.union(through)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    distance: int = 2,
    bucket: int = BUCKET,
    parts: int | None = None,
) -> DataFrame:
    """``doc_id, text_key, fingerprint, component, component_id``: documents linked, directly or through
    others, by fingerprints that differ in ``distance`` bits or fewer; ``component`` is the least fingerprint
    of the component and ``component_id`` the least id.

    Null and empty texts have fingerprint zero and are linked like any other. A document without an id
    takes part, but is nobody's ``component_id``; a component of such documents only has null. Repeated
    rows stay repeated. Other columns, whatever their names, play no part.
    """
    marked = durable(fingerprints(docs, id_col, text_col, size))
    prints = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("root")))
    label = components(links(prints.select("fingerprint"), distance, bucket, parts), "a", "b")
    joined = prints.join(label, prints.fingerprint == label.node, "left").select(
        "fingerprint", "root", F.coalesce("label", "fingerprint").alias("label")
    )
    roots = joined.groupBy("label").agg(F.min("root").alias("component_id"))
    named = joined.join(roots, "label").select("fingerprint", F.col("label").alias("component"), "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`, the one with the least id; of
    repeated rows one stays, too. All columns are kept."""
    found = near_duplicates(docs, id_col, text_col, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    chosen = chosen.select(F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key"))
    both = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_key": F.xxhash64(F.col(text_col))})
    same = F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key"))
    kept = both.join(chosen, same, "left_semi")
    return kept.dropDuplicates(["__row_id", "__row_key"]).drop("__row_id", "__row_key")
