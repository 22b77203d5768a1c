"""Sorted computations that stay distributed when one key holds most of the rows.

A window partitioned by key puts all rows of the key into one task, and a window without
keys puts the whole table there. Here the rows are range-partitioned by (keys, order), so a
large key spreads over many partitions ("chunks"). Each chunk is handled alone, and what the
earlier chunks contribute is carried over through a table with one row per (chunk, key).
The chunk number is written down with the rows (see ``session.durable``), so it cannot
change when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.relational import join_back
from ledgerline.session import durable

CHUNK = "_chunk"


TIE = "_tie"


def _chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return ranged.withColumn(CHUNK, F.spark_partition_id())


def _split_ties(df: DataFrame) -> DataFrame:
    """Number the rows so that copies equal in (keys, order) can go to different chunks.

    The number depends on where a row was read, so it is written down before it decides
    about partitions.
    """
    return durable(df.withColumn(TIE, F.monotonically_increasing_id()))


def _carry(totals: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """What all earlier chunks of the same key add up to; only keys that span chunks remain.

    Sorted ranges overlap in at most one key per boundary, so the result has at most one row
    per chunk and is safe to broadcast whatever the table size.
    """
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(CHUNK, *keys, value.over(before).alias(out))
    return F.broadcast(carried.filter(F.col(out).isNotNull()))


def _with_carry(rows: DataFrame, carried: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    right = carried.select(
        F.col(CHUNK).alias("_rc"), *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(out)
    )
    on = F.col(CHUNK) == F.col("_rc")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(right, on, "left").drop("_rc", *[f"_r_{k}" for k in keys])


def cumulative(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str, whole: str | None = None
) -> DataFrame:
    """Running sum per key over rows that are unique in (keys, order); ``whole`` names the key's total.

    The rows are written down once, with their chunk's own sums; everything read from them later
    agrees, also after an executor is lost. Only keys that span chunks, at most two rows for each
    chunk, are needed to complete the sums.
    """
    group = Window.partitionBy(CHUNK, *keys)
    inside = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = durable(
        _chunks(df, keys, order).withColumns({"_inside": F.sum(value).over(inside), "_part": F.sum(value).over(group)})
    )
    totals = rows.groupBy(CHUNK, *keys).agg(F.max("_part").alias("_total"))
    if keys:
        parts = Window.partitionBy(*keys)
        earlier = parts.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    else:  # one row for each chunk
        parts = Window.partitionBy(F.lit(0))
        earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    spanning = totals.select(
        F.col(CHUNK).alias("_rc"),
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.count("*").over(parts).alias("_chunks"),
        F.sum("_total").over(parts).alias("_all"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    ).filter("_chunks > 1")
    on = F.col(CHUNK) == F.col("_rc")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    summed = rows.join(F.broadcast(spanning), on, "left").withColumn(
        out, F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))
    )
    if whole:
        summed = summed.withColumn(whole, F.coalesce("_all", "_part"))
    return summed.select(*df.columns, out, *([whole] if whole else []))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str
) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order)``: peers share one total."""
    peers = df.groupBy(*keys, order).agg(F.sum(value).alias("_peer_sum"))
    sums = cumulative(peers, keys, [order], "_peer_sum", out).drop("_peer_sum")
    return join_back(df, sums, [*keys, order])


def row_numbers(
    df: DataFrame, order: Sequence[Column | str], out: str, start: int = 1, unique: bool = False
) -> DataFrame:
    """Dense row number over the whole table without a single-task sort.

    ``unique`` says that no two rows are equal in ``order``, so that copies need no numbering first.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    if unique:
        numbered = cumulative(one, [], order, "_one", out)
    else:
        numbered = cumulative(_split_ties(one), [], [*order, TIE], "_one", out).drop(TIE)
    return numbered.withColumn(out, F.col(out) + (start - 1)).drop("_one")


def previous_value(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """``LAG(order) OVER (PARTITION BY keys ORDER BY order)``."""
    rows = durable(_chunks(_split_ties(df), keys, [order, TIE]))
    inside = Window.partitionBy(CHUNK, *keys).orderBy(order, TIE)
    last = rows.groupBy(CHUNK, *keys).agg(F.max(order).alias("_last"))
    carried = _carry(last, keys, F.max("_last"), "_before")
    lagged = rows.withColumn("_inside", F.lag(order).over(inside))
    return (
        _with_carry(lagged, carried, keys, "_before")
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_inside", "_before", CHUNK, TIE)
    )


def sliding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, out: dict[str, Column]
) -> DataFrame:
    """Aggregates over the ``before`` rows before each row, the row, and the ``after`` rows behind it, per key.

    ``out`` names the aggregates, such as ``F.sum("value")``; rows should be unique in (keys, order), equal ones
    come in any order. A chunk gets a halo: the rows of its first and last key that lie next to it in other
    chunks. Only those keys can span chunks, so a halo has at most ``before + after`` rows on each side,
    also where the chunks of a key are shorter than the frame.
    """
    reach = max(before + after, 1)
    part = Window.partitionBy(CHUNK, *keys)
    rows = durable(
        _chunks(df, keys, order).withColumns({"_at": F.row_number().over(part.orderBy(*order)), "_n": F.count("*").over(part)})
    )
    parts = rows.groupBy(CHUNK, *keys).agg(F.max("_n").cast("bigint").alias("_n"))
    of_key = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys])
    spanning = (
        parts.withColumns(
            {
                "_first": F.coalesce(F.sum("_n").over(of_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_parts": F.count("*").over(of_key),
            }
        )
        .filter("_parts > 1")
        .select(F.col(CHUNK).alias("_rc"), *[F.col(k).alias(f"_r_{k}") for k in keys], "_first", F.col("_n").alias("_size"))
    )
    spanning = durable(spanning)  # at most two rows for each chunk

    def same_key() -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return on

    edges = rows.filter((F.col("_at") <= after) | (F.col("_at") > F.col("_n") - before))
    edges = edges.join(F.broadcast(spanning), (F.col(CHUNK) == F.col("_rc")) & same_key())
    edges = edges.select(*df.columns, "_at", "_n", F.col(CHUNK).alias("_from"), (F.col("_first") + F.col("_at") - 1).alias("_place"))
    # the stretch of places that a chunk needs to its left and right, in strips as wide as the frame
    stretch = F.inline(
        F.array(
            F.struct((F.col("_first") - before).alias("_lo"), (F.col("_first") - 1).alias("_hi")),
            F.struct((F.col("_first") + F.col("_size")).alias("_lo"), (F.col("_first") + F.col("_size") + after - 1).alias("_hi")),
        )
    )
    needs = spanning.select("*", stretch).filter("_hi >= _lo and _hi >= 0")
    needs = needs.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("_lo") / reach), F.floor(F.col("_hi") / reach))))
    halo = (
        edges.withColumn("_place_strip", F.floor(F.col("_place") / reach))
        .join(needs, same_key() & (F.col("_place_strip") == F.col("_strip")))
        .filter(F.col("_place").between(F.col("_lo"), F.col("_hi")) & (F.col("_from") != F.col("_rc")))
    )
    # rows from the left come before the chunk's own, those from the right behind them
    own = rows.select(*df.columns, F.col(CHUNK), F.lit(0).alias("_side"), F.col("_at").cast("bigint").alias("_seq"))
    side = F.when(F.col("_from") < F.col("_rc"), -1).otherwise(1)
    both = own.union(halo.select(*df.columns, F.col("_rc"), side, F.col("_place")))
    frame = Window.partitionBy(CHUNK, *keys).orderBy("_side", "_seq").rowsBetween(-before, after)
    done = both.withColumns({name: value.over(frame) for name, value in out.items()})
    return done.filter("_side = 0").select(*df.columns, *out)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Different values per group in order: ``cnt`` rows hold the value, ``upto`` rows are not above it.

    ``n`` is the group's number of non-null values. The table is written down on the way, so
    quantiles, means and outlier counts can all be taken from it without reading ``df`` again.
    Equal values are counted before anything is sorted, and ranks come from ``cumulative``: no
    task ever holds a whole group.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("cnt"))
    return cumulative(counts, by, [value], "cnt", "upto", whole="n")


def rank_quantiles(ranked: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles from the result of ``value_ranks``."""
    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("n") - 1)
        below, above = F.floor(position), F.ceil(position)
        starts = F.col("upto") - F.col("cnt")
        hit_below = (starts <= below) & (below < F.col("upto"))
        hit_above = (starts <= above) & (above < F.col("upto"))
        picks += [
            F.max(F.when(hit_below, F.col(value).cast("double"))).alias(f"_lo_{name}"),
            F.max(F.when(hit_above, F.col(value).cast("double"))).alias(f"_hi_{name}"),
            F.max(position - below).alias(f"_part_{name}"),
        ]
    found = ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    result = [
        (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_part_{m}")).alias(m)
        for m in probs
    ]
    return found.select(*by, "n", *result)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; nulls are skipped."""
    return rank_quantiles(value_ranks(df, value, by), value, probs, by)


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str], rows: str | None = None) -> DataFrame:
    """Most frequent non-null value of each column per group, the smallest one on ties.

    One row per (group, ``column``) with a field per column in ``best``, the mode's count
    ``mode_cnt``, the non-null count ``value_cnt`` and all rows ``obs_cnt``. The rows are read
    once and combined to counts of value combinations before anything is shuffled or unfolded. ``rows`` names
    a column that says how many rows each row stands for.
    """
    types = dict(df.select(*columns).dtypes)
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            *[(F.col(o) if o == c else F.lit(None).cast(types[o])).alias(f"_v_{o}") for o in columns],
        )
        for c in columns
    ]
    values = [f"_v_{c}" for c in columns]
    joint = df.groupBy(*by, *columns).agg((F.sum(rows) if rows else F.count("*")).alias("_rows"))
    long = joint.select(*by, "_rows", F.explode(F.array(*parts)).alias("_p")).select(*by, "_rows", "_p.*")
    counts = long.groupBy(*by, "column", *values).agg(F.sum("_rows").alias("_n"))
    filled = F.lit(False)
    for v in values:
        filled = filled | F.col(v).isNotNull()
    best = F.min(F.when(filled, F.struct((-F.col("_n")).alias("n"), *values)))
    grouped = counts.groupBy(*by, "column").agg(
        best.alias("best"),
        F.sum(F.when(filled, F.col("_n")).otherwise(0)).alias("value_cnt"),
        F.sum("_n").alias("obs_cnt"),
    )
    return grouped.withColumn("mode_cnt", -F.col("best.n"))


def mode(df: DataFrame, value: str, by: Sequence[str], out: str = "mode", rows: str | None = None) -> DataFrame:
    """``modes`` for one column, flat."""
    return modes(df, [value], by, rows).select(
        *by, F.col(f"best._v_{value}").alias(out), "mode_cnt", "value_cnt", "obs_cnt"
    )
