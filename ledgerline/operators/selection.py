"""Exact quantiles of whole columns by narrowing, without sorting or writing the rows.

A first pass sketches every column: its count, sum and extremes, and a narrow span of values around each
wanted rank. A second pass counts what lies between the spans, and each value inside them; the ranks are
read off these counts. A sketch may be off by more than its promise after many merges: a rank that then lies
between two spans is looked for there in another pass. Tables so large that a span still holds too many
values are sketched again inside the spans.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of a sketch as a share of the rows is one over this; spans are ``MARGIN`` times as wide to each side.
ACCURACY, MARGIN = 2_000, 4
#: Rows that the spans around one rank may hold before they are narrowed again.
INSIDE = 100_000


@dataclass
class Summary:
    """What is known of a column."""

    n: int
    total: float | None
    least: float | None
    most: float | None
    quantiles: dict[str, float | None] = field(default_factory=dict)


def _value(column: str) -> Column:
    return F.col(column).cast("double")


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _sketched(df: DataFrame, spans: dict[str, list], probs: Sequence[float]):
    """One pass: count, sum, extremes and the edges around each quantile of every column, or of its spans."""
    edges = sorted({min(max(p + side * MARGIN / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)})
    parts = []
    for i, c in enumerate(spans):
        v = _value(c)
        parts += [
            F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
            F.percentile_approx(v, edges, ACCURACY).alias(f"e{i}"),
        ]
    row = df.agg(*parts).first()
    found, wide = {}, {}
    for i, c in enumerate(spans):
        found[c] = Summary(row[f"n{i}"], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"])
        at = dict(zip(edges, row[f"e{i}"] or []))
        if found[c].n:
            around = [(min(max(p - MARGIN / ACCURACY, 0.0), 1.0), min(max(p + MARGIN / ACCURACY, 0.0), 1.0)) for p in probs]
            wide[c] = _merged(
                [(found[c].least if a == 0 else at[a], found[c].most if b == 1 else at[b]) for a, b in around]
            )
    return found, wide


def _slot(v: Column, spans: list[tuple[float, float]]) -> Column:
    """Twice the number of spans below the value; one more for a value inside a span."""
    slot = F.lit(2 * len(spans))
    for k, (lo, hi) in reversed(list(enumerate(spans))):
        slot = F.when(v < lo, 2 * k).when(v <= hi, 2 * k + 1).otherwise(slot)
    return slot


def _counted(df: DataFrame, spans: Mapping[str, list]) -> DataFrame:
    """``column, slot, value, cnt``: a row for each gap between spans and for each value inside them."""
    # each column's slot and inner value are columns of their own, so that expressions stay small
    names = list(spans)
    places = df.select(*[_value(c).alias(f"v{i}") for i, c in enumerate(names)]).select(
        "*", *[F.when(F.col(f"v{i}").isNotNull(), _slot(F.col(f"v{i}"), spans[c])).alias(f"s{i}") for i, c in enumerate(names)]
    )
    inner = places.select(
        *[f"s{i}" for i in range(len(names))], *[F.when(F.col(f"s{i}") % 2 == 1, F.col(f"v{i}")).alias(f"v{i}") for i in range(len(names))]
    )
    pairs = ", ".join(f"{i}, s{i}, v{i}" for i in range(len(names)))
    stacked = inner.selectExpr(f"stack({len(names)}, {pairs}) as (number, slot, value)").filter("slot is not null")
    counts = stacked.groupBy("number", "slot", "value").agg(F.count("*").alias("cnt"))
    column = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("number") + 1)
    return counts.select(column.alias("column"), "slot", "value", "cnt")


def _picked(counts: DataFrame, ranks: Mapping[str, list[int]]) -> dict[tuple[str, int], tuple[int, float | None]]:
    """Slot and value at each wanted rank; a span's values are few."""
    upto = F.sum("cnt").over(Window.partitionBy("column").orderBy("slot", "value"))
    wanted = F.lit(None).cast("array<long>")
    for c, of in ranks.items():
        wanted = F.when(F.col("column") == c, F.array(*[F.lit(r).cast("long") for r in of])).otherwise(wanted)
    at = counts.withColumns({"upto": upto, "wanted": wanted}).withColumn(
        "hit", F.filter("wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("cnt")))
    )
    rows = at.select("column", "slot", "value", F.explode("hit").alias("rank")).collect()
    return {(r["column"], r["rank"]): (r["slot"], r["value"]) for r in rows}


def _narrowed(df: DataFrame, spans: dict[str, list], ranks: Mapping[str, list[int]]) -> dict[str, list]:
    """Spans of very large tables, cut down around their ranks by sketches of what they hold."""
    parts, keys = [], []
    for i, (c, of) in enumerate(spans.items()):
        v = _value(c)
        for k, (lo, hi) in enumerate(of):
            keys.append((c, k))
            parts += [
                F.count_if(v < lo).alias(f"b{i}_{k}"),
                F.count_if(v.between(lo, hi)).alias(f"n{i}_{k}"),
                F.percentile_approx(F.when(v.between(lo, hi), v), [x / 200 for x in range(201)], ACCURACY).alias(f"e{i}_{k}"),
            ]
    row = df.agg(*parts).first()
    out: dict[str, list] = {c: [] for c in spans}
    for i, (c, of) in enumerate(spans.items()):
        for r in ranks[c]:
            for k, (lo, hi) in enumerate(of):
                n, place = row[f"n{i}_{k}"], r - row[f"b{i}_{k}"]
                if n and 0 <= place < n:
                    step = place / n * 200
                    edges = row[f"e{i}_{k}"]
                    out[c].append((edges[max(math.floor(step) - 1, 0)], edges[min(math.ceil(step) + 1, 200)]))
    return {c: _merged(out[c] or spans[c]) for c in spans}


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> dict[str, Summary]:
    """Count, sum, extremes and exact, linearly interpolated quantiles of numeric columns; nulls are skipped.

    The table is read twice, and once more for each fiftyfold beyond twenty million rows. NaN counts as the
    largest value. What comes to the driver is a row for each column and rank.
    """
    found, spans = _sketched(df, {c: [] for c in columns}, list(probs.values()))
    ranks = {
        c: sorted({f(p * (found[c].n - 1)) for p in probs.values() for f in (math.floor, math.ceil)}) for c in spans
    }
    size = max((s.n for s in found.values()), default=0) * 2 * MARGIN / ACCURACY
    while size > INSIDE and spans:
        spans, size = _narrowed(df, spans, ranks), size / 50
    values: dict[tuple[str, int], float] = {}
    left = dict(spans)
    while left:
        got = _picked(_counted(df, left), ranks)
        again: dict[str, list] = {}
        for c, of in left.items():
            for r in ranks[c]:
                slot, value = got[c, r]
                if slot % 2:
                    values[c, r] = value
                else:  # between two spans
                    lo = found[c].least if slot == 0 else of[slot // 2 - 1][1]
                    hi = found[c].most if slot == 2 * len(of) else of[slot // 2][0]
                    again.setdefault(c, []).append((lo, hi))
        left = {c: _merged([*left[c], *gaps]) for c, gaps in again.items()}
    for c, summary in found.items():
        for name, p in probs.items():
            if not summary.n:
                summary.quantiles[name] = None
                continue
            place = p * (summary.n - 1)
            low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
            summary.quantiles[name] = low + (high - low) * (place - math.floor(place)) if high != low else low
    return found
