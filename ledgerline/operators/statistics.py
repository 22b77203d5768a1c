"""Two-sample tests from grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import half_up, ratio
from ledgerline.functions.pvalues import normal_p, student_p

Z_95 = 1.959963984540054  # fixed value: two-sided 5 % point of the normal distribution


def welch(df: DataFrame, value: str, group: str, first: str, second: str, digits: int = 6) -> DataFrame:
    """Welch's t with its degrees of freedom for two groups of one column; nulls are skipped.

    One pass keeps count, mean and variance of both samples; only that single row goes on.
    """

    def sample(name: str) -> Column:
        return F.when(F.col(group) == name, F.col(value).cast("double"))

    row = df.filter(F.col(group).isin(first, second)).agg(
        *[
            f(sample(name)).alias(f"{tag}{i}")
            for i, name in ((1, first), (2, second))
            for tag, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
        ]
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    dof = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return row.select(
        F.lit(first).alias("group_1"),
        F.lit(second).alias("group_2"),
        "n1",
        "n2",
        half_up("m1", digits).alias("mean_1"),
        half_up("m2", digits).alias("mean_2"),
        half_up((F.col("m1") - F.col("m2")) / F.sqrt(a + b), digits).alias("t"),
        half_up(dof, digits).alias("dof"),
    )


def welch_test(df: DataFrame, value: str, group: str, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    result = welch(df, value, group, first, second, 12)
    return result.withColumn("p_value", student_p("t", "dof")).withColumn("rejected", F.col("p_value") < alpha)


def proportion_z(hits_1: str, size_1: str, hits_2: str, size_2: str) -> Column:
    """z of two proportions with the pooled share."""
    pooled = ratio(F.col(hits_1) + F.col(hits_2), F.col(size_1) + F.col(size_2))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col(size_1) + 1 / F.col(size_2)))
    return (ratio(hits_1, size_1) - ratio(hits_2, size_2)) / F.nullif(spread, F.lit(0.0))


def funnel(df: DataFrame, user: str, event: str, steps: Sequence[str], by: str) -> DataFrame:
    """Users per step and group with their share of the group, of the step before and of the first.

    Events are reduced to distinct (group, user, step) before anything is counted.
    """
    seen = df.filter(F.col(event).isin(list(steps))).select(by, user, event).distinct()
    users = df.select(by, user).distinct().groupBy(by).agg(F.count("*").alias("users_all"))
    wide = seen.groupBy(by).agg(*[F.count_if(F.col(event) == s).alias(s) for s in steps])
    long = wide.join(users, by).select(
        by,
        "users_all",
        F.posexplode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("step"),
                        F.col(s).alias("users"),
                        F.col(steps[max(i - 1, 0)]).alias("before"),
                        F.col(steps[0]).alias("first"),
                    )
                    for i, s in enumerate(steps)
                ]
            )
        ).alias("position", "s"),
    )
    return long.select(
        by,
        (F.col("position") + 1).cast("bigint").alias("step_number"),
        F.col("s.step").alias("step"),
        F.col("s.users").alias("users"),
        "users_all",
        half_up(ratio("s.users", "users_all") * 100, 2).alias("share_of_all"),
        half_up(ratio("s.users", "s.before") * 100, 2).alias("share_of_previous"),
        half_up(ratio("s.users", "s.first") * 100, 2).alias("share_of_first"),
    )


def funnel_z(funnel_rows: DataFrame, by: str, first: object, second: object, digits: int = 6) -> DataFrame:
    """z per funnel step between two groups; rejected at the 5 % level."""
    step = funnel_rows.groupBy("step_number", "step").agg(
        *[
            F.max(F.when(F.col(by) == g, F.col(c))).alias(f"{c}_{i}")
            for i, g in ((1, first), (2, second))
            for c in ("users", "users_all")
        ]
    )
    z = proportion_z("users_1", "users_all_1", "users_2", "users_all_2")
    return step.withColumn("z", half_up(z, digits)).withColumn("rejected", F.abs("z") > Z_95)


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    return df.withColumn("p_value", normal_p(z))
