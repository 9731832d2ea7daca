"""Accuracy reports and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, group: str, passed: Column) -> DataFrame:
    """Rows, passed and percent for each group and overall (group null), in one pass."""
    return df.withColumn("_ok", passed.cast("long")).rollup(group).agg(F.count("*").alias("total"), F.sum("_ok").alias("passed")).withColumn("pct", F.round(100.0 * F.col("passed") / F.col("total"), 4))


def wilson(ok: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval."""
    p, d = ok / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))


def field_report(df: DataFrame, fields: list[str], group: str) -> DataFrame:
    """For rows with expected_<f> and got_<f>: correct, wrong, missing, accuracy and interval by (group, field), by field over all groups."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").alias("e"), F.col(f"got_{f}").alias("g")) for f in fields])).alias("x"))
    long = long.select(group, "x.field", "x.e", "x.g")
    said, right = F.coalesce("g", F.lit("")) != "", F.col("e") == F.col("g")
    sets = [[F.col(group), F.col("field")], [F.col("field")]]
    out = long.groupingSets(sets, F.col(group), F.col("field")).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(said & ~right).alias("wrong"), F.count_if(~said).alias("missing"))
    out = out.withColumn("ci", wilson(F.col("correct"), F.col("n")))
    return out.select(group, "field", "n", "correct", "wrong", "missing", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round("ci.low", 6).alias("ci_low"), F.round("ci.high", 6).alias("ci_high"))


def reliability(df: DataFrame, n_bins: int = 10, score: str = "score", correct: str = "was_correct") -> DataFrame:
    """Equal-width bins (empty ones left out): count, mean confidence, accuracy."""
    ok = F.col(correct).cast("double")
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_confidence"), F.avg(ok).alias("accuracy"))


def calibration_error(df: DataFrame, n_bins: int = 10, score: str = "score", correct: str = "was_correct") -> DataFrame:
    """One row: expected calibration error and Brier score."""
    ok = F.col(correct).cast("double")
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1))
    bins = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(score) - F.avg(ok)).alias("gap"), F.sum(F.pow(F.col(score) - ok, 2)).alias("sq"))
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def fit_isotonic(df: DataFrame, score: str = "score", correct: str = "was_correct", digits: int | None = 4) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over the different scores. Rows are summed by score first (rounded to `digits`, so at most 10^digits + 1 sums
    come to the driver whatever the size of the table; None keeps scores as they are)."""
    s = F.col(score) if digits is None else F.round(score, digits)
    sums = df.groupBy(s.alias("s")).agg(F.sum(F.col(correct).cast("double")).alias("ok"), F.count("*").alias("n")).orderBy("s").collect()
    blocks: list[tuple[float, float, float]] = []  # sum of scores, right ones, rows
    for r in sums:
        now = (r.s * r.n, r.ok, float(r.n))
        while blocks and blocks[-1][1] * now[2] >= now[1] * blocks[-1][2]:
            before = blocks.pop()
            now = tuple(x + y for x, y in zip(before, now))
        blocks.append(now)
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def calibrated(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between knots, clamped at the ends: as one expression over the knots."""
    knots = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(xs, ys)])
    below = F.size(F.filter(knots, lambda k: k["x"] <= score))
    a, b = F.get(knots, below - 1), F.get(knots, below)
    return F.when(score <= xs[0], F.lit(float(ys[0]))).when(score >= xs[-1], F.lit(float(ys[-1]))).otherwise(a["y"] + (b["y"] - a["y"]) * (score - a["x"]) / (b["x"] - a["x"]))


def nearest_rank(df: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    return df.agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(p * 100)}") for p in ps], F.avg(value).alias("mean"))


def worst(df: DataFrame, group: list[str], order: list[Column], per_group: int = 2, limit: int = 15) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= per_group).drop("_n").orderBy(*order).limit(limit)
