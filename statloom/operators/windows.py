"""Ordered operators: caps, samples, running values, progress.

Running values over a key never put a whole key into one task. Rows are cut into ranges of key and time of about
equal size; range totals (few rows) are accumulated per key, joined back, and completed inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions.common import col, join_null_safe
from statloom.session import cut_lineage


def first_k(rows: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows per key. The rank limit prunes inside every task before the shuffle, so a large
    key sends at most k rows per task."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def best_row(rows: DataFrame, keys: Sequence[str], score, tie) -> DataFrame:
    """Row with the highest score per key, the lowest tie value first; a combining aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(col(score).alias("s"), (-col(tie)).alias("t"))).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def bucketed(rows: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Rows in ranges of key and time of about equal size, numbered in that order. A key that holds most rows, even
    all of one day, spreads over many ranges. Written once, so that all later passes see the same ranges."""
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(number, *[F.col(k) for k in keys], F.col(ts), F.col(tie))
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))


def _accumulated(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates of bucketed rows; null keys are a key like others."""
    fold = {"sum": F.sum, "max": F.max}
    staged = rows.withColumns({f"_{n}": e for n, (_, e) in values.items()})
    totals = staged.groupBy(*keys, "_bucket").agg(*[fold[kind](f"_{n}").alias(f"_{n}") for n, (kind, _) in values.items()])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_bucket", *[fold[kind](f"_{n}").over(earlier).alias(f"_before_{n}") for n, (kind, _) in values.items()]
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)

    def total(name: str, kind: str) -> Column:
        own, prior = fold[kind](f"_{name}").over(inside), F.col(f"_before_{name}")
        if kind == "sum":
            return F.coalesce(prior, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.coalesce(F.when(prior.isNotNull() & own.isNotNull(), F.greatest(prior, own)), own, prior)

    joined = join_null_safe(staged, before, [*keys, "_bucket"])
    return joined.select(*rows.columns, *[total(n, kind).alias(n) for n, (kind, _) in values.items()])


def running(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running aggregates per key in time order. ``values`` maps a new column to ("sum" or
    "max", expression)."""
    return _accumulated(bucketed(rows, keys, ts, tie), keys, ts, tie, values).drop("_bucket")


def running_means(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, ok: Column) -> DataFrame:
    """Running plain mean, and running mean over the qualifying rows (zero before the first)."""
    out = running(
        rows, keys, ts, tie,
        {
            "n": ("sum", F.lit(1)),
            "total": ("sum", col(value)),
            "n_ok": ("sum", ok.cast("int")),
            "total_ok": ("sum", F.when(ok, col(value)).otherwise(0.0)),
        },
    )
    return out.withColumns(
        {
            "running_mean": F.col("total") / F.col("n"),
            "running_ok_mean": F.when(F.col("n_ok") > 0, F.col("total_ok") / F.col("n_ok")).otherwise(0.0),
        }
    )


def recurrent_mean(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, ok: Column) -> DataFrame:
    """Mean kept by the rule ``m = (m * (n - 1) + x) / n`` on qualifying rows, where n counts all
    rows, and left alone on the others.

    The rule is linear in m, so it is a weighted running sum: with p the product of (n - 1) / n over
    the qualifying rows so far, m = p * sum(x / (n * p)). Both parts are running sums over the same buckets."""
    counted = _accumulated(bucketed(rows.withColumn("_ok", ok), keys, ts, tie), keys, ts, tie, {"n": ("sum", F.lit(1))})
    shrink = F.when(F.col("_ok") & (F.col("n") > 1), F.log((F.col("n") - 1) / F.col("n"))).otherwise(0.0)
    weighted = _accumulated(counted, keys, ts, tie, {"log_p": ("sum", shrink)})
    share = F.when(F.col("_ok"), col(value) / (F.col("n") * F.exp("log_p"))).otherwise(0.0)
    summed = _accumulated(weighted, keys, ts, tie, {"weighted": ("sum", share)})
    return summed.withColumn("recurrent_mean", F.exp("log_p") * F.col("weighted")).drop("_bucket")


def progress_tracking(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, total: int) -> DataFrame:
    """Progress, elapsed seconds and estimated remaining seconds at every checkpoint."""
    starts = rows.groupBy(*keys).agg(F.min(ts).alias("started"))
    counted = running(rows, keys, ts, tie, {"checkpoint": ("sum", F.lit(1))})
    counted = join_null_safe(counted, starts, keys)
    current = F.least(F.col("checkpoint"), F.lit(max(1, total)))
    elapsed = F.timestamp_diff("MICROSECOND", F.col("started"), F.col(ts)) / 1000000.0
    staged = counted.withColumns({"current": current, "elapsed": elapsed})
    rate = F.col("current") / F.col("elapsed")
    return staged.withColumns(
        {
            "percentage": F.round(F.col("current") / max(1, total) * 100, 1),
            "elapsed_time": F.round("elapsed", 2),
            "estimated_remaining": F.when(
                (F.col("checkpoint") >= 2) & (F.col("elapsed") > 0), F.round((max(1, total) - F.col("current")) / rate, 1)
            ),
        }
    )


def latest_success(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, route: str, ok: Column) -> DataFrame:
    """Route and time of the latest successful row so far."""
    mark = F.when(ok, F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), F.col(route).alias("route")))
    out = running(rows, keys, ts, tie, {"latest": ("max", mark)})
    return out.select("*", F.col("latest.at").alias("last_success_at"), F.col("latest.route").alias("best_route"))


def site_picks(pages: DataFrame, per_site: int = 3, overall: int = 5) -> DataFrame:
    """Best pages of each site, then the first ones overall."""
    top = first_k(pages, ["site"], [F.col("score").desc(), F.col("url"), F.col("page_id")], per_site)
    return top.orderBy("site", "rank").limit(overall)
