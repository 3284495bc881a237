"""Exact medians of groups of any size.

Small groups are aggregated as they are. For a large group a mergeable sketch
brackets the median and only the values inside the bracket, a few in a thousand,
are ranked. No task ever holds a large group, so one may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

SMALL = 5000
_ACCURACY = 2000
#: Tables of groups are broadcast up to this number of rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its counted size allows one; it should be stored or cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return out


def attached(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``stats``, null keys equal to null; ``stats`` is broadcast where its size allows it."""
    more = [c for c in stats.columns if c not in keys]
    return rows.alias("l").join(bounded(stats).alias("r"), _same(keys), how).select("l.*", *[F.col(f"r.{c}").alias(c) for c in more if how not in ("left_semi", "left_anti")])


def medians(df: DataFrame, groups: list[str], value: str, name: str, share: float = 0.5) -> DataFrame:
    """(groups, ``n_<name>``, ``name``): count and exact median (or percentile of ``share``, interpolated) of the non-null values of each group.

    Null group keys form a group of their own; groups without a value have no row.
    """
    given = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v_"))
    sizes = given.groupBy(*groups).agg(F.count("*").alias("n_"), F.percentile_approx("v_", [max(0.0, share - 3 / _ACCURACY), min(1.0, share + 3 / _ACCURACY)], _ACCURACY).alias("b_"))
    large = stored(sizes.where(F.col("n_") > SMALL).select(*groups, "n_", F.col("b_")[0].alias("lo_"), F.col("b_")[1].alias("hi_")))
    plain = lambda rows: rows.groupBy(*groups).agg(F.count("*").alias(f"n_{name}"), F.percentile("v_", F.lit(share)).alias(name))
    if not large.limit(1).count():
        return plain(given)
    rows = attached(given, large, groups)
    below = rows.where("v_ < lo_").groupBy(*groups).agg(F.count("*").alias("below_"))
    inside = rows.where("v_ >= lo_ and v_ <= hi_").groupBy(*groups, "v_").agg(F.count("*").alias("c_"), F.first("n_").alias("n_"))
    ranked = inside.withColumn("to_", F.sum("c_").over(Window.partitionBy(*groups).orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.alias("l").join(below.alias("r"), _same(groups), "left").select("l.*", F.coalesce("below_", F.lit(0)).alias("below_")).withColumn("to_", F.col("to_") + F.col("below_"))
    place = F.lit(share) * (F.col("n_") - 1)
    at = [F.max(F.when((F.col("to_") >= k) & (F.col("to_") - F.col("c_") < k), F.col("v_"))) for k in (F.floor(place) + 1, F.ceil(place) + 1)]
    rest = F.max(place - F.floor(place))
    exact = ranked.groupBy(*groups).agg(F.max("n_").alias(f"n_{name}"), (at[0] * (1 - rest) + at[1] * rest).alias(name))
    return plain(attached(given, large, groups, "left_anti")).unionByName(exact)
