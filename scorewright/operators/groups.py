"""Group-relative statistics over completions that share a prompt.

One path whatever the group sizes: rows are dealt once by (group, segment), and
windows over a segment give its statistics and ranks.  A group is one segment
unless it holds more than ``SEGMENT_ROWS`` rows and is among the P largest (P:
shuffle partitions), so that it could fill a task; such a group is cut into
segments by reward and tiebreak at bounds that a range partitioning of its key
columns gives.  At most P groups are cut, at P bounds, so what joins the pieces
again, one row per segment, is bounded by 2 P and broadcast: a segment's rows
take the group's merged statistics and the rows before it.

The sizes are counted on the group columns alone, so an expensive reward is
evaluated once (and for the rows of cut groups again, to find their bounds and
to merge them); no rows are written or joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

#: Rows of a group that one task takes without cutting it.
SEGMENT_ROWS = 1 << 17


def _keys(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _same(keys: list[str], names: list[str]) -> Column:
    """Null-safe equality of the key columns with those of another frame."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))


def _order(df: DataFrame, reward: str, tiebreak: str | None) -> list[Column]:
    """Ascending columns that put rewards descending (NaN first, null last),
    then the tiebreak ascending (null first)."""
    r = F.col(reward)
    if dict(df.dtypes)[reward] in ("float", "double"):
        down = [~F.isnan(r), -r]
    else:  # exact, and no overflow where the least integer is negated
        down = [-r.cast("decimal(38,0)") if "int" in dict(df.dtypes)[reward] else -r]
    return [F.isnull(r), *down, *([F.col(tiebreak)] if tiebreak else [])]


def _segment_of(key: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by halving."""
    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= key
        return F.struct(F.when((s["lo"] < s["hi"]) & up, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when((s["lo"] < s["hi"]) & ~up, mid).otherwise(s["hi"]).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), half)["lo"]


def _segmented(df: DataFrame, keys: list[str], reward: str, tiebreak: str | None, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``_seg``, and one row per segment of the groups that are cut:
    _k0, ..., _s, the group's _mean, _std, _flat, and _before, its rows in
    earlier segments."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    large = sizes.orderBy(F.col("_n").desc()).limit(parts).drop("_n").toDF(*names).collect()
    if not large:
        return df.withColumn("_seg", F.lit(0)), None
    at = F.struct(*_order(df, reward, tiebreak))
    hot = spark.createDataFrame(large, ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)))
    own = df.join(F.broadcast(hot), _same(keys, names))
    dealt = own.select(*names, at.alias("_at")).repartitionByRange(parts, *names, "_at")
    least = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*names, "_at")).alias("x")).collect()
    bounds = spark.createDataFrame([*[r["x"] for r in least], *[(*r, None) for r in large]],
                                   ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema))
    bounds = bounds.groupBy(*names).agg(F.array_sort(F.collect_list("_at")).alias("_bounds"))
    rows = df.join(F.broadcast(bounds), _same(keys, names), "left")
    rows = rows.withColumn("_seg", F.when(F.col("_bounds").isNull(), 0).otherwise(_segment_of(at, F.col("_bounds")))).drop(*names, "_bounds")
    cut = df.join(F.broadcast(bounds), _same(keys, names)).withColumn("_s", _segment_of(at, F.col("_bounds")))
    part = cut.groupBy(*names, "_s").agg(F.count(F.lit(1)).alias("n"), F.count(reward).alias("c"), F.avg(reward).cast("double").alias("m"),
                                         F.var_pop(reward).alias("v"), F.max(reward).alias("hi"), F.min(reward).alias("lo"))
    whole, earlier = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({"_mean": F.sum(F.col("c") * F.col("m")).over(whole) / F.nullif(F.sum("c").over(whole), F.lit(0)),
                             "_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "_flat": F.max("hi").over(whole) == F.min("lo").over(whole)})
    spread = F.col("c") * (F.col("v") + (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean")))
    std = F.sqrt(F.sum(spread).over(whole) / F.nullif(F.sum("c").over(whole), F.lit(0)))
    return rows, part.select(*names, "_s", "_mean", std.alias("_std"), "_flat", "_before")


def _scan(df: DataFrame, keys: list[str], reward: str, tiebreak: str | None, limit: int) -> DataFrame:
    """Rows with _mean, _std, _flat and, with a tiebreak, _rank."""
    rows, pieces = _segmented(df, keys, reward, tiebreak, limit)
    own = Window.partitionBy(*keys, "_seg")
    new = {"_rank": F.row_number().over(own.orderBy(*_order(df, reward, tiebreak)))} if tiebreak else {}
    new |= {"_mean": F.avg(reward).over(own), "_std": F.stddev_pop(reward).over(own), "_flat": (F.max(reward).over(own) == F.min(reward).over(own))}
    rows = rows.withColumns(new)
    if pieces is None:
        return rows.drop("_seg")
    names = [f"_k{i}" for i in range(len(keys))]
    pieces = pieces.toDF(*[c if c in (*names, "_s") else f"{c}_all" for c in pieces.columns])
    rows = rows.join(F.broadcast(pieces), _same(keys, names) & (F.col("_seg") == F.col("_s")), "left")
    merged = F.col("_s").isNotNull()
    rows = rows.withColumns({c: F.when(merged, F.col(f"{c}_all")).otherwise(F.col(c)) for c in ("_mean", "_std", "_flat")})
    if tiebreak:
        rows = rows.withColumn("_rank", F.col("_rank") + F.coalesce("_before_all", F.lit(0)))
    return rows.drop(*names, "_s", "_seg", *[c for c in pieces.columns if c.endswith("_all")])


def _advantage(reward: str, eps: float) -> Column:
    off = F.col(reward) - F.col("_mean")
    return F.when(F.col("_flat"), off).otherwise(off / (F.col("_std") + F.lit(eps)))


def group_normalize(df: DataFrame, group: str | list[str] = "prompt_id", reward: str = "reward",
                    out: str = "advantage", eps: float = K.GROUP_STD_EPS, limit: int = SEGMENT_ROWS) -> DataFrame:
    """(r - mean) / (std + eps) with population std; when every reward in the
    group is equal the std is taken as exactly 0 and the result is r - mean.
    A null reward has a null advantage and does not count."""
    rows = _scan(df, _keys(group), reward, None, limit)
    return rows.withColumn(out, _advantage(reward, eps)).drop("_mean", "_std", "_flat")


def group_rank(df: DataFrame, group: str | list[str] = "prompt_id", reward: str = "reward",
               tiebreak: str = "gen_idx", out: str = "rank", limit: int = SEGMENT_ROWS) -> DataFrame:
    """1-based rank by reward descending (nulls last), ties by ``tiebreak``;
    rows equal in both get consecutive ranks in no given order (and, equal in
    all that could part them, lie in one segment)."""
    rows = _scan(df, _keys(group), reward, tiebreak, limit)
    return rows.withColumn(out, F.col("_rank").cast("int")).drop("_rank", "_mean", "_std", "_flat")


def normalize_and_rank(df: DataFrame, group: str | list[str] = "prompt_id", reward: str = "reward", tiebreak: str = "gen_idx",
                       advantage: str = "advantage", rank: str = "rank", eps: float = K.GROUP_STD_EPS, limit: int = SEGMENT_ROWS) -> DataFrame:
    """Both of the above over one dealing of the rows."""
    rows = _scan(df, _keys(group), reward, tiebreak, limit).withColumn(advantage, _advantage(reward, eps))
    return rows.withColumn(rank, F.col("_rank").cast("int")).drop("_rank", "_mean", "_std", "_flat")


def group_stats(df: DataFrame, group: str | list[str] = "prompt_id", reward: str = "reward") -> DataFrame:
    """Mean (0 for an empty group), population std and size per group;
    partial aggregation happens map-side."""
    keys = _keys(group)
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"),
        F.stddev_pop(reward).alias("std_reward"),
        F.count(F.lit(1)).alias("n"),
    )


def fan_out(df: DataFrame, k: int, out: str = "gen_idx") -> DataFrame:
    """K copies of every row with a generation index 0..K-1 (no shuffle)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
