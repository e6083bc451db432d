"""Row-level operators that carry the in-record ones' meaning to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BLOCK_ROWS = 500_000


def rounded(value: str | Column, digits: int) -> Column:
    """A double rounded as SQL's round does: halves of the scaled number go away from zero, not those of its decimal digits.

    The value is named several times, so it should be a column of a lower projection or an aggregate.
    """
    x = F.col(value) if isinstance(value, str) else value
    y = F.abs(x * 10.0**digits)
    whole = F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)
    return F.when(y < float("inf"), F.signum(x) * whole / 10.0**digits).otherwise(x)


def lookup(df: DataFrame, pool: DataFrame, key: str, pool_key: str, columns: list[str]) -> DataFrame:
    """Enrich rows from a keyed pool; the pool is broadcast only if it is counted to be small, else Spark's joins decide."""
    side = pool.select(F.col(pool_key).alias("_key"), *columns)
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, df[key] == F.col("_key"), "left").drop("_key")


def top_per_key(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], prefix: str = "") -> DataFrame:
    """The latest right row of the same key at or before each left row: one union and one window, no range join."""
    names = left.columns
    a = left.select(*names, *(F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in columns), F.lit(1).alias("_side"))
    b = right.select(*(F.col(n) if n in (key, ts) else F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names), *(F.col(c).alias(f"_r_{c}") for c in columns), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b)
    found = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_r_{c}").alias(c) for c in columns))), ignorenulls=True).over(w)
    return out.withColumn("_found", found).filter("_side = 1").select(*names, *(F.col(f"_found.{c}").alias(prefix + c) for c in columns))


def blocks(df: DataFrame, column: str, rows: int) -> tuple[Column, int]:
    """A number of each row that grows with a column, and how many there are: about `rows` rows have the same one.

    Equal values share a number; nulls have the last one, as they come last in SQL. The bounds come from all rows.
    """
    n = -(-df.count() // rows)
    if n < 2:
        return F.lit(0), 1
    shares = [k / n for k in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(column, shares, max(10_000, 20 * n))).first()[0] or []))
    kind = df.schema[column].dataType
    table = F.array(*(F.lit(b).cast(kind) for b in bounds)) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    # a binary search for the number of bounds below the value
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) < F.col(column), low + step).otherwise(low))
    return F.when(F.col(column).isNull(), len(bounds)).otherwise(found), len(bounds) + 1


def running_mean(df: DataFrame, key: str, order: list[str], value: str, mean: str = "mean", seen: str = "seen", rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row with the mean of a value and the number of rows up to it, in its key's order.

    A key's rows are cut into blocks along the first column of the order; a window runs over a block, and what came before
    the block is added from the blocks' sums. So no task holds more than a few blocks, however few keys there are.
    """
    number, n = blocks(df, order[0], rows)
    dealt = df.withColumn("_block", number)
    sums = dealt.groupBy(key, "_block").agg(F.sum(value).alias("_sum"), F.count(value).alias("_values"), F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_past") for c in ("_sum", "_values", "_rows")))
    w = Window.partitionBy(key, "_block").orderBy(*(F.asc_nulls_last(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.repartition(n, key, "_block").select("*", F.sum(value).over(w).alias("_sum"), F.count(value).over(w).alias("_values"), F.count("*").over(w).alias("_rows"))
    both = own.join(F.broadcast(past), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    values = F.col("_values") + F.col("_values_past")
    total = F.coalesce(F.col("_sum"), F.lit(0)) + F.col("_sum_past")
    return both.select(*df.columns, F.when(values > 0, total / values).alias(mean), (F.col("_rows") + F.col("_rows_past")).alias(seen))


def moments(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Weighted count, mean and variance per key; sums combine on the map side."""
    w = weight if weight is not None else F.lit(1.0)
    x = F.col(value)
    out = df.groupBy(*keys).agg(F.sum(w).alias("count"), F.sum(w * x).alias("_s"), F.sum(w * x * x).alias("_q"))
    mean = F.col("_s") / F.col("count")
    return out.select(*keys, "count", mean.alias("mean"), (F.col("_q") / F.col("count") - mean * mean).alias("variance"))
