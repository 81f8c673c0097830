"""Positions, running sums and exact percentiles in a global order, without a task that sees all rows.

Rows are dealt into ranges of the order by bounds that a bounded sample gives; ranges are numbered on their own and offset by the totals of those before, of which there are as many
as shuffle partitions, within ``RANGES``, for each group. The bounds are literals of the plan, so a task that runs again deals its rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Least and most ranges.
RANGES = (32, 512)
#: Sampled rows for each range.
SAMPLED = 64


def cuts(df: DataFrame, order: list[str], ranges: int | None = None) -> list[tuple]:
    """At most ranges - 1 ascending bounds that part df about evenly."""
    ranges = ranges or min(RANGES[1], max(RANGES[0], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(*order).orderBy(F.xxhash64(*order, F.lit(7))).limit(ranges * SAMPLED).collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
    return sorted({rows[i] for i in range(SAMPLED, len(rows), SAMPLED)}, key=lambda r: tuple((x is not None, x) for x in r))


def part_of(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """Number of bounds at or below a row, by halving."""
    kinds = {f.name: f.dataType for f in df.select(*order).schema}
    key = F.struct(*order)

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        bound = F.struct(*(F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(order, bounds[mid], strict=True)))
        return F.when(key < bound, pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(bounds))


def running(df: DataFrame, order: list[str], sums: dict[str, str], by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds, under each name, the sum of a column over all rows of the group up to and including this one. The order should be total."""
    keys = [*by, *order]
    dealt = df.withColumn("_part", part_of(df, keys, cuts(df, keys, ranges)))
    totals = dealt.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' totals only
    ahead = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_at"), *(F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_a{i}") for i in range(len(sums))))
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(F.sum(c).over(own).alias(f"_l{i}") for i, c in enumerate(sums.values())))
    met = F.col("_part") == F.col("_at")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(ahead, met)
    return joined.select(*(F.col(c) for c in df.columns), *((F.col(f"_l{i}") + F.col(f"_a{i}")).alias(n) for i, n in enumerate(sums)))


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds the position of each row in its group's order, from 0."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, by, ranges)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def milestones(df: DataFrame, order: list[str], by: list[str] = (), parts: int = 10) -> DataFrame:
    """The rows at which another tenth (or other part) of the group is done, and which one (mark)."""
    size = df.groupBy(*by).agg(F.count("*").alias("_all")).select(*(F.col(c).alias(f"_by_{c}") for c in by), "_all")
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = numbered(df, order, "_pos", by)
    both = placed.join(size, met) if by else placed.crossJoin(F.broadcast(size))  # one row without groups
    mark = F.floor(float(parts) * (F.col("_pos") + 1) / F.col("_all"))
    return both.withColumn("mark", mark).where(F.col("mark") > F.floor(float(parts) * F.col("_pos") / F.col("_all"))).select(*df.columns, "mark")


def percentiles(df: DataFrame, column: str, shares: list[float], by: list[str] = (), names: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """by and, under each name, the exact percentile with linear interpolation between sorted values; nulls don't count.

    Rows are counted by distinct value first; the values at the two places are picked from running counts. No task holds the values of a group.
    """
    names = names or [f"p{round(100 * q)}" for q in shares]
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = running(counted, ["_v"], {"_c": "_n"}, by, ranges)
    all_ = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    all_ = all_.select(*keys, "_all")
    met = F.lit(True)
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = upto.join(all_, met) if by else upto.crossJoin(F.broadcast(all_))  # one row without groups

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("_c") > place) & (F.col("_c") - F.col("_n") <= place), F.col("_v")))

    out = []
    for q, name in zip(shares, names, strict=True):
        place = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    return rows.groupBy(*by).agg(*out)
