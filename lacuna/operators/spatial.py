"""Distance joins on an integer grid: an equi-join of cells in place of a nested loop.

Rows with null or non-finite coordinates meet nothing. Repeated rows meet each. Input columns keep their names whatever
they are; those of the grid take free names. Empty sides give empty joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import AXES, square_distance


def cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def shuffled(df: DataFrame, times: int | None = None) -> DataFrame:
    """df, never broadcast in its next join; with `times`, only where so many times its estimated size passes Spark's threshold.

    Spark takes the size of an explode for that of its input, and so would broadcast millions of rows made from a small table.
    """
    if times is not None:
        most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * times <= most:
            return df
    return df.hint("merge")


def pairs_within(left: DataFrame, right: DataFrame, reach: float, on: Column | None = None, how: str = "inner", width: float | None = None) -> DataFrame:
    """Rows of left (alias a) with rows of right (alias b) at most `reach` away and meeting `on`; d2 is the squared distance.

    Each right row is put into its cell and the 26 around it, so the join is on three integers and its output is the pairs of
    neighbouring cells. Spark broadcasts or shuffles the sides by their sizes, counting the right one 27 times; dense cells
    split by AQE's skew join. width: of the cells, for an `on` that lets no coordinates differ by more than that.
    """
    width = reach if width is None else width
    grid = "g"
    while any(c.lower().startswith(grid) for c in (*left.columns, *right.columns)):
        grid = "_" + grid  # input columns keep their names and values
    near = F.sequence(F.lit(-1), F.lit(1))
    a = left.withColumns({f"{grid}{c}": cell(c, width) for c in AXES})
    b = shuffled(right, 27)
    around = lambda home: F.explode(F.transform(near, lambda o: home + o))
    for c in AXES:
        b = b.withColumn(f"{grid}{c}", around(cell(c, width)))
    keys = [F.col(f"a.{grid}{c}") == F.col(f"b.{grid}{c}") for c in AXES]
    d2 = square_distance("a", "b")
    test = (d2 <= reach * reach) & keys[0] & keys[1] & keys[2]
    joined = a.alias("a").join(b.alias("b"), test if on is None else test & on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(*(f"{grid}{c}" for c in AXES))
    return joined.withColumn("d2", d2)


def nearest_site(points: DataFrame, sites: DataFrame, key: str, reach: float, cap: float | None = None) -> DataFrame:
    """(key, odist): distance of each point to its nearest site. With `cap` (at most `reach`) the answer is cut there.

    Without a cap, points with no site in reach meet the occupied cells of the sites instead, one row each: first within four
    times the reach, and so on, until one is found; its distance bounds the answer, and only sites of cells that may be nearer
    are compared. Every round is written. Without sites the distance is null (or the cap). Points with null coordinates have
    no distance; equal keys must have equal places.
    """
    from lacuna.operators.iterate import forget, written

    places = sites.select(*AXES)
    near = pairs_within(points.select(key, *AXES), places, reach).groupBy(F.col(f"a.{key}").alias(key)).agg(F.sqrt(F.min("d2")).alias("odist"))
    if cap is not None:
        return points.select(key).join(shuffled(near), key, "left").select(key, F.least(F.coalesce("odist", F.lit(cap)), F.lit(cap)).alias("odist"))
    found = [written(near)]
    rest = written(points.select(key, *AXES).join(found[0], key, "left_anti"))
    if rest.isEmpty():
        return found[0]
    at = {f"c{c}": cell(c, reach) for c in AXES}
    cells = written(places.withColumns(at).groupBy(*at).agg(F.min(F.struct(*AXES)).alias("one")).select(*at, "one.*"))
    ends = points.select(*AXES).unionByName(places).agg(*(F.max(c) - F.min(c) for c in AXES)).first()
    span, wide = sum(x * x for x in ends if x is not None) ** 0.5, reach
    if cells.isEmpty():
        return found[0].unionByName(points.select(key, F.lit(None).cast("double").alias("odist")))
    while not rest.isEmpty() and wide <= 4 * span:
        wide *= 4
        bound = pairs_within(rest, cells, wide).groupBy(F.col(f"a.{key}").alias(key)).agg(F.sqrt(F.min("d2")).alias("bound"))
        now = written(rest.join(bound, key))
        middle = cells.select(*at, *((F.col(f"c{c}") + 0.5).alias(f"m{c}") for c in AXES)).select(*at, *((F.col(f"m{c}") * reach).alias(c) for c in AXES))
        slack = reach * 3**0.5 / 2 + 1e-9
        close = pairs_within(now, middle, wide + slack, F.sqrt(square_distance("a", "b")) <= F.col("a.bound") + slack)
        own = close.select(F.col(f"a.{key}").alias(key), *(F.col(f"a.{c}").alias(f"p{c}") for c in AXES), *(F.col(f"b.{c}").alias(c) for c in at))
        d2 = sum(((F.col(f"p{c}") - F.col(c)) * (F.col(f"p{c}") - F.col(c)) for c in AXES), F.lit(0.0))
        found.append(written(own.join(places.withColumns(at), list(at)).groupBy(key).agg(F.sqrt(F.min(d2)).alias("odist"))))
        left = written(rest.join(now.select(key), key, "left_anti"))
        forget(rest, now)
        rest = left
    forget(rest, cells)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def top_by(df: DataFrame, group: list[str], order: list[str], n: int = 1) -> DataFrame:
    """First n rows of each group; Spark keeps n a task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def thin(points: DataFrame, reach: float, key: str = "id", order: str = "id") -> DataFrame:
    """Greedy thinning in the order given: a point is kept unless one kept before it is nearer than `reach`.

    Decided in rounds: a point without an undecided earlier neighbour is kept, its later neighbours are dropped. The result
    is that of the one-by-one rule; a round is a join of neighbours, and no cell is gathered in a task.
    """
    from lacuna.operators.iterate import greedy

    links = pairs_within(points.select(key, order, *AXES), points.select(key, order, *AXES), reach, (F.struct(f"a.{order}", f"a.{key}") < F.struct(f"b.{order}", f"b.{key}")) & (square_distance("a", "b") < reach * reach))
    kept = greedy(points.select(F.col(key).alias("k")), links.select(F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("then")))
    return points.join(kept.select(F.col("k").alias(key)), key, "left_semi")
