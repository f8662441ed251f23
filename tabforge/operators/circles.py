"""Where circles meet: a range join on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import settle

TILE_ROWS = 1_000
CELL = ["grid", "cx", "cy"]
DEALT = [*CELL, "a_tile", "b_tile"]


def intersection_points(dx: Column, dy: Column, r1: Column, r2: Column) -> Column:
    """0, 1 (touching) or 2 common points, decided on squared distances."""
    apart = dx * dx + dy * dy
    outer, inner = (r1 + r2) * (r1 + r2), (r1 - r2) * (r1 - r2)
    return (
        F.when((apart == 0) & (r1 == r2), F.lit(0))  # one and the same circle
        .when((apart == outer) | (apart == inner), F.lit(1))
        .when((apart > inner) & (apart < outer), F.lit(2))
        .otherwise(F.lit(0))
    )


def _deal(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut each cell into tiles of both sides, so that a crowded cell is many small joins.

    The rows are few next to the pairs they make, so they are spread over all
    shuffle partitions instead of being merged by their size.
    """
    count = F.ceil(F.count("*") / TILE_ROWS)
    tiles = a.groupBy(*CELL).agg(count.alias("a_tiles")).join(
        b.groupBy(*CELL).agg(count.alias("b_tiles")), CELL
    )
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        return (
            side.join(tiles, CELL)
            .withColumn(f"{own}_tile", F.pmod(F.xxhash64("x", "y", "r"), f"{own}_tiles"))
            .withColumn(f"{other}_tile", F.explode(F.expr(f"sequence(0L, {other}_tiles - 1)")))
            .repartition(parts, *DEALT)
        )

    return dealt(a, "a", "b"), dealt(b, "b", "a")


def circle_intersections(circles: DataFrame) -> DataFrame:
    """Per circle (id, x, y, r): how many others it touches and how many it crosses.

    Equal circles are merged and counted first, so copies never pair up. Circles
    are graded by the power of two of their radius. Each grade has a grid of
    cells one diameter wide, so a circle covers at most four cells of its own
    grade or a coarser one. A pair meets on the grid of its larger circle, in the
    cell of the boxes' common lower corner, hence once. One giant circle
    therefore never widens the cells of the small ones.
    """
    distinct = settle(
        circles.where("r > 0")
        .groupBy("x", "y", "r")
        .agg(F.count("*").alias("copies"))
        .withColumn("grade", F.floor(F.log2("r")).cast("int"))
    )
    grades = [row[0] for row in distinct.select("grade").distinct().collect()]  # <= 2,100 exponents
    if not grades:
        none = F.lit(0).cast("bigint")
        return circles.select("id", none.alias("n_touch"), none.alias("n_cross"))

    def cell(c: Column, grid: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), grid + 2))

    def listed(grid: Column) -> DataFrame:
        x, y, r, g = F.col("x"), F.col("y"), F.col("r"), F.col("grid")
        return (
            distinct.withColumn("grid", grid)
            .withColumn("cx", F.explode(F.sequence(cell(x - r, g), cell(x + r, g))))
            .withColumn("cy", F.explode(F.sequence(cell(y - r, g), cell(y + r, g))))
        )

    coarser = F.filter(F.array(*[F.lit(g) for g in sorted(grades)]), lambda g: g >= F.col("grade"))
    larger, others = _deal(listed(F.col("grade")), listed(F.explode(coarser)))
    a, b = larger.alias("a"), others.alias("b")
    on_grid = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in DEALT]
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    low_x = F.greatest(F.col("a.x") - F.col("a.r"), F.col("b.x") - F.col("b.r"))
    low_y = F.greatest(F.col("a.y") - F.col("a.r"), F.col("b.y") - F.col("b.r"))
    reach = F.col("a.r") + F.col("b.r")
    pairs = a.join(b, on_grid).where(
        (F.abs(dx) <= reach)
        & (F.abs(dy) <= reach)
        & (F.col("a.cx") == cell(low_x, F.col("a.grid")))
        & (F.col("a.cy") == cell(low_y, F.col("a.grid")))
    )

    def seen(one: str, other: str) -> Column:
        return F.struct(
            *[F.col(f"{one}.{c}").alias(c) for c in ("x", "y", "r")],
            F.col(f"{other}.copies").alias("n"),
        )

    # Circles of one grade meet in both directions; of two grades only as (larger, smaller).
    sides = F.when(F.col("a.grade") == F.col("b.grade"), F.array(seen("a", "b"))).otherwise(
        F.array(seen("a", "b"), seen("b", "a"))
    )
    points = intersection_points(dx, dy, F.col("a.r"), F.col("b.r"))
    counts = (
        pairs.select(points.alias("points"), sides.alias("sides"))
        .where("points > 0")
        .select("points", F.inline_outer("sides"))  # never empty; plain inline would test that
        .groupBy("x", "y", "r")
        .agg(
            F.sum(F.when(F.col("points") == 1, F.col("n")).otherwise(0)).alias("n_touch"),
            F.sum(F.when(F.col("points") == 2, F.col("n")).otherwise(0)).alias("n_cross"),
        )
    )
    return circles.join(counts, ["x", "y", "r"], "left").select(
        "id",
        F.coalesce("n_touch", F.lit(0)).alias("n_touch"),
        F.coalesce("n_cross", F.lit(0)).alias("n_cross"),
    )
