"""Change and accuracy of yearly class maps (pixel, year, class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.guards import ratio


def transitions(maps: DataFrame, pixel: list[str], year: str, value: str, first: int, second: int) -> DataFrame:
    """from_class, to_class, n between two years: pixels of both years meet by an equi-join."""
    a = maps.filter(F.col(year) == first).select(*pixel, F.col(value).alias("from_class"))
    b = maps.filter(F.col(year) == second).select(*pixel, F.col(value).alias("to_class"))
    return a.join(b, pixel).groupBy("from_class", "to_class").agg(F.count(F.lit(1)).alias("n"))


def transitions_by_step(maps: DataFrame, pixel: list[str], year: str, value: str, years: list[int]) -> DataFrame:
    """from_year, to_year, from_class, to_class, n for each two years that follow each other in the list: one equi-join for all steps."""
    after = dict(zip(sorted(years), sorted(years)[1:], strict=False))
    follow = F.create_map(*[F.lit(x) for step in after.items() for x in step])
    a = maps.filter(F.col(year).isin(*after)).select(*pixel, F.col(year).alias("from_year"), F.try_element_at(follow, F.col(year)).alias("to_year"), F.col(value).alias("from_class"))
    b = maps.select(*pixel, F.col(year).alias("to_year"), F.col(value).alias("to_class"))
    return a.join(b, [*pixel, "to_year"]).groupBy("from_year", "to_year", "from_class", "to_class").agg(F.count(F.lit(1)).alias("n"))


def change_products(maps: DataFrame, pixel: list[str], year: str, value: str, years: list[int], developed: tuple[int, ...], pixel_ha: float) -> dict[str, DataFrame]:
    """All products of a change analysis over some years, of which there must be two at least, each with a map: a table for each, by name."""
    held = {r[0] for r in maps.select(year).distinct().collect()}  # a row for each year
    if len(set(years)) < 2 or not set(years) <= held:
        raise ValueError(f"a change analysis needs two years or more that have maps; {sorted(set(years) - held)} have none")
    chosen = maps.filter(F.col(year).isin(*years))
    steps = transitions_by_step(chosen, pixel, year, value, years).withColumn("ha", F.col("n") * pixel_ha)
    first_last = transitions(chosen, pixel, year, value, min(years), max(years)).withColumn("ha", F.col("n") * pixel_ha)
    counts = chosen.groupBy(year, value).agg(F.count(F.lit(1)).alias("n"))
    changed = F.sum(F.when(F.col("from_class") != F.col("to_class"), F.col("n")).otherwise(0))
    return {
        "steps": steps,
        "matrix": first_last,
        "gains_losses": gains_losses(first_last),
        "fractions": counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(year))),
        "intensity": steps.groupBy("from_year", "to_year").agg(F.sum("n").alias("n"), changed.alias("n_changed")).withColumn("percent", 100.0 * F.col("n_changed") / F.col("n")),
        "trajectory": trajectory(chosen, pixel, year, value, developed),
    }


def gains_losses(matrix: DataFrame) -> DataFrame:
    """class_id, gain, loss, net of a transition matrix."""
    moved = matrix.filter("from_class <> to_class")
    both = moved.select(F.col("to_class").alias("class_id"), F.col("n").alias("gain"), F.lit(0).cast("long").alias("loss")).unionByName(moved.select(F.col("from_class").alias("class_id"), F.lit(0).cast("long").alias("gain"), F.col("n").alias("loss")))
    return both.groupBy("class_id").agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss")).withColumn("net", F.col("gain") - F.col("loss"))


def year_steps(maps: DataFrame, pixel: list[str], year: str, value: str) -> DataFrame:
    """Each row with the pixel's class of the row before (prev) and of the next two (next1, next2)."""
    w = Window.partitionBy(*pixel).orderBy(year)
    return maps.withColumns({"prev": F.lag(value).over(w), "next1": F.lead(value, 1).over(w), "next2": F.lead(value, 2).over(w)})


def trajectory(maps: DataFrame, pixel: list[str], year: str, value: str, developed: tuple[int, ...]) -> DataFrame:
    """Number of changes, hotspot (three or more), and 0 persistent, 1 gain, 2 loss, 3 fluctuating by first and last class."""
    steps = year_steps(maps, pixel, year, value)
    per = steps.groupBy(*pixel).agg(F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col(value))).alias("n_changes"), F.min_by(value, year).alias("first_class"), F.max_by(value, year).alias("last_class"))
    changed = F.col("first_class") != F.col("last_class")
    kind = F.when(changed & F.col("first_class").isin(*developed), 2).when(changed & F.col("last_class").isin(*developed), 1).when(changed, 3).otherwise(0)
    return per.withColumns({"hotspot": F.col("n_changes") >= 3, "trajectory": kind})


def trend(maps: DataFrame, pixel: list[str], year: str, value: str) -> DataFrame:
    """Trend by the shares of development and vegetation in the earlier and later half of a pixel's years: 0 stable, 1 urbanising, 2 greening, 3 losing vegetation, 4 variable."""
    w = Window.partitionBy(*pixel)
    o = w.orderBy(year)
    base = maps.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(o), "__prev": F.lag(value).over(o)})
    late = F.col("__i") > F.floor(F.col("__n") / 2)
    share = lambda kinds, half: F.coalesce(F.avg(F.when(half, F.col(value).isin(*kinds).cast("double"))), F.lit(0.0))
    per = base.groupBy(*pixel).agg(
        F.max("__n").alias("n_years"), F.count_if(F.col("__prev").isNotNull() & (F.col("__prev") != F.col(value))).alias("n_changes"),
        share((5, 6), ~late).alias("early_dev"), share((5, 6), late).alias("late_dev"), share((2, 3), ~late).alias("early_veg"), share((2, 3), late).alias("late_veg"),
    )
    label = (
        F.when(F.col("late_dev") > F.col("early_dev") + 0.2, 1)
        .when(F.col("late_veg") > F.col("early_veg") + 0.2, 2)
        .when(F.col("early_veg") > F.col("late_veg") + 0.2, 3)
        .when(F.col("n_changes") > F.col("n_years") * 0.4, 4)
        .otherwise(0)
    )
    return per.withColumn("trend", label)


def constrain(maps: DataFrame, pixel: list[str], year: str, value: str, allowed: dict[int, tuple[int, ...]]) -> DataFrame:
    """Each year's class, kept only if it may follow the corrected class of the year before: a fold over the pixel's years."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    series = F.array_sort(F.collect_list(F.struct(F.col(year).alias("year"), F.col(value).cast("int").alias("cls"))))
    empty = F.array().cast("array<struct<year:int,cls:int,fixed:int>>")

    def step(done: Column, x: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))["fixed"]
        ok = before.isNull() | F.coalesce(F.array_contains(F.try_element_at(table, before), x["cls"]), F.lit(False))
        return F.concat(done, F.array(F.struct(x["year"].cast("int").alias("year"), x["cls"].alias("cls"), F.when(ok, x["cls"]).otherwise(before).alias("fixed"))))

    folded = maps.groupBy(*pixel).agg(F.aggregate(series, empty, step).alias("s"))
    return folded.select(*pixel, F.explode("s").alias("s")).select(*pixel, F.col("s.year").alias(year), F.col("s.cls").alias(value), F.col("s.fixed").alias("corrected"))


def dominant(maps: DataFrame, pixel: list[str], value: str) -> DataFrame:
    """The most frequent class of a pixel, the lowest of equals, and its count."""
    counts = maps.groupBy(*pixel, value).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*pixel).orderBy(F.desc("n"), value)
    return counts.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def confusion(pairs: DataFrame, predicted: str, reference: str) -> DataFrame:
    """pred, ref, n; rows are predicted, columns reference."""
    return pairs.groupBy(F.col(predicted).cast("int").alias("pred"), F.col(reference).cast("int").alias("ref")).agg(F.count(F.lit(1)).alias("n"))


def overall_accuracy(matrix: DataFrame) -> DataFrame:
    """One row: total, overall accuracy and kappa."""
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("pred") == F.col("ref"), F.col("n")).otherwise(0)).alias("hits"))
    row, col = matrix.groupBy("pred").agg(F.sum("n").alias("r")), matrix.groupBy("ref").agg(F.sum("n").alias("c"))
    chance = row.join(col, F.col("pred") == F.col("ref")).agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("chance"))
    po, pe = F.try_divide(F.col("hits").cast("double"), F.col("total")), F.try_divide(F.col("chance"), F.col("total").cast("double") * F.col("total"))
    return total.crossJoin(F.broadcast(chance)).select("total", po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def class_accuracy(matrix: DataFrame) -> DataFrame:
    """class_id, producers and users accuracy, f1 of each class that occurs."""
    diagonal = F.when(F.col("pred") == F.col("ref"), F.col("n")).otherwise(0)
    both = matrix.select(F.explode(F.array(F.struct(F.col("pred").alias("class_id"), F.col("n").alias("p"), F.lit(0).cast("long").alias("r"), diagonal.cast("long").alias("h")), F.struct(F.col("ref").alias("class_id"), F.lit(0).cast("long").alias("p"), F.col("n").alias("r"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    sums = both.groupBy("class_id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("h").alias("h"))
    return sums.select("class_id", ratio(F.col("h").cast("double"), F.col("r")).alias("producers"), ratio(F.col("h").cast("double"), F.col("p")).alias("users"), ratio(2.0 * F.col("h"), F.col("r") + F.col("p")).alias("f1"))


def nearest_year(left: DataFrame, right: DataFrame, left_year: str, right_year: str, tolerance: int | None = None) -> DataFrame:
    """Each left year with the nearest right year, the earliest of equals; beyond the tolerance none. Years are dimensions of a few rows, distinct before they meet."""
    years = right.select(right_year).distinct()
    best = Window.partitionBy(left_year).orderBy(F.abs(F.col(left_year) - F.col(right_year)), right_year)
    pairs = left.select(left_year).distinct().crossJoin(F.broadcast(years)).withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
    return pairs if tolerance is None else pairs.filter(F.abs(F.col(left_year) - F.col(right_year)) <= tolerance)
