"""Ranks, distances and summaries of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import degree_distance, distance_km

#: Rank of a correct cell that was not ranked.
NO_RANK = 1_000_000_000
#: Ranks that accuracy is reported at.
RANKS = (*range(1, 11), *range(20, 101, 10))
NEAR_KM = 161.0


def correct_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc, correct_rank): rank of each document's own cell; NO_RANK if it isn't among the ranked.

    ranked: (doc, cell, rank); truth: (doc, correct_cell).
    """
    hit = ranked.select("doc", F.col("cell").alias("correct_cell"), "rank")
    joined = truth.select("doc", "correct_cell").join(hit, ["doc", "correct_cell"], "left")
    return joined.select("doc", "correct_cell", F.coalesce("rank", F.lit(NO_RANK)).alias("correct_rank"))


def results(predicted: DataFrame, truth: DataFrame, ranks: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per document: predicted and correct cell, their points, distances and rank.

    predicted: (doc, cell); truth: (doc, lat, lon, correct_cell); ranks: (doc,
    correct_rank); cells: (cell, clat, clon, n_docs).  A correct cell without
    training documents has no oracle distance.
    """
    points = cells.select("cell", "clat", "clon", "n_docs")
    joined = truth.join(predicted.select("doc", F.col("cell").alias("pred_cell")), "doc").join(ranks.select("doc", "correct_rank"), "doc")
    p = points.select(F.col("cell").alias("pred_cell"), F.col("clat").alias("pred_lat"), F.col("clon").alias("pred_lon"))
    c = points.select(F.col("cell").alias("correct_cell"), F.col("clat").alias("own_lat"), F.col("clon").alias("own_lon"), F.col("n_docs").alias("own_docs"))
    joined = joined.join(p, "pred_cell").join(c, "correct_cell", "left")
    lat, lon = F.col("lat"), F.col("lon")
    return joined.withColumns(
        {
            "error_km": distance_km(lat, lon, F.col("pred_lat"), F.col("pred_lon")),
            "oracle_km": F.when(F.col("own_lat").isNotNull(), distance_km(lat, lon, F.col("own_lat"), F.col("own_lon"))),
            "error_degrees": degree_distance(lat, lon, F.col("pred_lat"), F.col("pred_lon")),
        }
    )


def summary(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents, accuracy, share within 161 km, mean and median distance and the mean of both."""
    out = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.avg(F.when(F.col("correct_rank") == 1, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.when(F.col("error_km") <= NEAR_KM, 1.0).otherwise(0.0)).alias("acc_161"),
        F.avg("error_km").alias("mean_km"),
        F.percentile("error_km", 0.5).alias("median_km"),
    )
    return out.withColumn("average_km", (F.col("mean_km") + F.col("median_km")) / 2)


def accuracy_at(ranks: DataFrame, at: Sequence[int] = RANKS) -> DataFrame:
    """(n, accuracy) of a correct rank of at most n, and credit of 101 - rank, in one pass."""
    sums = [F.sum(F.when(F.col("correct_rank") <= n, 1).otherwise(0)).alias(f"a{n}") for n in at]
    credit = F.avg(F.when(F.col("correct_rank") <= 100, 101 - F.col("correct_rank")).otherwise(0)).alias("credit")
    one = ranks.agg(F.count(F.lit(1)).alias("n_docs"), credit, *sums)
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"a{n}").alias("hits")) for n in at])
    flat = one.select("n_docs", "credit", F.explode(rows).alias("r"))
    share = F.when(F.col("n_docs") > 0, F.col("r.hits") / F.greatest(F.col("n_docs"), F.lit(1)))
    return flat.select("r.n", "r.hits", share.alias("accuracy"), "credit")


def oracle_in_top(ranked: DataFrame, truth: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, rank, km, best_km): the least distance among the cells up to each rank."""
    joined = ranked.join(truth.select("doc", "lat", "lon"), "doc").join(cells.select("cell", "clat", "clon"), "cell")
    joined = joined.withColumn("km", distance_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    upto = Window.partitionBy("doc").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select("doc", "rank", "km", F.min("km").over(upto).alias("best_km"))


def knn_spread(ranked: DataFrame, truth: DataFrame, cells: DataFrame, k: int = 4) -> DataFrame:
    """(doc, knn_km): mean distance of the nearest k/2 among the k best cells."""
    near = oracle_in_top(ranked.filter(F.col("rank") <= k), truth, cells)
    order = F.row_number().over(Window.partitionBy("doc").orderBy("km", "rank"))
    return near.withColumn("_o", order).filter(F.col("_o") <= k // 2).groupBy("doc").agg(F.avg("km").alias("knn_km"))


def range_label(value: Column, edges: Sequence[float]) -> Column:
    """Lower edge of the half-open range that holds a value; null below the first edge."""
    out = F.lit(None).cast("double")
    for e in sorted(edges):
        out = F.when(value >= e, float(e)).otherwise(out)
    return out


def by_range(found: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    return summary(found.withColumn("range_from", range_label(value, edges)), ["range_from"])


#: Fractions of a cell that true distances are sorted by.
FRACTIONS = (0, 0.25, 0.5, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)


def zipf(predicted: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, n, rank, cumulative_percent) of predicted cells, the most frequent first.

    Counts are per cell, so one task sorts no more rows than the grid has cells.
    """
    counts = predicted.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), cell)
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumns({"rank": F.row_number().over(order), "cumulative_percent": 100 * running / F.sum("n").over(Window.partitionBy())})


def evaluation_subset(rows: DataFrame, order: Sequence[str], skip: int = 0, every: int = 1, limit: int | None = None) -> DataFrame:
    """Skip rows, then keep each `every`-th and `limit` of them in all; a sampling operator over an ordered set of tests."""
    from .rows import with_positions

    numbered = with_positions(rows, order).withColumn("_n", F.col("position") - skip).drop("position")
    kept = numbered.filter((F.col("_n") >= 0) & (F.col("_n") % every == 0))
    if limit is not None:
        kept = kept.filter(F.col("_n") < limit * every)
    return kept.drop("_n")


def compare_errors(a: DataFrame, b: DataFrame, key: str = "title") -> DataFrame:
    """(key, a_km, b_km, diff) of two result tables, on titles that both have."""
    left = a.select(key, F.col("error_km").alias("a_km"))
    return left.join(b.select(key, F.col("error_km").alias("b_km")), key).withColumn("diff", F.col("b_km") - F.col("a_km"))


def compare_grids(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row", "col"), value: str = "n_docs") -> DataFrame:
    """(keys, d1, d2, ratio): shares of each cell in two grids and 1 / (1 + d1 / d2); a missing side has share 0.

    Without a second share the ratio is 0, without a first 1.
    """

    def shares(df: DataFrame, name: str) -> DataFrame:
        whole = df.agg(F.sum(value).alias("_t"))
        return df.join(F.broadcast(whole)).select(*keys, (F.col(value) / F.col("_t")).alias(name))

    both = shares(a, "d1").join(shares(b, "d2"), list(keys), "full").fillna(0.0, ["d1", "d2"])
    ratio = F.when(F.col("d2") == 0, 0.0).otherwise(F.col("d2") / (F.col("d1") + F.col("d2")))
    return both.withColumn("ratio", ratio)


def compare_toponyms(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("docid", "sentind", "topind")) -> DataFrame:
    """Toponyms that two runs resolve differently; a toponym that differs by name is an input error (`clash`)."""
    left = a.select(*keys, "toponym", F.col("predloc").alias("a_loc"), F.col("correctloc").alias("gold"))
    right = b.select(*keys, F.col("toponym").alias("_t"), F.col("predloc").alias("b_loc"))
    joined = left.join(right, list(keys)).filter(~F.col("a_loc").eqNullSafe(F.col("b_loc")))
    return joined.withColumn("clash", F.col("toponym") != F.col("_t")).drop("_t")


def log_results(lines: DataFrame, col: str = "value") -> DataFrame:
    """(file, measure, km) of lines such as `Mean error distance = 12.3 km` in run logs."""
    pattern = r"(?i)\b(mean|median)\b[^=:0-9]*[=:]\s*([0-9]+(?:\.[0-9]+)?)"
    found = lines.filter(F.col(col).rlike(pattern))
    return found.select("file", F.lower(F.regexp_extract(col, pattern, 1)).alias("measure"), F.regexp_extract(col, pattern, 2).cast("double").alias("km"))


#: Orders of a table of results; without one, the least average of mean and median comes first.
RESULT_ORDERS = {"average": ("average_km", True), "mean": ("mean_km", True), "median": ("median_km", True), "accuracy": ("accuracy", False), "acc161": ("acc_161", False), "numeval": ("n_eval", False), "file": ("file", True)}


def sorted_results(summaries: DataFrame, by: str = "average") -> DataFrame:
    """Summaries of results files in one of RESULT_ORDERS, ties by file."""
    col, up = RESULT_ORDERS[by]
    return summaries.orderBy(F.col(col).asc() if up else F.col(col).desc(), "file")
