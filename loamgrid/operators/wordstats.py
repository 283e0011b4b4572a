"""Statistics of words: comparison of corpora, information gain, spatial autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _x_ln_x(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0)


def _part(observed: Column, expected: Column) -> Column:
    good = (observed > 0) & (expected > 0)
    return F.when(good, observed * F.ln(F.when(good, observed / expected).otherwise(1.0))).otherwise(0.0)


def dunning_2x1(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G2 of a word with a and b occurrences, against c and d other tokens."""
    total = a + b + c + d
    return 2 * (_part(a, (a + c) * (a + b) / total) + _part(b, (b + d) * (a + b) / total))


def dunning_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G2 of the whole table: cells and grand total less the margins, each as x ln x."""
    cells = _x_ln_x(a) + _x_ln_x(b) + _x_ln_x(c) + _x_ln_x(d) + _x_ln_x(a + b + c + d)
    margins = _x_ln_x(a + b) + _x_ln_x(c + d) + _x_ln_x(a + c) + _x_ln_x(b + d)
    return 2 * (cells - margins)


def pivoted(grams: DataFrame, side: str, sides: Sequence[str]) -> DataFrame:
    """(gram, one count per side, one total per side): conditional sums, one shuffle, no outer join."""
    wide = grams.groupBy("gram").agg(*[F.sum(F.when(F.col(side) == s, F.col("cnt")).otherwise(0.0)).alias(f"c_{s}") for s in sides])
    sums = grams.agg(*[F.sum(F.when(F.col(side) == s, F.col("cnt")).otherwise(0.0)).alias(f"t_{s}") for s in sides])  # one row
    return wide.join(F.broadcast(sums))


def compare_two(grams: DataFrame, side: str = "side", sides: tuple[str, str] = ("before", "after"), min_prob: float = 0.0) -> DataFrame:
    """(gram, counts, p, q, change, g2) of words of either side whose share reaches `min_prob` on one."""
    x, y = sides
    wide = pivoted(grams, side, sides)
    a, b, ta, tb = (F.col(f"{n}_{s}") for n in ("c", "t") for s in (x, y))
    p, q = F.coalesce(F.try_divide(a, ta), F.lit(0.0)), F.coalesce(F.try_divide(b, tb), F.lit(0.0))
    out = wide.select(
        "gram", a.alias(f"n_{x}"), b.alias(f"n_{y}"), p.alias("p"), q.alias("q"), (q - p).alias("change"),
        dunning_2x1(a, b, ta - a, tb - b).alias("g2"), dunning_2x2(a, b, ta - a, tb - b).alias("g2_table"),
    )
    return out.filter((F.greatest("p", "q") > 0) & (F.greatest("p", "q") >= min_prob))


def comparison_report(compared: DataFrame, most: int = 200) -> DataFrame:
    """Top grams by g2, by increase and by decrease (a top-k report): (list, place, ...)."""
    lists = {"g2": (F.lit(True), F.col("g2")), "increase": (F.col("change") > 0, F.col("g2")), "decrease": (F.col("change") < 0, F.col("g2"))}
    parts = []
    for name, (test, by) in lists.items():
        best = compared.filter(test).orderBy(F.round(by, 6).desc(), "gram").limit(most)
        parts.append(best.withColumns({"list": F.lit(name), "place": F.row_number().over(Window.orderBy(F.round(by, 6).desc(), "gram"))}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_four(grams: DataFrame, side: str = "side", camps: tuple[str, str] = ("lib", "con")) -> DataFrame:
    """Two camps before and after: (gram, percent change of each, label).

    Sides are named `<camp>_before` and `<camp>_after`.  The change is null where
    the word was not used before.  Label: +both, -both, or + the camp whose share
    grew more.
    """
    sides = [f"{c}_{t}" for c in camps for t in ("before", "after")]
    wide = pivoted(grams, side, sides)
    share = {s: F.coalesce(F.try_divide(F.col(f"c_{s}"), F.col(f"t_{s}")), F.lit(0.0)) for s in sides}
    change = {c: F.try_divide(share[f"{c}_after"] - share[f"{c}_before"], share[f"{c}_before"]) * 100 for c in camps}
    delta = {c: share[f"{c}_after"] - share[f"{c}_before"] for c in camps}
    a, b = camps
    label = (
        F.when((delta[a] > 0) & (delta[b] > 0), "+both")
        .when((delta[a] < 0) & (delta[b] < 0), "-both")
        .when(delta[a] >= delta[b], f"+{a}")
        .otherwise(f"+{b}")
    )
    return wide.select("gram", *[F.col(f"c_{s}").alias(f"n_{s}") for s in sides], change[a].alias(f"{a}_percent"), change[b].alias(f"{b}_percent"), label.alias("label"))


def word_properties(cell_grams: DataFrame, cell: str = "cell") -> DataFrame:
    """Counts, entropy, information gain and gain ratio of each word over the cells.

    H(cell | not w) needs all cells for each word; as most lack the word, the
    sum over all cells is a constant that is corrected in the cells that hold
    it.  So each (gram, cell) pair is visited once.
    """
    cells = cell_grams.groupBy(cell).agg(F.sum("cnt").alias("nk"))
    whole = cells.agg(F.sum("nk").alias("t"), F.sum(_x_ln_x(F.col("nk").cast("double"))).alias("sk"))  # one row
    joined = cell_grams.join(cells, cell)
    x, k = F.col("cnt").cast("double"), F.col("nk").cast("double")
    sums = joined.groupBy("gram").agg(
        F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(_x_ln_x(x)).alias("sx"),
        F.sum(_x_ln_x(k - x) - _x_ln_x(k)).alias("fix"),
    )
    s = sums.join(F.broadcast(whole))
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    h_cells = F.ln(t) - F.col("sk") / t
    h_with = F.ln(n) - F.col("sx") / n
    rest = t - n
    h_without = F.when(rest > 0, F.ln(F.when(rest > 0, rest).otherwise(1.0)) - (F.col("sk") + F.col("fix")) / F.when(rest > 0, rest).otherwise(1.0)).otherwise(0.0)
    p = n / t
    own = -_x_ln_x(p) - _x_ln_x(1 - p)
    gain = h_cells - p * h_with - (1 - p) * h_without
    out = s.select("gram", F.col("n").alias("word_count"), F.col("n_cells").alias("cell_count"), h_with.alias("entropy"), gain.alias("inf_gain"), own.alias("_own"))
    e, w, c = F.col("entropy"), F.col("word_count"), F.col("cell_count")
    return out.withColumns(
        {
            "gain_ratio": F.try_divide(F.col("inf_gain"), F.col("_own")),
            "entropy_by_ln_words": F.try_divide(e, F.ln(w)),
            "entropy_by_ln_cells": F.try_divide(e, F.ln(c)),
            "entropy_by_words": F.try_divide(e, w),
            "entropy_by_cells": F.try_divide(e, c),
        }
    ).drop("_own")


def morans_i(cell_probs: DataFrame, least_cells: int = 16) -> DataFrame:
    """Spatial autocorrelation of each word held by at least `least_cells` cells: (gram, cells, mean, morans_i).

    cell_probs: (row, col, gram, p).  Each cell is compared with those of its
    four neighbours that hold the word; the self-join is on shifted indices, so
    a cell meets four rows at most.
    """
    means = cell_probs.groupBy("gram").agg(F.avg("p").alias("mean"), F.count(F.lit(1)).alias("cells")).filter(F.col("cells") >= least_cells)
    at = cell_probs.join(means, "gram").withColumn("d", F.col("p") - F.col("mean"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = at.select("gram", "d", F.explode(steps).alias("s"), "row", "col")
    sent = sent.select("gram", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("d").alias("near"))
    pairs = at.select("gram", "row", "col", "d").join(sent, ["gram", "row", "col"]).groupBy("gram").agg(
        F.sum(F.col("d") * F.col("near")).alias("cross"), F.count(F.lit(1)).alias("links")
    )
    spread = at.groupBy("gram").agg(F.sum(F.col("d") * F.col("d")).alias("squares"), F.first("mean").alias("mean"), F.first("cells").alias("cells"))
    out = spread.join(pairs, "gram")
    value = F.try_divide(F.col("cross") / F.col("links"), F.col("squares") / F.col("cells"))
    return out.select("gram", "cells", "mean", value.alias("morans_i"))


def feature_discrimination(features: DataFrame) -> DataFrame:
    """(feat, n, corr) of (inst, feat, value, correct 0/1): correlation of a feature with being right."""
    return features.groupBy("feat").agg(F.count(F.lit(1)).alias("n"), F.corr("value", F.col("correct").cast("double")).alias("corr"))


def strongest_weights(weights: DataFrame) -> DataFrame:
    """(feat, label, weight) of each feature's weight of the greatest size."""
    best = weights.groupBy("feat").agg(F.max_by(F.struct("label", "weight"), F.struct(F.abs("weight"), "label")).alias("b"))
    return best.select("feat", "b.label", "b.weight")


def topic_words(shares: DataFrame, most: int = 10) -> DataFrame:
    """The `most` words of the greatest share of each (topic, slice), a top-k report."""
    order = Window.partitionBy("topic", "slice").orderBy(F.col("share").desc(), "word")
    return shares.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def canonical_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased words for topic models: apostrophes joined, digits and marks apart, stopwords gone."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", ""), r"[^\p{L}]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(list(stopwords))) if stopwords else words


def short_word_counts(lines: DataFrame, below: int = 8, col: str = "value") -> DataFrame:
    """(word, cnt) of the pieces between single blanks that have fewer than `below` characters.

    Two blanks hold an empty piece and an empty line is one; blanks at the end
    of a line hold none.
    """
    cut = F.rtrim(F.col(col))
    pieces = F.when((cut == "") & (F.col(col) != ""), F.array().cast("array<string>")).otherwise(F.split(cut, " "))
    found = lines.select(F.explode(pieces).alias("word")).filter(F.length("word") < below)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def differing_features(features: DataFrame, group: Sequence[str], vector: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """(group, feature) of the features that are not the same in all vectors of a group.

    A feature is the same where it has one value and that is 0 or stands in
    every vector; vectors are those with any feature.
    """
    one = features.select(*group, F.col(vector).alias("_v"), F.col(feature).alias("feature"), F.col(value).alias("_x"))
    depth = one.groupBy(*group).agg(F.countDistinct("_v").alias("_depth"))
    seen = one.groupBy(*group, "feature").agg(F.countDistinct("_v").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    same = (F.col("_lo") == F.col("_hi")) & ((F.col("_lo") == 0) | (F.col("_n") == F.col("_depth")))
    return seen.join(depth, list(group)).filter(~same).select(*group, "feature")
