"""Scores of every cell for every test document, from sparse sums.

A smoothed model gives an unseen word its global probability times one factor
of the cell.  A score is therefore a part that only needs scalars of document
and cell, plus corrections for the words that both hold: one join on the gram
and one aggregate by (document, cell).  Nothing is computed for the many
(document, cell, word) triples in which the word is missing.  Of the cells'
grams only those of test documents are joined; sums over all words of a cell
are computed for the rankers that ask for them.

Scalars of cells are broadcast only while there are at most FEW_CELLS of them:
those of a K-d tree grow with the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .models import Smoothing, log_or_zero, probability, totals

RANKERS = (
    "naive-bayes",
    "partial-kl-divergence",
    "full-kl-divergence",
    "symmetric-partial-kl-divergence",
    "symmetric-full-kl-divergence",
    "partial-cosine-similarity",
    "full-cosine-similarity",
    "smoothed-partial-cosine-similarity",
    "smoothed-full-cosine-similarity",
    "sum-frequency",
    "average-cell-probability",
)
PRIORS = ("uniform", "num-docs", "log-num-docs", "salience", "log-salience")


#: Rankers that need sums, with global probabilities, over all words of a cell.
WHOLE_CELL = {"full-kl-divergence", "symmetric-partial-kl-divergence", "symmetric-full-kl-divergence", "smoothed-full-cosine-similarity"}
#: Most cells that are broadcast, about 150 bytes each.
FEW_CELLS = 200_000


def if_few(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """`rows`, of which each cell has one at most, marked for a broadcast if the cells are few."""
    return F.broadcast(rows) if cells.select("cell").limit(FEW_CELLS + 1).count() <= FEW_CELLS else rows


def prior(kind: str) -> Column:
    """Unnormalized prior of a cell with `n_docs` and `salience`."""
    if kind == "uniform":
        return F.lit(1.0)
    x = F.col("salience" if kind.endswith("salience") else "n_docs").cast("double")
    return F.log1p(x) + 1 if kind.startswith("log-") else x + 1


def _safe_ln(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def scores(
    test_grams: DataFrame,
    cell_grams: DataFrame,
    cells: DataFrame,
    global_stats: DataFrame,
    smoothing: Smoothing,
    rankers: Sequence[str] = ("naive-bayes",),
    prior_kind: str = "uniform",
    prior_weight: float = 0.5,
) -> DataFrame:
    """(doc, cell, one column for each ranker) of all documents and cells; greater is better.

    test_grams: (doc, gram, cnt); cell_grams: (cell, gram, cnt); cells: (cell,
    n_docs[, salience]); global_stats: (gram, g).  Ranker columns have `-`
    replaced by `_`.  Words without global probability count for the totals of
    a document or cell and the length of a cell's own vector, and for nothing
    else.  With interpolation and no ranker of WHOLE_CELL, global_stats needs
    the grams of the test documents alone.
    """
    unknown = set(rankers) - set(RANKERS)
    if unknown:
        raise ValueError(f"unknown rankers: {sorted(unknown)}")
    mixed = smoothing.interpolate
    doc_sums = totals(test_grams, ["doc"], smoothing, global_stats)
    doc_sums = doc_sums.select("doc", F.col("total").alias("nd"), F.col("u").alias("ud"), F.col("big_u").alias("bd"))
    cell_sums = totals(cell_grams, ["cell"], smoothing, global_stats)
    rest = F.when(F.col("big_u") > 0, F.col("u") / F.when(F.col("big_u") > 0, F.col("big_u")).otherwise(1.0)).otherwise(0.0)
    cell_sums = cell_sums.select("cell", F.col("total").alias("nk"), F.col("u").alias("uk"), F.col("big_u").alias("bk"), rest.alias("rk"))
    c, g, nd, nk, ud, uk, rk = (F.col(x) for x in ("c", "g", "nd", "nk", "ud", "uk", "rk"))

    # words of the documents, with the document's own smoothed probability
    p = probability(c, nd, ud, g, F.col("bd"), mixed)
    words = test_grams.select("doc", "gram", F.col("cnt").alias("c")).join(doc_sums, "doc")
    words = words.join(global_stats.select("gram", "g"), "gram", "left").withColumns({"p": p, "p0": c * (1 - ud) / nd})
    # words of the cells, with the cell's

    def held_of(grams: DataFrame, sums: DataFrame, stats: DataFrame) -> DataFrame:
        held = grams.select("cell", "gram", F.col("cnt").alias("ck")).join(sums, "cell").join(stats.select("gram", "g"), "gram")
        held = held.withColumn("q", probability(F.col("ck"), nk, uk, g, F.col("bk"), mixed))
        return held.withColumn("q0", F.col("ck") * (1 - uk) / nk)  # without a share of g

    asked = test_grams.select("gram").distinct()
    held = held_of(cell_grams.join(asked, "gram", "left_semi"), cell_sums, global_stats.join(asked, "gram", "left_semi"))
    cell_side = cell_sums.join(cells, "cell")
    scalars = {
        "kg1": g * F.ln(g),
        "kg0": g,
        "kg2": g * F.coalesce(_safe_ln(F.col("q0")), F.lit(0.0)),
        "kgq": g * F.col("q"),
        "kgg": g * g,
        "kqq": F.col("q") * F.col("q"),
        "kqlq": F.col("q") * _safe_ln(F.col("q")),
        "kq": F.col("q"),
        "kqlg": F.col("q") * F.ln(g),
    }
    if WHOLE_CELL & set(rankers):
        whole = held_of(cell_grams, if_few(cell_sums, cells), global_stats)
        cell_side = cell_side.join(whole.groupBy("cell").agg(*[F.sum(x).alias(n) for n, x in scalars.items()]), "cell", "left").fillna(0.0, list(scalars))
    else:
        cell_side = cell_side.withColumns({n: F.lit(0.0) for n in scalars})
    if "full-cosine-similarity" in rankers:
        squares = cell_grams.groupBy("cell").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("_k2"))
        cell_side = cell_side.join(squares, "cell").withColumn("kn2", F.col("_k2") / (nk * nk)).drop("_k2")
    else:
        cell_side = cell_side.withColumn("kn2", F.lit(0.0))
    weight = prior(prior_kind)
    cell_side = cell_side.withColumn("prior", weight / F.sum(weight).over(Window.partitionBy()))

    by_gram = None
    if "average-cell-probability" in rankers:
        (all_rest,) = cell_side.agg(F.sum("rk")).first()
        by_gram = held.groupBy("gram").agg(F.sum(F.col("q") - rk * g).alias("_x"), F.first("g").alias("_g"))
        by_gram = by_gram.select("gram", (F.col("_x") + F.col("_g") * F.lit(all_rest or 0.0)).alias("sw"))
        words = words.join(by_gram, "gram", "left")
    else:
        words = words.withColumn("sw", F.lit(None).cast("double"))
    known = g.isNotNull()
    per_word = F.when(F.col("sw") > 0, c / F.when(F.col("sw") > 0, F.col("sw")))
    doc_side = words.groupBy("doc").agg(
        F.first("nd").alias("nd"),
        F.first("ud").alias("ud"),
        F.first("bd").alias("bd"),
        F.sum(F.when(known, c * F.ln(g))).alias("da"),
        F.sum(F.when(known, c)).alias("dn"),
        F.sum(F.when(known, F.col("p") * _safe_ln(F.col("p")))).alias("dplp"),
        F.sum(F.when(known, F.col("p") * F.ln(g))).alias("dplg"),
        F.sum(F.when(known, F.col("p"))).alias("dp"),
        F.sum(F.pow(c / nd, 2.0)).alias("dn2"),
        F.sum(F.when(known, F.col("p") * g)).alias("dpg"),
        F.sum(F.when(known, g * g)).alias("dgg"),
        F.sum(F.when(known, g)).alias("dg"),
        F.sum(F.when(known, g * _safe_ln(F.col("p0")))).alias("dglp"),
        F.sum(F.when(known, g * F.ln(g))).alias("dglg"),
        F.sum(F.pow("p", 2.0)).alias("dpp"),
        F.sum(per_word * g).alias("dacp"),
        F.sum(F.when(F.col("sw") > 0, c)).alias("dacn"),
    )
    doc_side = doc_side.fillna(0.0, [x for x in doc_side.columns if x != "doc"])

    # what both hold
    low = F.when(rk > 0, F.ln(F.when(rk > 0, rk * g).otherwise(1.0))).otherwise(0.0)
    gain = log_or_zero(F.col("q")) - low
    both = words.join(held.drop("g"), "gram")
    ln_p, ln_q0 = F.coalesce(_safe_ln(F.col("p")), F.lit(0.0)), F.coalesce(_safe_ln(F.col("q0")), F.lit(0.0))
    ln_q = F.coalesce(_safe_ln(F.col("q")), F.lit(0.0))
    ln_p0 = F.coalesce(_safe_ln(F.col("p0")), F.lit(0.0))
    both = both.groupBy("doc", "cell").agg(
        F.sum(c * gain).alias("z_nb"),
        F.sum(F.col("p") * gain).alias("z_kl"),
        F.sum(g * F.ln(g)).alias("b1"),
        F.sum("g").alias("b0"),
        F.sum(g * ln_q0).alias("b2"),
        F.sum(c / nd * F.col("ck") / nk).alias("dot"),
        F.sum(F.pow(F.col("ck") / nk, 2.0)).alias("qq"),
        F.sum(F.col("p") * (F.col("q") - rk * g)).alias("z_dot"),
        F.sum(F.pow("q", 2.0) - F.pow(rk * g, 2.0)).alias("z_qq"),
        F.sum(g * F.col("q")).alias("bgq"),
        F.sum(g * g).alias("bgg"),
        F.sum(F.pow("q", 2.0)).alias("bqq"),
        F.sum(c * F.col("ck") / nk).alias("freq"),
        F.sum(per_word * (F.col("q") - rk * g)).alias("z_acp"),
        # the other direction: sums over the words of the cell
        F.sum(F.col("q") * (ln_q - ln_p)).alias("r_both"),
        F.sum(F.when(rk > 0, rk * g * (F.ln(rk * g) - ln_p0)).otherwise(0.0)).alias("r_low"),
        F.sum(F.col("q") * (ln_q - F.ln(g))).alias("r_qg"),
        F.sum("q").alias("r_q"),
    )
    sums = [x for x in both.columns if x not in ("doc", "cell")]
    pairs = doc_side.crossJoin(if_few(cell_side, cells)).join(both, ["doc", "cell"], "left").fillna(0.0, sums)

    v = {x: F.col(x) for x in pairs.columns}
    ln_rest = F.when(rk > 0, F.ln(F.when(rk > 0, rk).otherwise(1.0))).otherwise(0.0)
    has_rest = F.when(rk > 0, 1.0).otherwise(0.0)
    words_ln = has_rest * (v["da"] + v["dn"] * ln_rest) + v["z_nb"]
    kl = v["dplp"] - has_rest * (v["dplg"] + v["dp"] * ln_rest) - v["z_kl"]
    r = F.when(v["bd"] > 0, v["ud"] / F.when(v["bd"] > 0, v["bd"]).otherwise(1.0)).otherwise(0.0)
    ln_r = F.when(r > 0, F.ln(F.when(r > 0, r).otherwise(1.0))).otherwise(0.0)
    cell_only = r * ((v["kg1"] - v["b1"]) + ln_r * (v["kg0"] - v["b0"]) - (v["kg2"] - v["b2"]))
    remainder = r * (ln_r - ln_rest) * (v["bd"] - (v["kg0"] - v["b0"]))
    full_kl = kl + cell_only + remainder
    # the cell's words against the document's model: where the document lacks a word it gives r * g
    back = v["r_both"] + (v["kqlq"] - v["kqlg"] - v["r_qg"]) - ln_r * (v["kq"] - v["r_q"])
    doc_only = rk * (v["dglg"] + ln_rest * v["dg"] - v["dglp"]) - v["r_low"]
    back_rest = rk * (ln_rest - ln_r) * (F.col("bk") - (v["dg"] - v["b0"]))
    norm = F.sqrt(v["dn2"])

    def cosine(dot: Column, a2: Column, b2: Column) -> Column:
        size = F.sqrt(a2 * b2)
        return F.when((dot > 0) & (size > 0), dot / F.when(size > 0, size).otherwise(1.0)).otherwise(0.0)

    sm_dot, sm_qq = rk * v["dpg"] + v["z_dot"], rk * rk * v["dgg"] + v["z_qq"]
    out = {
        "naive-bayes": (1 - prior_weight) * words_ln + prior_weight * F.ln(v["prior"]),
        "partial-kl-divergence": -kl,
        "full-kl-divergence": -full_kl,
        "symmetric-partial-kl-divergence": -(kl + back) / 2,
        "symmetric-full-kl-divergence": -(full_kl + back + doc_only + back_rest) / 2,
        "partial-cosine-similarity": cosine(v["dot"], norm * norm, v["qq"]),
        "full-cosine-similarity": cosine(v["dot"], norm * norm, v["kn2"]),
        "smoothed-partial-cosine-similarity": cosine(sm_dot, v["dpp"], sm_qq),
        "smoothed-full-cosine-similarity": cosine(
            sm_dot + r * (v["kgq"] - v["bgq"]), v["dpp"] + r * r * (v["kgg"] - v["bgg"]), sm_qq + v["kqq"] - v["bqq"]
        ),
        "sum-frequency": v["freq"],
        "average-cell-probability": F.when(
            v["dacn"] > 0, (rk * v["dacp"] + v["z_acp"]) / F.when(v["dacn"] > 0, v["dacn"]).otherwise(1.0)
        ).otherwise(0.0),
    }
    return pairs.select("doc", "cell", *[out[n].alias(n.replace("-", "_")) for n in rankers])


def ranked(scored: DataFrame, score: str, keys: Sequence[str] = ("doc",), cell: str = "cell", digits: int | None = 6) -> DataFrame:
    """Adds `rank` from 1, best first.  Scores are compared to `digits` digits, ties by the cell."""
    by = F.round(score, digits) if digits is not None else F.col(score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), cell)))


def top(scored: DataFrame, score: str, k: int, keys: Sequence[str] = ("doc",), cell: str = "cell") -> DataFrame:
    """The k best cells of each document."""
    return ranked(scored, score, keys, cell).filter(F.col("rank") <= k)


def restricted(scored: DataFrame, inside: Column) -> DataFrame:
    """Drop cells outside the allowed boxes after scoring."""
    return scored.filter(inside)


def popularity(docs: DataFrame, cells: DataFrame, by: str = "n_docs") -> DataFrame:
    """Baseline: every document gets the cells' number of documents, or salience, as score."""
    return docs.select("doc").crossJoin(if_few(cells.select("cell", F.col(by).cast("double").alias("score")), cells))


def shuffled(docs: DataFrame, cells: DataFrame, seed: int = 0) -> DataFrame:
    """Baseline: a random order of the cells, seeded by document and cell; all scores are 0."""
    pairs = docs.select("doc").crossJoin(if_few(cells.select("cell"), cells))
    order = Window.partitionBy("doc").orderBy(F.xxhash64(F.lit(seed), "doc", "cell"), "cell")
    return pairs.withColumns({"score": F.lit(0.0), "rank": F.row_number().over(order)})


def cell_distribution(cell_grams: DataFrame, sums: DataFrame, global_stats: DataFrame, smoothing: Smoothing) -> DataFrame:
    """(gram, cell, prob): for each gram the cells that hold it, by their share of its probability."""
    joined = cell_grams.join(if_few(sums, sums), "cell").join(global_stats.select("gram", "g"), "gram")
    p = probability(F.col("cnt"), F.col("total"), F.col("u"), F.col("g"), F.col("big_u"), smoothing.interpolate)
    joined = joined.select("gram", "cell", p.alias("p"))
    whole = F.sum("p").over(Window.partitionBy("gram"))
    return joined.select("gram", "cell", F.when(whole > 0, F.col("p") / whole).otherwise(F.col("p")).alias("prob"))


def interpolated(front: DataFrame, back: DataFrame, factor: float, parent: tuple[Column, Column]) -> DataFrame:
    """front * (1 - f) + back * f, each front cell taking the score of the back cell (row, col) that holds it."""
    row, col = parent
    aligned = front.withColumns({"_r": row, "_c": col})
    other = back.select(F.col("doc").alias("_d"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("score").alias("_s"))
    joined = aligned.join(other, (aligned.doc == other["_d"]) & (aligned["_r"] == other["_r"]) & (aligned["_c"] == other["_c"]), "left")
    mixed = F.col("score") * (1 - factor) + F.coalesce("_s", F.lit(0.0)) * factor
    return joined.select(*[aligned[c] for c in front.columns if c != "score"], mixed.alias("score"))


def beam_search(levels: Sequence[DataFrame], beam: int = 10) -> DataFrame:
    """Hierarchical ranking: level 0 has (doc, cell, score), the others also `parent`.

    At each level the children of the `beam` best cells are scored by their
    parent's score plus their own, and only the best child of each parent stays.
    """
    at = top(levels[0].select("doc", "cell", "score"), "score", beam)
    for level in levels[1:]:
        kept = at.select("doc", F.col("cell").alias("parent"), F.col("score").alias("_up"))
        children = level.join(kept, ["doc", "parent"]).withColumn("score", F.col("score") + F.col("_up"))
        best = top(children, "score", 1, ["doc", "parent"]).drop("rank")
        at = top(best.select("doc", "cell", "score"), "score", beam)
    return at


def nearest_cell(cells: DataFrame, points: DataFrame, distance: Column) -> DataFrame:
    """Of the cells that several grids give for a point (joined on `point`), the one with the nearest centre."""
    joined = points.join(cells, "point").withColumn("_d", distance)
    return joined.groupBy("point").agg(F.min_by(F.struct("grid", "cell"), F.struct("_d", "grid", "cell")).alias("b")).select("point", "b.*")


def mean_shift(points: DataFrame, window: float = 1.0, tolerance: float = 1e-10, rounds: int = 100) -> DataFrame:
    """(doc, lat, lon): mode of each document's k best points (doc, lat, lon) by Gaussian mean shift.

    The kernel is exp(-d^2 / h^2) of great-circle kilometres; it ends when the
    root mean square distance from the points to their mean is below
    `tolerance`.  A group is the k points of one document, so it is bounded by k.
    """
    import numpy as np

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = np.radians(a), np.radians(b)
        cos = np.sin(x[:, :1]) * np.sin(y[:, 0]) + np.cos(x[:, :1]) * np.cos(y[:, 0]) * np.cos(x[:, 1:] - y[:, 1])
        return 6376.774 * np.arccos(np.clip(cos, -1, 1))

    def shift(rows: pd.DataFrame) -> pd.DataFrame:
        fixed = rows[["lat", "lon"]].to_numpy(float)
        at = fixed.copy()
        for _ in range(rounds):
            w = np.exp(-((distances(at, fixed) / window) ** 2))
            at = w @ fixed / w.sum(axis=1, keepdims=True)
            if np.sqrt((distances(at.mean(axis=0, keepdims=True), at) ** 2).mean()) < tolerance:
                break
        lat, lon = at.mean(axis=0)
        return pd.DataFrame({"doc": [rows["doc"].iloc[0]], "lat": [lat], "lon": [lon]})

    kind = points.schema["doc"].dataType.simpleString()
    return points.select("doc", "lat", "lon").groupBy("doc").applyInPandas(shift, f"doc {kind}, lat double, lon double")


def rerank(initial: DataFrame, rescored: DataFrame, n: int = 10) -> DataFrame:
    """New order of the n best cells; the others follow in their old order.

    initial: (doc, cell, score, rank); rescored: (doc, cell, new_score) of the n
    best.  Scores of the others are moved to lie below the least new score.
    """
    least = rescored.groupBy("doc").agg(F.min("new_score").alias("_least"))
    best_other = F.max(F.when(F.col("rank") > n, F.col("score"))).over(Window.partitionBy("doc"))
    joined = initial.join(rescored, ["doc", "cell"], "left").join(least, "doc", "left").withColumn("_other", best_other)
    moved = F.col("_least") - 1 - (F.col("_other") - F.col("score"))
    joined = joined.withColumn("score", F.when(F.col("rank") <= n, F.coalesce("new_score", "score")).otherwise(F.coalesce(moved, "score")))
    return ranked(joined.select("doc", "cell", "score"), "score", digits=None)


def toponym_candidates(titles: DataFrame, short: Column) -> DataFrame:
    """(name, id, salience): lower-cased title and its short form, each naming its document."""
    forms = F.array_distinct(F.array(F.lower("title"), F.lower(short)))
    return titles.select("id", "salience", F.explode(forms).alias("name"))


def common_toponym(test_tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, name, id, rank): candidates, by salience, of each document's most frequent capitalized toponym.

    test_tokens: (doc, token, cnt).  Of equally frequent names the least counts.
    """
    names = candidates.select("name").distinct()
    seen = test_tokens.filter(F.col("token").rlike("^[A-Z]")).withColumn("name", F.lower("token"))
    seen = seen.groupBy("doc", "name").agg(F.sum("cnt").alias("n")).join(names, "name", "left_semi")
    best = seen.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b")).select("doc", "b.name")
    found = best.join(candidates, "name")
    order = Window.partitionBy("doc").orderBy(F.col("salience").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).select("doc", "name", "id", "rank")


def unique_merge(lists: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Ranked lists one after the other; of a key that occurs twice in a document the first stays."""
    parts = [x.select("doc", key, F.struct(F.lit(i).alias("l"), F.col(order).alias("o")).alias("_o")) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    first = both.groupBy("doc", key).agg(F.min("_o").alias("_o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("_o", key))).drop("_o")


def rescaled(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Scores less the greatest score of their document, which becomes 0."""
    most = candidates.groupBy("doc").agg(F.max(score).alias("_most"))
    return candidates.join(most, "doc").withColumn(score, F.col(score) - F.col("_most")).drop("_most")


def randomly_reranked(ranked: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(doc, cell, rank): the first `most` cells of each document in an order of a hash, the others where they were.

    The order depends on seed, document and cell alone, not on partitions.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"), "cell"))
    top = ranked.filter(F.col("rank") <= most)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(shuffled, "cell")))
    return top.select("doc", "cell", "rank").union(ranked.filter(F.col("rank") > most).select("doc", "cell", "rank"))


def oracle_ranked(ranked: DataFrame, truth: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, cell, score, rank): the correct cell alone with score 0, where it is a cell; the ranked cells of other documents."""
    known = truth.select("doc", F.col("correct_cell").alias("cell")).join(cells.select("cell"), "cell")
    right = known.select("doc", "cell", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return right.union(ranked.join(known, "doc", "left_anti").select("doc", "cell", "score", "rank"))
