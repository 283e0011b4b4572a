"""Registered queries of the engine's own operators, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wiki
from ..functions.geo import in_box
from ..functions.text import encode_pairs, short_text_tokens, tag_ngrams, words
from ..operators import evaluation, filters, grids, grouping, learning, models, ranking, rows, wordstats
from ..operators.grids import RegularGrid
from ..operators.models import Smoothing
from ..sources import sinks, textdb
from ..streaming import events as streams
from . import sql
from .geolocate import Corpus, geolocate, item_grams, items, score_items
from .shared import cell_name, cell_sql, millis, placed, placed_sql, scratch, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- counts and cells -------------------------------------------------------------------


@query(f"SELECT gram, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS df FROM ({sql.grams('documents', 'doc_id')}) GROUP BY gram")
def word_counts(spark, sf_dir):
    """Occurrences and document frequency of every word of `documents`."""
    grams = models.document_counts(table(spark, sf_dir, "documents"), "doc_id", "text", words).select("doc_id", F.inline("pairs"))
    return models.global_counts(grams).select("gram", F.col("cnt").cast("long").alias("cnt"), "df")


@query(f"""
SELECT doc_id, string_agg(concat(gram, ':', CAST(cnt AS BIGINT)), ' ' ORDER BY cnt DESC, gram) AS counts
FROM ({sql.grams('documents', 'doc_id')}) GROUP BY doc_id""")
def count_strings(spark, sf_dir):
    """Counts of each document in the table format, greatest first."""
    counted = models.document_counts(table(spark, sf_dir, "documents"), "doc_id", "text", words)
    pairs = F.transform("pairs", lambda p: F.struct(p["gram"].alias("gram"), p["cnt"].cast("int").alias("cnt")))
    return counted.select("doc_id", encode_pairs(pairs).alias("counts"))


@query(f"""
WITH dp AS (SELECT *, {placed_sql("doc_id")} FROM documents), d AS (SELECT *, {cell_sql(10)} FROM dp),
a AS (SELECT "row", col, count(*) AS n_docs, avg(lat) AS clat, avg(lon) AS clon, sum(n_chars) AS salience, max(n_chars) AS top_salience FROM d GROUP BY ALL),
m AS (SELECT d."row", d.col, min(doc_id) AS top_id FROM d JOIN a ON d."row" = a."row" AND d.col = a.col AND d.n_chars = a.top_salience GROUP BY ALL)
SELECT a."row", a.col, n_docs, {r6_sql("clat", "clon")}, CAST(salience AS BIGINT) AS salience, top_id, top_salience FROM a JOIN m ON a."row" = m."row" AND a.col = m.col""")
def regular_cells(spark, sf_dir):
    """Cells of 10 degrees with their documents, centroid and salience."""
    docs = grids.with_cells(placed(table(spark, sf_dir, "documents"), "doc_id"), RegularGrid(10.0))
    found = grids.accumulate(docs, ["row", "col"], "doc_id", "n_chars")
    return found.select("row", "col", "n_docs", *r6("clat", "clon"), "salience", "top_id", "top_salience")


@query(f"""
WITH dp AS (SELECT *, {placed_sql("doc_id")} FROM documents), d AS (SELECT *, {cell_sql(10)} FROM dp),
s AS (SELECT unnest(range(3)) AS i), t AS (SELECT unnest(range(3)) AS j),
m AS (SELECT DISTINCT doc_id, lat, lon, greatest("row" - i, -9) AS "row", (col - j + 18 + 36) % 36 - 18 AS col FROM d, s, t)
SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, count(*) AS n_docs, {r6_sql("clat", "clon")} FROM (
  SELECT "row", col, lat, lon, avg(lat) OVER w AS clat, avg(lon) OVER w AS clon FROM m WINDOW w AS (PARTITION BY "row", col)) GROUP BY "row", col, clat, clon""")
def overlapping_cells(spark, sf_dir):
    """Cells of 3 x 3 tiles of 10 degrees: each document counts in all that hold it."""
    docs = grids.with_cells(placed(table(spark, sf_dir, "documents"), "doc_id"), RegularGrid(10.0, 3))
    return grids.accumulate(docs, ["row", "col"], "doc_id").select("row", "col", "n_docs", *r6("clat", "clon"))


@query(sql.kd_leaves("customer", "c_custkey", 200, 400))
def kd_cells(spark, sf_dir):
    """Leaves of a K-d tree over all customers, split at the median, and of its cut at 400 points."""
    points = placed(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    assigned, nodes = grids.kd_assign(points, bucket=200, method="median")
    assigned = written(assigned, "kd-leaves")
    coarse = written(grids.kd_coarse(nodes, assigned, 400), "kd-coarse")
    return assigned.join(coarse, "leaf").select("c_custkey", "leaf", "coarse")


@query()
def balanced_sample(spark, sf_dir):
    """At most 5 documents of each cell by a seeded hash (a sampling operator)."""
    docs = placed(table(spark, sf_dir, "documents"), "doc_id").withColumn("cell", cell_name(RegularGrid(30.0)))
    return grids.balanced(docs.select("doc_id", "cell"), ["cell"], 5)


@query(f"""
WITH {sql.docs(30)},
a AS (SELECT cell, count(*) / (SELECT count(*) FROM d)::DOUBLE AS d1 FROM d GROUP BY cell),
cp AS (SELECT *, {placed_sql("c_custkey")} FROM customer), cr AS (SELECT *, {cell_sql(30)} FROM cp),
b AS (SELECT concat("row", ',', col) AS cell, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS d2 FROM cr GROUP BY 1)
SELECT cell, round(coalesce(d1, 0), 6) AS d1, round(coalesce(d2, 0), 6) AS d2,
  round(CASE WHEN coalesce(d2, 0) = 0 THEN 0 ELSE d2 / (coalesce(d1, 0) + d2) END, 6) AS ratio FROM a FULL JOIN b USING (cell)""")
def grid_comparison(spark, sf_dir):
    """Shares of documents and customers in each cell, and their ratio."""
    grid = RegularGrid(30.0)
    sides = [
        placed(table(spark, sf_dir, t), k).groupBy(cell_name(grid).alias("cell")).agg(F.count(F.lit(1)).alias("n_docs"))
        for t, k in (("documents", "doc_id"), ("customer", "c_custkey"))
    ]
    return evaluation.compare_grids(*sides, keys=["cell"]).select("cell", *r6("d1", "d2", "ratio"))


# --- language models --------------------------------------------------------------------


def _smoothing_sql(u: str, interpolate: bool) -> str:
    p = "c / n * (1 - u) + u * g" if interpolate else "c / n * (1 - u)"
    return f"""
WITH lg AS ({sql.grams('documents', 'lang')}),
gg AS (SELECT gram, sum(cnt) / (SELECT sum(cnt) FROM lg) AS g FROM lg GROUP BY gram),
s AS (SELECT lang, sum(cnt) AS n, CAST(count(*) FILTER (cnt = 1) AS DOUBLE) AS once FROM lg GROUP BY lang),
x AS (SELECT lang, gram, cnt AS c, n, {u} AS u, g FROM lg JOIN s USING (lang) JOIN gg USING (gram))
SELECT lang, gram, c AS cnt, round(c / n, 9) AS mle, round({p}, 9) AS p FROM x"""


def _by_language(spark: SparkSession, sf_dir: str, smoothing: Smoothing) -> DataFrame:
    grams = written(models.gram_counts(table(spark, sf_dir, "documents"), ["lang"], words(F.col("text"))), "language-grams")
    found = models.smoothed(grams, ["lang"], models.global_probs(grams, "lang"), smoothing)
    return found.select("lang", "gram", "cnt", F.round("mle", 9).alias("mle"), F.round("p", 9).alias("p"))


@query(_smoothing_sql("1 - n / (n + 1000)", True))
def dirichlet_models(spark, sf_dir):
    """Dirichlet-smoothed model of each language."""
    return _by_language(spark, sf_dir, Smoothing.parse("dirichlet:1000"))


@query(_smoothing_sql("0.3", True))
def jelinek_models(spark, sf_dir):
    return _by_language(spark, sf_dir, Smoothing.parse("jelinek-mercer"))


@query(_smoothing_sql("least(0.5, greatest(1, once) / n)", False))
def good_turing_models(spark, sf_dir):
    """Back-off models with the mass of words seen once."""
    return _by_language(spark, sf_dir, Smoothing.parse("pseudo-good-turing"))


@query(f"""
WITH dg AS ({sql.grams('documents', 'doc_id')}),
gs AS (SELECT gram, count(*) AS df FROM dg GROUP BY gram),
w AS (SELECT doc_id, gram, cnt * CASE WHEN ln((SELECT count(*) FROM documents) / (df + 1.0)) > 0 THEN ln((SELECT count(*) FROM documents) / (df + 1.0)) ELSE 0.0001 END AS x
  FROM dg JOIN gs USING (gram))
SELECT doc_id, round(sqrt(sum(x * x)), 6) AS norm, round(max(x), 6) AS most, count(*) AS n_types FROM w GROUP BY doc_id""")
def tfidf_norms(spark, sf_dir):
    """tf-idf weights of all documents: norm, greatest weight and types of each."""
    docs = table(spark, sf_dir, "documents")
    grams = models.document_counts(docs, "doc_id", "text", words).select("doc_id", F.inline("pairs"))
    stats = written(models.global_counts(grams).select("gram", "df"), "words")
    scaled = models.scaled_by_df(models.join_by_gram(grams, stats), docs.count())
    x = F.col("cnt")
    return scaled.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(x * x)), 6).alias("norm"), F.round(F.max(x), 6).alias("most"), F.count(F.lit(1)).alias("n_types"))


@query(f"""
WITH lg AS ({sql.grams('documents', 'source')}),
p AS (SELECT source, CASE WHEN cnt >= 3 THEN gram ELSE '-OOV-' END AS gram, cnt FROM lg)
SELECT source, gram, sum(cnt) AS cnt FROM p GROUP BY ALL""")
def pruned_models(spark, sf_dir):
    """Words below 3 occurrences in a source become one unknown word."""
    grams = models.gram_counts(table(spark, sf_dir, "documents"), ["source"], words(F.col("text")))
    return models.prune(grams, ["source"], 3)


# --- ranking ----------------------------------------------------------------------------

_SCORES = f"""
WITH {sql.corpus(30, 1000)},
sw AS (SELECT gram, sum(coalesce(ck, 0) * (1 - uk) / nk + uk * g) AS sw FROM (SELECT DISTINCT t.gram, g FROM t JOIN gg USING (gram)) CROSS JOIN ct LEFT JOIN cg USING (cell, gram) GROUP BY gram),
x AS (
  SELECT t.doc, ct.cell, t.gram, t.cnt AS c, cg.ck FROM t CROSS JOIN ct LEFT JOIN cg ON cg.cell = ct.cell AND cg.gram = t.gram
  UNION ALL
  SELECT td.doc, cg.cell, cg.gram, NULL, cg.ck FROM td CROSS JOIN cg WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = td.doc AND t.gram = cg.gram)),
y AS (
  SELECT x.doc, x.cell, c, ck, g, nd, ud, nk, uk, sw.sw,
    coalesce(c, 0) * (1 - ud) / nd + ud * coalesce(g, 0) AS p, coalesce(c, 0) * (1 - ud) / nd AS p0,
    CASE WHEN g IS NULL THEN 0 ELSE coalesce(ck, 0) * (1 - uk) / nk + uk * g END AS q, coalesce(ck, 0) * (1 - uk) / nk AS q0
  FROM x LEFT JOIN gg USING (gram) LEFT JOIN sw USING (gram) JOIN td ON td.doc = x.doc JOIN ct ON ct.cell = x.cell),
z AS (
  SELECT doc, cell, any_value(ud) AS ud, any_value(uk) AS uk,
    coalesce(sum(c * ln(q)) FILTER (c IS NOT NULL AND q > 0), 0) AS nb,
    coalesce(sum(p * ln(p / q)) FILTER (c IS NOT NULL AND q > 0), 0) AS kl,
    coalesce(sum(g * ud * ln(g * ud / q0)) FILTER (c IS NULL), 0) AS kl_cell, coalesce(sum(g) FILTER (c IS NULL), 0) AS g_cell,
    coalesce(sum(q * ln(q / p)) FILTER (ck IS NOT NULL), 0) AS back,
    coalesce(sum(uk * g * ln(uk * g / p0)) FILTER (ck IS NULL AND g IS NOT NULL), 0) AS back_doc, coalesce(sum(g) FILTER (ck IS NULL), 0) AS g_doc,
    coalesce(sum(c / nd * ck / nk), 0) AS dot, sum(pow(c / nd, 2)) AS dn2,
    coalesce(sum(pow(ck / nk, 2)) FILTER (c IS NOT NULL), 0) AS kq2, coalesce(sum(pow(ck / nk, 2)), 0) AS kn2,
    coalesce(sum(p * q) FILTER (c IS NOT NULL), 0) AS sdot, sum(p * p) FILTER (c IS NOT NULL) AS spp, coalesce(sum(q * q) FILTER (c IS NOT NULL), 0) AS sqq,
    coalesce(sum(ud * g * q) FILTER (c IS NULL), 0) AS cdot, coalesce(sum(pow(ud * g, 2)) FILTER (c IS NULL), 0) AS cpp, coalesce(sum(q * q) FILTER (c IS NULL), 0) AS cqq,
    coalesce(sum(c * ck / nk), 0) AS freq, coalesce(sum(c * q / sw) FILTER (sw > 0), 0) AS acp, coalesce(sum(c) FILTER (sw > 0), 0) AS acn
  FROM y GROUP BY doc, cell)
SELECT doc, cell, round(0.5 * nb + 0.5 * ln(1.0 / (SELECT count(*) FROM ct)), 6) AS naive_bayes,
  round(-kl, 6) AS partial_kl_divergence,
  round(-(kl + kl_cell + ud * (ln(ud) - ln(uk)) * (1 - g_cell)), 6) AS full_kl_divergence,
  round(-(kl + back) / 2, 6) AS symmetric_partial_kl_divergence,
  round(-(kl + kl_cell + ud * (ln(ud) - ln(uk)) * (1 - g_cell) + back + back_doc + uk * (ln(uk) - ln(ud)) * (1 - g_doc)) / 2, 6) AS symmetric_full_kl_divergence,
  round(CASE WHEN dot > 0 THEN dot / sqrt(dn2 * kq2) ELSE 0 END, 6) AS partial_cosine_similarity,
  round(CASE WHEN dot > 0 THEN dot / sqrt(dn2 * kn2) ELSE 0 END, 6) AS full_cosine_similarity,
  round(CASE WHEN sdot > 0 THEN sdot / sqrt(spp * sqq) ELSE 0 END, 6) AS smoothed_partial_cosine_similarity,
  round(CASE WHEN sdot + cdot > 0 THEN (sdot + cdot) / sqrt((spp + cpp) * (sqq + cqq)) ELSE 0 END, 6) AS smoothed_full_cosine_similarity,
  round(freq, 6) AS sum_frequency, round(CASE WHEN acn > 0 THEN acp / acn ELSE 0 END, 6) AS average_cell_probability
FROM z"""


@query(_SCORES)
def cell_scores(spark, sf_dir):
    """All eleven scores of every cell for every benchmark item; the SQL visits every word of both sides."""
    _, scored, _ = score_items(spark, sf_dir, ranking.RANKERS)
    names = [n.replace("-", "_") for n in ranking.RANKERS]
    return scored.select("doc", "cell", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query(f"WITH {sql.NAIVE_BAYES} SELECT doc, pred_cell, correct_cell, correct_rank, round(error_km, 4) AS error_km, round(oracle_km, 4) AS oracle_km FROM res")
def geolocated_items(spark, sf_dir):
    """Flagship: naive Bayes over Dirichlet cell models, with ranks and error distances."""
    *_, found = geolocate(spark, sf_dir)
    return found.select("doc", "pred_cell", "correct_cell", F.col("correct_rank").cast("long").alias("correct_rank"), *[F.round(c, 4).alias(c) for c in ("error_km", "oracle_km")])


@query(f"""WITH {sql.NAIVE_BAYES} SELECT count(*) AS n_eval, round(avg((correct_rank = 1)::INT), 6) AS accuracy, round(avg((error_km <= 161)::INT), 6) AS acc_161,
  round(avg(error_km), 4) AS mean_km, round(quantile_cont(error_km, 0.5), 4) AS median_km, round((avg(error_km) + quantile_cont(error_km, 0.5)) / 2, 4) AS average_km FROM res""")
def evaluation_summary(spark, sf_dir):
    *_, found = geolocate(spark, sf_dir)
    return evaluation.summary(found).select("n_eval", *r6("accuracy", "acc_161"), *[F.round(c, 4).alias(c) for c in ("mean_km", "median_km", "average_km")])


@query(f"""WITH {sql.NAIVE_BAYES}, ns AS (SELECT unnest([1,2,3,4,5,6,7,8,9,10,20,30,40,50,60,70,80,90,100]) AS n)
SELECT CAST(n AS INT) AS n, CAST(sum((correct_rank <= n)::INT) AS BIGINT) AS hits, round(avg((correct_rank <= n)::INT), 6) AS accuracy,
  round(avg(CASE WHEN correct_rank <= 100 THEN 101 - correct_rank ELSE 0 END), 6) AS credit FROM ns, res GROUP BY n""")
def accuracy_at_rank(spark, sf_dir):
    *_, found = geolocate(spark, sf_dir)
    return evaluation.accuracy_at(found).select("n", "hits", *r6("accuracy", "credit"))


@query(f"""WITH {sql.NAIVE_BAYES}, k AS (
  SELECT r.doc, r.rank, {sql.km("i.lat", "i.lon", "c.clat", "c.clon")} AS km FROM ranked r JOIN items i ON i.doc = r.doc JOIN cells c ON c.cell = r.cell)
SELECT doc, rank, round(km, 4) AS km, round(min(km) OVER (PARTITION BY doc ORDER BY rank), 4) AS best_km FROM k""")
def oracle_distance_by_rank(spark, sf_dir):
    corpus, ranked, truth, _ = geolocate(spark, sf_dir)
    found = evaluation.oracle_in_top(ranked, truth, corpus.cells)
    return found.select("doc", F.col("rank").cast("long").alias("rank"), F.round("km", 4).alias("km"), F.round("best_km", 4).alias("best_km"))


@query(f"""WITH {sql.NAIVE_BAYES}, c AS (SELECT pred_cell AS cell, count(*) AS n FROM res GROUP BY 1)
SELECT cell, n, row_number() OVER w AS rank, round(100.0 * sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative_percent FROM c WINDOW w AS (ORDER BY n DESC, cell)""")
def predicted_cell_frequencies(spark, sf_dir):
    *_, found = geolocate(spark, sf_dir)
    out = evaluation.zipf(found.select(F.col("pred_cell").alias("cell")))
    return out.select("cell", "n", F.col("rank").cast("long").alias("rank"), *r6("cumulative_percent"))


@query(f"""WITH {sql.corpus(30, 1000)}, p AS (SELECT gram, cell, ck * (1 - uk) / nk + uk * g AS p FROM cg JOIN ct USING (cell) JOIN gg USING (gram))
SELECT gram, cell, round(p / sum(p) OVER (PARTITION BY gram), 6) AS prob FROM p""")
def word_cell_distribution(spark, sf_dir):
    """For each word the cells that hold it, by probability: the table behind its map."""
    corpus = Corpus(placed(table(spark, sf_dir, "documents"), "doc_id"))
    smoothing = Smoothing("dirichlet", 1000.0)
    sums = models.totals(corpus.cell_grams, ["cell"], smoothing)
    return ranking.cell_distribution(corpus.cell_grams, sums, corpus.global_stats(), smoothing).select("gram", "cell", *r6("prob"))


@query()
def mean_shift_coordinates(spark, sf_dir):
    """Place of each item by mean shift over the centroids of its ten best cells."""
    corpus, ranked, _, _ = geolocate(spark, sf_dir)
    points = ranked.filter("rank <= 10").join(corpus.cells, "cell").select("doc", F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    return ranking.mean_shift(points, window=2000.0)


@query(f"""WITH coarse AS (WITH {sql.NAIVE_BAYES} SELECT doc, cell, score FROM scored), fine AS (WITH {sql.naive_bayes(15)} SELECT doc, cell, score FROM scored),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, cell) AS place FROM coarse),
c AS (SELECT doc, f.cell, b.cell AS parent, f.score + b.score AS score FROM fine f JOIN b USING (doc)
  WHERE b.place <= 10 AND b.cell = concat(CAST(floor(split_part(f.cell, ',', 1)::INT / 2.0) AS INT), ',', CAST(floor(split_part(f.cell, ',', 2)::INT / 2.0) AS INT))),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY round(score, 6) DESC, cell) AS place FROM c),
r AS (SELECT doc, cell, score, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, cell) AS rank FROM k WHERE place = 1)
SELECT doc, cell, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def hierarchical_ranking(spark, sf_dir):
    """Cells of 30, then 15 degrees by beam search."""
    coarse, fine = RegularGrid(30.0), RegularGrid(15.0)
    docs, tests = placed(table(spark, sf_dir, "documents"), "doc_id"), item_grams(items(spark, sf_dir))
    names = {"coarse": cell_name(coarse), "fine": cell_name(fine)}
    both = written(models.gram_counts(docs.withColumns(names), list(names), words(F.col("text"))), "cell-grams")  # words are cut once
    levels = []
    for name, grid in (("coarse", coarse), ("fine", fine)):
        grams = models.merged(both.select(F.col(name).alias("cell"), "gram", "cnt"), ["cell"])
        scored = Corpus(docs, grid=grid, grams=grams).scores(tests, ["naive-bayes"], Smoothing("dirichlet", 1000.0))
        levels.append(scored.select("doc", "cell", F.col("naive_bayes").alias("score")))
    at = F.split("cell", ",")
    up = coarse.parent(at[0].cast("int"), at[1].cast("int"))
    levels[1] = levels[1].withColumn("parent", F.concat_ws(",", *[x.cast("string") for x in up]))
    found = ranking.beam_search([written(x, "level") for x in levels])
    return found.select("doc", "cell", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sql.NAIVE_BAYES},
dn AS (SELECT doc, sum(pow(cnt / nd, 2)) AS dn2 FROM t JOIN td USING (doc) GROUP BY doc), kn2 AS (SELECT cell, sum(pow(ck / nk, 2)) AS kn2 FROM cg JOIN ct USING (cell) GROUP BY cell),
dots AS (SELECT t.doc, cg.cell, sum(t.cnt / nd * ck / nk) AS dot FROM t JOIN cg USING (gram) JOIN td ON td.doc = t.doc JOIN ct ON ct.cell = cg.cell GROUP BY ALL),
w AS (SELECT r.doc, r.cell, r.score, r.rank, coalesce(dot / sqrt(dn2 * kn2), 0) AS cosine FROM ranked r JOIN dn USING (doc) JOIN kn2 ON kn2.cell = r.cell LEFT JOIN dots ON dots.doc = r.doc AND dots.cell = r.cell),
a AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank > 10, CASE WHEN rank <= 10 THEN cosine ELSE score END DESC, cell) AS new_rank FROM w),
m AS (SELECT a.*, a.cell = i.cell AS correct, bool_or(a.cell = i.cell AND rank <= 10) OVER (PARTITION BY a.doc) AS inside, bool_or(a.cell = i.cell) OVER (PARTITION BY a.doc) AS known FROM a JOIN items i ON i.doc = a.doc)
SELECT doc, cell, round(score, 6) AS score, rank, correct, new_rank FROM m WHERE correct OR rank <= CASE WHEN inside OR NOT known THEN 10 ELSE 9 END""")
def rerank_training_set(spark, sf_dir):
    """The ten best cells of each item with the correct one among them, and their new order by cosine."""
    corpus, scored, truth = score_items(spark, sf_dir, ["naive-bayes", "full-cosine-similarity"])
    ranked = written(ranking.ranked(scored.withColumn("score", F.col("naive_bayes")), "score"), "ranked")
    fresh = ranked.filter("rank <= 10").select("doc", "cell", F.col("full_cosine_similarity").alias("new_score"))
    again = ranking.rerank(ranked.select("doc", "cell", "score", "rank"), fresh)
    train = learning.rerank_training(ranked, truth)
    placed_again = again.select("doc", "cell", F.col("rank").cast("long").alias("new_rank"))
    return train.join(placed_again, ["doc", "cell"]).select("doc", "cell", *r6("score"), F.col("rank").cast("long").alias("rank"), "correct", "new_rank")


@query()
def language_classifier(spark, sf_dir):
    """Logistic regression of a conversation turn's role by words, with accuracy per role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("label"), words(F.col("text")).alias("tokens"))
    model = learning.cell_classifier(turns, size=1 << 12, rounds=20)
    names = model.stages[0].labels
    named = F.array(*[F.lit(n) for n in names])[F.col("prediction").cast("int")]
    return learning.accuracy_table(model.transform(turns).withColumn("predicted", named))


# --- events -----------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of messages."""
    e = placed(table(spark, sf_dir, "events"), "event_id")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), millis("ts").alias("ts"),
        F.col("event_type").alias("lang"), F.floor("value").cast("int").alias("followers"), F.lit(1).alias("numtweets"), "lat", "lon",
        F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tokens"),
    )


_EVENTS = f"""e AS (
  SELECT event_id AS id, concat('u', user_id) AS "user", epoch_us(ts) // 1000 AS ts, event_type AS lang, CAST(floor(value) AS INT) AS followers, 1 AS numtweets, {placed_sql("event_id")},
    json_extract_string(props, '$.k') AS k, ts AS stamp FROM events)"""
FILTER = '(click OR (view AND NOT k5)) AND TIME WITHIN "20240105/10d12h" AND LOCATION WITHIN (-45, -120, 60, 150)'


@query(f"""WITH {_EVENTS} SELECT id, "user", ts FROM e WHERE (lang = 'click' OR (lang = 'view' AND k <> '5'))
  AND stamp >= TIMESTAMP '2024-01-05' AND stamp < TIMESTAMP '2024-01-15 12:00:00' AND lat BETWEEN -45 AND 60 AND lon BETWEEN -120 AND 150""")
def filtered_events(spark, sf_dir):
    """The filter language over all events."""
    e = _events(spark, sf_dir)
    return e.filter(filters.parse_filter(FILTER, e)).select("id", "user", "ts")


_MERGED = """ CASE WHEN min(id) = max(id) THEN min(id) ELSE -1 END AS id, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_records,
  CASE WHEN min(lang) = max(lang) THEN min(lang) ELSE '[multiple]' END AS lang, max(followers) AS followers, CAST(sum(numtweets) AS BIGINT) AS numtweets"""


@query(f"""WITH {_EVENTS},
p AS (SELECT "user", ts, arg_max(lat, id) AS lat, arg_max(lon, id) AS lon FROM e GROUP BY "user", ts),
c AS (SELECT "user", avg(lat) AS lat, avg(lon) AS lon FROM p GROUP BY "user"),
g AS (SELECT "user", {_MERGED} FROM e GROUP BY "user")
SELECT g."user" AS key, id, min_ts, max_ts, n_records, lang, followers, numtweets, round(lat, 10) AS lat, round(lon, 10) AS lon FROM g JOIN c USING ("user")""")
def events_by_user(spark, sf_dir):
    """Events of each user merged into one record at the centroid of the user's positions."""
    merged = grouping.merge_events(_events(spark, sf_dir), grouping.group_key("user"))
    # ten digits: means of two-digit numbers lie halfway between six-digit ones too often
    place = [F.round(c, 10).alias(c) for c in ("lat", "lon")]
    return merged.select("key", "id", "min_ts", "max_ts", "n_records", "lang", "followers", "numtweets", *place)


@query(f"""WITH {_EVENTS}, s AS (SELECT *, ts // 21600000 * 21600000 AS key, (lang = 'purchase') AS hit FROM e),
g AS (SELECT key, {_MERGED}, bool_or(hit) AS matches, arg_min("user", (ts, id)) AS "user",
  arg_min(lat, (ts, id)) AS lat, arg_min(lon, (ts, id)) AS lon FROM s GROUP BY key)
SELECT CAST(key AS VARCHAR) AS key, id, "user", min_ts, max_ts, n_records, lang, followers, numtweets, round(lat, 6) AS lat, round(lon, 6) AS lon FROM g WHERE matches""")
def events_by_slice(spark, sf_dir):
    """Six-hour slices that hold a purchase, each merged into one record at its earliest position."""
    e = _events(spark, sf_dir)
    slices = grouping.merge_events(e.withColumn("matches", F.col("lang") == "purchase"), grouping.group_key("time", 21_600_000), "earliest").filter("matches")
    return slices.select("key", "id", "user", "min_ts", "max_ts", "n_records", "lang", "followers", "numtweets", *r6("lat", "lon"))


@query(f"""WITH {_EVENTS}, k AS (SELECT DISTINCT "user" FROM e WHERE lang = 'purchase' AND followers >= 300)
SELECT id, "user", ts FROM e WHERE "user" IN (SELECT "user" FROM k)""")
def groups_with_match(spark, sf_dir):
    """All events of users with a purchase of 300 or more."""
    e = _events(spark, sf_dir)
    test = (F.col("lang") == "purchase") & (F.col("followers") >= 300)
    return filters.whole_groups(e, ["user"], test).select("id", "user", "ts")


@query(f"""WITH {_EVENTS} SELECT "user", lang, min(struct_pack(ts := ts, id := id)).id AS id, min(ts) AS ts FROM e GROUP BY "user", lang""")
def first_events(spark, sf_dir):
    """One event per user and type: the first by time and id."""
    return grouping.first_of(_events(spark, sf_dir), ["user", "lang"], ["ts", "id"]).select("user", "lang", "id", "ts")


_HOUR = "concat(strftime(stamp, '%H'), CASE WHEN hour(stamp) < 12 THEN 'AM' ELSE 'PM' END)"
_DAY = "concat('weekday ', dayofweek(stamp) + 1, strftime(stamp, ' (%a)'))"
_MONTH = "strftime(stamp, 'month %m (%b)')"
_WEEK = "concat('week ', (day(stamp) + dayofweek(date_trunc('month', stamp)) - 1) // 7 + 1)"
_CALENDAR = {
    "year": "strftime(stamp, '%Y')",
    "year/month": "strftime(stamp, '%Y-%m (%b)')",
    "year/month/day": "strftime(stamp, '%Y-%m-%d (%b %-d)')",
    "month": _MONTH,
    "month/week": f"concat({_MONTH}, ', ', {_WEEK})",
    "month/day": "strftime(stamp, '%m-%d (%b %-d)')",
    "weekday": _DAY,
    "hour": _HOUR,
    "weekday/hour": f"concat({_DAY}, ', ', {_HOUR})",
    "hour/weekday": f"concat({_HOUR}, ', ', {_DAY})",
    "weekday/month": f"concat({_DAY}, ', ', {_MONTH})",
    "month/weekday": f"concat({_MONTH}, ', ', {_DAY})",
}
_CALENDAR_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS type, {v} AS value, stamp FROM o" for k, v in _CALENDAR.items())


@query(f"""WITH o AS (SELECT o_orderdate AS stamp FROM orders), v AS ({_CALENDAR_ROWS})
SELECT type, value, count(*) AS n, min(stamp) AS first_at, max(stamp) AS last_at FROM v GROUP BY type, value""")
def calendar_counts(spark, sf_dir):
    """Orders by twelve calendar groupings.  The dates are counted first: each is formatted once, however many rows share it."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    flat = days.select("at", "n", F.explode(grouping.calendar_values(F.col("at"))).alias("v"))
    return flat.groupBy("v.type", "v.value").agg(F.sum("n").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


_PROPERTIES = " UNION ALL ".join(f"SELECT '{c}' AS type, CAST({c} AS VARCHAR) AS value, l_shipdate AS stamp FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"))


@query(f"""WITH v AS (SELECT type, '' AS key2, value, count(*) AS n FROM ({_PROPERTIES}) GROUP BY type, value)
SELECT type, key2, min(value) AS lowest, max(value) AS highest, arg_max(value, (n, value)) AS most_common, max(n) AS most_common_n,
  arg_min(value, (n, value)) AS least_common, min(n) AS least_common_n, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_occurrences, round(sum(n) / count(*), 6) AS avg_occurrences
FROM v GROUP BY type, key2""")
def property_statistics(spark, sf_dir):
    """Two levels of statistics on columns of `lineitem`."""
    values = grouping.property_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], "l_shipdate")
    out = grouping.property_types(values)
    return out.withColumn("avg_occurrences", F.round("avg_occurrences", 6))


@query("SELECT k, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY k")
def order_frequencies(spark, sf_dir):
    return grouping.frequency_of_frequencies(table(spark, sf_dir, "orders"), "o_custkey")


@query("""WITH s AS (SELECT epoch_us(ts) // 1000000 AS s, count(*) AS n FROM events GROUP BY 1),
u AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS upto, (SELECT count(*) FROM events) AS t FROM s), p AS (SELECT CAST(unnest(range(1, 101)) AS INT) AS percent)
SELECT percent, min(s) * 1000 AS "at" FROM p JOIN u ON upto * 100 >= percent * t GROUP BY percent""")
def event_quantile_times(spark, sf_dir):
    """Time by which each percent of the events has come."""
    e = table(spark, sf_dir, "events").select(millis("ts").alias("ts"))
    return grouping.quantile_times(e).select("percent", F.col("at").cast("long").alias("at"))


_PLACE_SQL = ", ".join(
    f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, round(avg({c}), 6) AS avg_{c}, round(var_pop({c}), 4) AS var_{c}, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25_{c}, round(quantile_cont({c}, 0.5), 6) AS q50_{c}, round(quantile_cont({c}, 0.75), 6) AS q75_{c}, "
    f"round(arg_min({c}, (ts, lat, lon)), 6) AS first_{c}, round(arg_max({c}, (ts, lat, lon)), 6) AS last_{c}"
    for c in ("lat", "lon")
)


@query(f"""WITH {_EVENTS} SELECT "user", count(*) AS n, {_PLACE_SQL} FROM e GROUP BY "user" """)
def user_places(spark, sf_dir):
    out = grouping.location_statistics(_events(spark, sf_dir), "user")
    return out.select("user", "n", *[F.round(c, 4 if c.startswith("var") else 6).alias(c) for c in out.columns if c not in ("user", "n")])


@query(f"""WITH {_EVENTS}, c AS (SELECT "user", avg(lat) AS la, avg(lon) AS lo FROM e GROUP BY "user"),
k AS (SELECT "user", {sql.km("lat", "lon", "la", "lo")} AS km FROM e JOIN c USING ("user"))
SELECT "user", count(*) AS n, round(avg(km), 4) AS mean_km, round(var_pop(km), 2) AS var_km, round(max(km), 4) AS max_km FROM k GROUP BY "user" """)
def user_distance_spread(spark, sf_dir):
    out = grouping.distance_spread(_events(spark, sf_dir), "user")
    return out.select("user", "n", F.round("mean_km", 4).alias("mean_km"), F.round("var_km", 2).alias("var_km"), F.round("max_km", 4).alias("max_km"))


@query("""WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT CAST(((r + 1) * 20 - 1) // n AS INT) AS bin, count(*) AS n, min(x) AS low, max(x) AS high, round(avg(x), 4) AS mean FROM r GROUP BY 1""")
def price_bins(spark, sf_dir):
    """Twenty bins of equal size over all orders."""
    out = grouping.equal_bins(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"])
    return out.select("bin", "n", "low", "high", F.round("mean", 4).alias("mean"))


# --- word statistics --------------------------------------------------------------------

_DUNNING = f"""
WITH g AS ({sql.grams('conversations', 'role')}),
w AS (SELECT gram, coalesce(sum(cnt) FILTER (role = 'user'), 0) AS a, coalesce(sum(cnt) FILTER (role = 'assistant'), 0) AS b FROM g GROUP BY gram HAVING a + b > 0),
x AS (SELECT *, (SELECT sum(a) FROM w) AS ta, (SELECT sum(b) FROM w) AS tb FROM w),
y AS (SELECT *, ta - a AS c, tb - b AS d, ta + tb AS t, a / ta AS p, b / tb AS q FROM x),
z AS (SELECT gram, a AS n_user, b AS n_assistant, p, q, q - p AS change,
  2 * (CASE WHEN a > 0 THEN a * ln(a / ((a + c) * (a + b) / t)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / ((b + d) * (a + b) / t)) ELSE 0 END) AS g2,
  2 * (CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + c * ln(c) + d * ln(d) + t * ln(t)
    - (a + b) * ln(a + b) - (c + d) * ln(c + d) - (a + c) * ln(a + c) - (b + d) * ln(b + d)) AS g2_table FROM y)"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    grams = models.gram_counts(talk, ["role"], words(F.col("text"))).withColumnRenamed("role", "side")
    return wordstats.compare_two(grams, sides=("user", "assistant"))


@query(f"{_DUNNING} SELECT gram, n_user, n_assistant, round(p, 9) AS p, round(q, 9) AS q, round(change, 9) AS change, round(g2, 6) AS g2, round(g2_table, 5) AS g2_table FROM z")
def word_comparison(spark, sf_dir):
    """Log-likelihood of each word between the two roles of `conversations`."""
    found = _roles(spark, sf_dir)
    return found.select("gram", "n_user", "n_assistant", *[F.round(c, 9).alias(c) for c in ("p", "q", "change")], F.round("g2", 6).alias("g2"), F.round("g2_table", 5).alias("g2_table"))


_TOP = "SELECT '{0}' AS list, gram, CAST(row_number() OVER (ORDER BY round(g2, 6) DESC, gram) AS INT) AS place, round(g2, 6) AS g2 FROM z WHERE {1} QUALIFY place <= 200"


@query(f"{_DUNNING} {_TOP.format('g2', 'true')} UNION ALL {_TOP.format('increase', 'change > 0')} UNION ALL {_TOP.format('decrease', 'change < 0')}")
def word_comparison_report(spark, sf_dir):
    """The 200 words of the greatest log-likelihood, also among those that rise and fall (a top-k report)."""
    return wordstats.comparison_report(_roles(spark, sf_dir)).select("list", "gram", "place", F.round("g2", 6).alias("g2"))


@query(f"""
WITH s AS (SELECT concat(role, CASE WHEN turn < 2 THEN '_before' ELSE '_after' END) AS side, text FROM conversations),
g AS ({sql.grams('s', 'side')}),
w AS (SELECT gram, {", ".join(f"coalesce(sum(cnt) FILTER (side = '{r}_{t}'), 0) AS n_{r}_{t}" for r in ("user", "assistant") for t in ("before", "after"))} FROM g GROUP BY gram),
p AS (SELECT *, {", ".join(f"n_{r}_{t} / (SELECT sum(n_{r}_{t}) FROM w) AS {r[0]}{t[0]}" for r in ("user", "assistant") for t in ("before", "after"))} FROM w)
SELECT gram, n_user_before, n_user_after, n_assistant_before, n_assistant_after,
  round(CASE WHEN ub > 0 THEN (ua - ub) / ub * 100 END, 6) AS user_percent, round(CASE WHEN ab > 0 THEN (aa - ab) / ab * 100 END, 6) AS assistant_percent,
  CASE WHEN ua > ub AND aa > ab THEN '+both' WHEN ua < ub AND aa < ab THEN '-both' WHEN ua - ub >= aa - ab THEN '+user' ELSE '+assistant' END AS label FROM p""")
def four_way_comparison(spark, sf_dir):
    """Changes of both roles between the first and the later turns."""
    talk = table(spark, sf_dir, "conversations")
    side = F.concat(F.col("role"), F.when(F.col("turn") < 2, "_before").otherwise("_after"))
    grams = models.gram_counts(talk.withColumn("side", side), ["side"], words(F.col("text")))
    out = wordstats.compare_four(grams, camps=("user", "assistant"))
    return out.select(*[c for c in out.columns if not c.endswith("_percent")], *r6("user_percent", "assistant_percent"))


@query(f"""WITH {sql.docs(30)}, dg AS ({sql.grams("d", "cell")}),
k AS (SELECT cell, sum(cnt) AS nk FROM dg GROUP BY cell), w AS (SELECT gram, sum(cnt) AS n, count(*) AS m FROM dg GROUP BY gram), t AS (SELECT sum(nk) AS t FROM k),
hc AS (SELECT -sum(nk / t * ln(nk / t)) AS h FROM k, t),
x AS (SELECT w.gram, n, m, nk, coalesce(cnt, 0) AS c, t FROM w CROSS JOIN k CROSS JOIN t LEFT JOIN dg ON dg.gram = w.gram AND dg.cell = k.cell),
h AS (SELECT gram, n, m, t, -sum(CASE WHEN c > 0 THEN c / n * ln(c / n) ELSE 0 END) AS hw, -sum(CASE WHEN nk - c > 0 THEN (nk - c) / (t - n) * ln((nk - c) / (t - n)) ELSE 0 END) AS hn FROM x GROUP BY gram, n, m, t),
i AS (SELECT gram, n, m, hw, h - n / t * hw - (1 - n / t) * hn AS ig, -(n / t * ln(n / t) + (1 - n / t) * ln(1 - n / t)) AS own FROM h, hc)
SELECT gram, n AS word_count, m AS cell_count, round(hw, 6) + 0 AS entropy, round(ig, 7) AS inf_gain, round(ig / own, 6) AS gain_ratio FROM i""")
def word_information(spark, sf_dir):
    """Entropy, information gain and gain ratio of each word over the cells; the SQL visits every cell for every word."""
    docs = placed(table(spark, sf_dir, "documents"), "doc_id").withColumn("cell", cell_name(RegularGrid(30.0)))
    grams = written(models.gram_counts(docs, ["cell"], words(F.col("text"))), "cell-grams")
    found = wordstats.word_properties(grams)
    return found.select("gram", "word_count", "cell_count", (F.round("entropy", 6) + 0.0).alias("entropy"), F.round("inf_gain", 7).alias("inf_gain"), F.round("gain_ratio", 6).alias("gain_ratio"))


@query(f"""WITH {sql.docs(30)}, dg AS ({sql.grams("d", '"row", col')}), k AS (SELECT "row", col, sum(cnt) AS nk FROM dg GROUP BY ALL),
p AS (SELECT gram, "row", col, cnt / nk AS p FROM dg JOIN k USING ("row", col)), m AS (SELECT gram, avg(p) AS mean, count(*) AS cells FROM p GROUP BY gram HAVING count(*) >= 16),
a AS (SELECT gram, "row", col, p - mean AS d, mean, cells FROM p JOIN m USING (gram)),
n AS (SELECT a.gram, sum(a.d * b.d) AS cross_sum, count(*) AS links FROM a JOIN a b ON a.gram = b.gram AND abs(a."row" - b."row") + abs(a.col - b.col) = 1 GROUP BY a.gram),
s AS (SELECT gram, sum(d * d) AS sq, any_value(mean) AS mean, any_value(cells) AS cells FROM a GROUP BY gram)
SELECT gram, cells, round(mean, 9) AS mean, round(CASE WHEN sq > 0 THEN cross_sum / links / (sq / cells) END, 5) AS morans_i FROM s JOIN n USING (gram)""")
def spatial_autocorrelation(spark, sf_dir):
    """Moran's I of the words that at least 16 cells hold."""
    docs = grids.with_cells(placed(table(spark, sf_dir, "documents"), "doc_id"), RegularGrid(30.0))
    grams = written(models.gram_counts(docs, ["row", "col"], words(F.col("text"))), "cell-grams")
    sums = grams.groupBy("row", "col").agg(F.sum("cnt").alias("nk"))
    probs = grams.join(sums, ["row", "col"]).select("row", "col", "gram", (F.col("cnt") / F.col("nk")).alias("p"))
    return wordstats.morans_i(probs).select("gram", "cells", F.round("mean", 9).alias("mean"), F.round("morans_i", 5).alias("morans_i"))


# --- rows and tables --------------------------------------------------------------------


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderpriority <= '2-HIGH' THEN 'soon' WHEN o_orderpriority <= '4' THEN 'later' ELSE 'none' END AS urgency,
  CASE WHEN o_orderstatus IN ('F') THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'open' END AS state, 'orders' AS corpus FROM orders
  WHERE (o_orderpriority IS NULL OR o_orderpriority NOT IN ('5-LOW')) AND o_totalprice IS NOT NULL""")
def rewritten_orders(spark, sf_dir):
    """Rename, range, membership and fixed fields, and null-safe set filters."""
    o = table(spark, sf_dir, "orders").filter(filters.not_in_set(F.col("o_orderpriority"), ["5-LOW"]) & F.col("o_totalprice").isNotNull())
    o = rows.rename(o, {"o_orderkey": "order_key"})
    o = o.withColumn("urgency", rows.range_of(F.col("o_orderpriority"), [("soon", "2-HIGH"), ("later", "4"), ("none", "")]))
    o = o.withColumn("state", rows.membership(F.col("o_orderstatus"), [("done", ["F"]), ("open", ["O", "P"])]))
    return rows.remove(rows.add_fixed(o, {"corpus": "orders"}), ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query(f"""WITH c AS (SELECT c_custkey, {placed_sql("c_custkey")} FROM customer) SELECT c_custkey FROM c WHERE lat BETWEEN -30 AND 45.5 AND (lon >= 100 OR lon <= -60)""")
def customers_in_box(spark, sf_dir):
    """A box across the antimeridian."""
    c = placed(table(spark, sf_dir, "customer"), "c_custkey")
    return c.filter(in_box(F.col("lat"), F.col("lon"), (-30.0, 100.0, 45.5, -60.0))).select("c_custkey")


@query("""SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN v END) AS "F", max(CASE WHEN l_linestatus = 'O' THEN v END) AS "O", CAST(sum(n) AS BIGINT) AS n_duplicates
FROM (SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS v, count(*) - 1 AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def pivoted_prices(spark, sf_dir):
    """Matrix of the greatest price by flag and status."""
    return rows.pivot_table(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", "l_extendedprice", ["F", "O"])


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_mktsegment FROM customer)
SELECT coalesce(o.k, c.k) AS k, n_orders, spent, c_mktsegment, o.k IS NULL AS without_orders FROM o FULL JOIN c ON o.k = c.k""")
def keyed_union(spark, sf_dir):
    """Union by key of order sums and customers, with the keys that only one side has."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return rows.union_by_key(o, c, ["k"]).withColumn("without_orders", F.col("n_orders").isNull())


@query("SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def keyed_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return rows.difference_by_key(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH u AS (SELECT lower(o.o_custkey::VARCHAR) AS "user", lower(concat('s', l_suppkey)) AS ref, count(*) AS times FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY 1, 2),
a AS (SELECT lower(concat('s', s_suppkey)) AS ref, (s_acctbal > 0)::INT AS ideology FROM supplier)
SELECT "user", round(sum(ideology * times) / sum(times), 6) AS ideology FROM u JOIN a USING (ref) GROUP BY 1 UNION ALL SELECT ref, round(ideology::DOUBLE, 6) FROM a""")
def propagated_ideology(spark, sf_dir):
    """Customers take the mean leaning of the suppliers they order from."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = lines.select(F.col("o_custkey").cast("string").alias("user"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ref"), F.lit(1).alias("times"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("user"), (F.col("s_acctbal") > 0).cast("double").alias("ideology"))
    return learning.propagate_ideology(known, refs).select("user", *r6("ideology"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, CAST(CASE (row_number() OVER (ORDER BY o_orderkey) - 1) % 10 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS INT) AS split FROM orders")
def round_robin_orders(spark, sf_dir):
    """Orders dealt 8 : 1 : 1 in the order of their keys."""
    return rows.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], (8, 1, 1))


@query("""SELECT doc_id, text, nullif(lang, 'de') AS lang, replace(text, chr(10), '|') AS lines, 'documents' AS corpus FROM documents""")
def table_round_trip(spark, sf_dir):
    """All texts and lists of their lines, with tabs, line ends and nulls, written with a schema file and scanned again."""
    base = scratch(spark, "textdb/documents")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.nullif("lang", F.lit("de")).alias("lang"), F.split("text", "\n", -1).alias("lines"))
    textdb.write(d, base, textdb.Schema(list(d.columns), {"corpus": "documents"}))
    back = textdb.read_back(spark, base, kinds={"doc_id": "long", "lines": "sequence"})
    return back.withColumn("lines", F.array_join("lines", "|"))


@query(f"""WITH s AS (SELECT doc_id AS doc, source AS slice, text FROM documents), g AS ({sql.grams("s", "doc")}),
v AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS id FROM (SELECT DISTINCT gram FROM g)), d AS (SELECT doc, row_number() OVER (ORDER BY slice, doc) - 1 AS place FROM s)
SELECT place, concat(count(*), ' ', string_agg(concat(id, ':', CAST(cnt AS INT)), ' ' ORDER BY id)) AS line FROM g JOIN v USING (gram) JOIN d USING (doc) GROUP BY place""")
def topic_model_lines(spark, sf_dir):
    """Word counts of all documents in the format of a dynamic topic model, slices by source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("slice"), "text")
    grams = models.document_counts(docs, "doc", "text", words).select("doc", F.inline("pairs"))
    return sinks.topic_model_tables(grams, docs.select("doc", "slice"))["mult"]


# --- text -------------------------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
for _code, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_code}', '{_char}')"


@query(rf"""SELECT page_id, trim(regexp_replace({_BARE}, '\s+', ' ', 'g')) AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def page_texts(spark, sf_dir):
    """Visible text, title and links of HTML pages."""
    p = table(spark, sf_dir, "pages")
    html = F.col("html")
    return p.select("page_id", wiki.html_text(html).alias("text"), wiki.html_title(html).alias("title"), F.size(wiki.html_links(html)).cast("long").alias("n_links"))


@query()
def short_text_counts(spark, sf_dir):
    """Tokens of conversation turns by the short-message tokenizer."""
    talk = table(spark, sf_dir, "conversations")
    return models.gram_counts(talk, ["role"], short_text_tokens(F.col("text"), fold=True))


# --- streams ----------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream; event times get the session's zone, as streams ask for."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if textdb.is_folder(spark, f"{sf_dir}/events.parquet"):
        rows = source.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream's source is a folder
        rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _without_zone(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in rows.schema if f.dataType.typeName() == "timestamp"})


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS slice_start, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def streamed_slices(spark, sf_dir):
    """Six-hour slices of the event stream; the run ends when all input is read."""
    path = scratch(spark, "stream-slices")
    sliced = streams.time_slices(_stream(spark, sf_dir), length="6 hours", delay="40 days")
    streams.run_to_table(sliced, f"{path}/out", f"{path}/state", "complete").awaitTermination()
    return _without_zone(spark.read.parquet(f"{path}/out")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def streamed_distinct(spark, sf_dir):
    """(user, type) pairs of the stream without repeats."""
    path = scratch(spark, "stream-distinct")
    kept = streams.without_repeats(_stream(spark, sf_dir), ["user_id", "event_type"], delay="40 days").select("user_id", "event_type")
    streams.run_to_table(kept, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def streamed_users(spark, sf_dir):
    path = scratch(spark, "stream-users")
    streams.run_to_table(streams.running_users(_stream(spark, sf_dir)), f"{path}/out", f"{path}/state", "complete").awaitTermination()
    return _without_zone(spark.read.parquet(f"{path}/out")).withColumn("total", F.round("total", 4))


# --- variants ---------------------------------------------------------------------------

NUMBERS = "[0-9]{4}"


@query(f"SELECT doc_id, lang, source FROM documents WHERE regexp_matches(text, '{NUMBERS}')")
def documents_with_numbers(spark, sf_dir):
    """Documents whose text has a match of a pattern."""
    return filters.matching_text(table(spark, sf_dir, "documents"), NUMBERS).select("doc_id", "lang", "source")


@query("""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT unnest(CASE WHEN rtrim(line, ' ') = '' AND line <> '' THEN [] ELSE string_split(rtrim(line, ' '), ' ') END) AS word FROM l)
SELECT word, count(*) AS cnt FROM w WHERE length(word) < 8 GROUP BY word""")
def short_words(spark, sf_dir):
    """Words of fewer than 8 characters in the lines of `documents`."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return wordstats.short_word_counts(lines)


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, 'flag=' || l_returnflag AS feature, 1.0::DOUBLE AS v FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount::DOUBLE FROM lineitem),
n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS depth FROM f GROUP BY 1)
SELECT l_orderkey, feature FROM f JOIN n USING (l_orderkey) GROUP BY l_orderkey, feature, depth
HAVING NOT (min(v) = max(v) AND (min(v) = 0 OR count(DISTINCT l_linenumber) = depth))""")
def order_differences(spark, sf_dir):
    """Features in which the lines of an order differ."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = F.array(F.struct(F.concat(F.lit("flag="), "l_returnflag").alias("feature"), F.lit(1.0).alias("value")), F.struct(F.lit("discount").alias("feature"), F.col("l_discount").cast("double").alias("value")))
    return wordstats.differing_features(lines.select("l_orderkey", "l_linenumber", F.inline(pairs)), ["l_orderkey"], "l_linenumber")


@query(f"""WITH {_EVENTS}, r AS (SELECT *, {cell_sql(30)} FROM e),
g AS (SELECT concat("row", ',', col) AS cell, "user", unnest([lang, 'k' || k]) AS gram FROM r)
SELECT cell, gram, CAST(count(DISTINCT "user") AS DOUBLE) AS cnt FROM g WHERE gram IS NOT NULL GROUP BY cell, gram""")
def users_by_cell_word(spark, sf_dir):
    """Cell models in which a user counts once a word."""
    events = _events(spark, sf_dir).withColumn("cell", cell_name(RegularGrid(30.0)))
    return models.counts_once_per_user(events, ["cell"], "user", F.col("tokens"))


@query("""
WITH w AS (SELECT string_split_regex(lower(p_name), '\\s+') AS w FROM part),
g AS (SELECT unnest(list_concat([[x] for x in w], CASE WHEN len(w) < 2 THEN [w] ELSE [w[i:i+1] for i in range(1, len(w))] END)) AS g FROM w)
SELECT array_to_string(g, ' ') AS gram, count(*) AS cnt FROM g GROUP BY 1""")
def name_ngrams(spark, sf_dir):
    """One- and two-word parts of the names of parts."""
    grams = table(spark, sf_dir, "part").select(F.explode(tag_ngrams(F.col("p_name"), 2)).alias("g"))
    return grams.groupBy(F.concat_ws(" ", "g").alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {sql.NAIVE_BAYES} SELECT doc, cell, round(score - max(score) OVER (PARTITION BY doc), 6) + 0.0 AS score FROM ranked WHERE rank <= 10")
def rescaled_scores(spark, sf_dir):
    """The ten best cells of each item, scores less the best one."""
    _, ranked, *_ = geolocate(spark, sf_dir)
    return ranking.rescaled(ranked.filter("rank <= 10").withColumnRenamed("naive_bayes", "score")).select("doc", "cell", (F.round("score", 6) + 0.0).alias("score"))


@query(f"""WITH {sql.NAIVE_BAYES} SELECT doc, cell, row_number() OVER (PARTITION BY doc ORDER BY md5(concat('7:', doc, ':', cell)), cell) AS rank FROM ranked WHERE rank <= 10
UNION ALL SELECT doc, cell, rank FROM ranked WHERE rank > 10""")
def random_reranking(spark, sf_dir):
    """The ten best cells of each item in a random order, the others in place."""
    _, ranked, *_ = geolocate(spark, sf_dir)
    return ranking.randomly_reranked(ranked, 10, 7).select("doc", "cell", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sql.NAIVE_BAYES}, o AS (SELECT i.doc, i.cell FROM items i JOIN cells c ON c.cell = i.cell)
SELECT doc, cell, 0.0::DOUBLE AS score, 1::BIGINT AS rank FROM o
UNION ALL SELECT doc, cell, round(score, 6) + 0.0, rank FROM ranked WHERE doc NOT IN (SELECT doc FROM o)""")
def oracle_ranking(spark, sf_dir):
    """The correct cell of each item, if it has documents; else its ranked cells."""
    corpus, ranked, truth, _ = geolocate(spark, sf_dir)
    found = ranking.oracle_ranked(ranked.withColumnRenamed("naive_bayes", "score"), truth, corpus.cells)
    return found.select("doc", "cell", (F.round("score", 6) + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))
