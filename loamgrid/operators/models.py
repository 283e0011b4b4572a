"""Language models as relations: one row per (key, gram) with a count, one row per key with its totals.

Counts stay long and narrow; nothing keeps a whole vocabulary in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

OOV = "-OOV-"


def gram_counts(docs: DataFrame, keys: Sequence[str], tokens: Column, weight: Column | None = None) -> DataFrame:
    """(keys, gram, cnt): occurrences of each token, or the sum of `weight` over them."""
    one = F.lit(1) if weight is None else weight
    rows = docs.select(*keys, one.alias("_w"), F.explode(tokens).alias("gram"))
    return rows.groupBy(*keys, "gram").agg(F.sum("_w").cast("double").alias("cnt"))


#: Characters of the longest text whose words are counted inside its row.
LONG_TEXT = 4_000_000


def document_counts(docs: DataFrame, key: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(key, pairs) of each document with a token: pairs is an array of (gram, cnt), of all rows with the key.

    Tokens are sorted and counted inside the row, so they are not shuffled.
    Rows that share a key, and keys with a text above LONG_TEXT, are counted by
    an aggregate instead.
    """
    several = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(F.length(text)).alias("_long"))
    several = written(several.filter((F.col("_n") > 1) | (F.col("_long") > LONG_TEXT)).select(key), "several")
    alone = docs.select(key, text).join(several, key, "left_anti").filter(F.col(key).isNotNull())
    shared = docs.select(key, text).join(several, key, "left_semi").unionByName(docs.select(key, text).filter(F.col(key).isNull()))
    starts = F.transform("_a", lambda x, i: F.when((i == 0) | (x != F.get("_a", i - 1)), i))
    count = lambda p, k: F.coalesce(F.get("_s", k + 1), F.size("_a")) - p
    pair = lambda p, k: F.struct(F.get("_a", p).alias("gram"), count(p, k).cast("double").alias("cnt"))
    inside = alone.select(key, F.sort_array(tokens(F.col(text))).alias("_a"))
    inside = inside.withColumn("_s", F.filter(starts, lambda i: i.isNotNull())).select(key, F.transform("_s", pair).alias("pairs"))
    summed = gram_counts(shared, [key], tokens(F.col(text))).groupBy(key).agg(F.collect_list(F.struct("gram", "cnt")).alias("pairs"))
    return written(inside.union(summed), "doc-counts").filter(F.size("pairs") > 0)


#: Grams that a join broadcasts, those in most documents.
FREQUENT = 50_000


def join_by_gram(grams: DataFrame, stats: DataFrame) -> DataFrame:
    """grams (gram, ..) with the columns of `stats` (gram, df, ..), inner.

    The FREQUENT grams of greatest df are joined by a broadcast, so that most
    rows stay where they are and no frequent gram meets in one task; the others
    by what the planner takes.  Both frames are read twice and should be written.
    """
    top = written(stats.orderBy(F.col("df").desc(), "gram").limit(FREQUENT), "frequent")
    names = F.broadcast(top.select("gram"))
    rare = grams.join(names, "gram", "left_anti").join(stats.join(names, "gram", "left_anti"), "gram")
    return grams.join(F.broadcast(top), "gram").unionByName(rare)


def merged(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum models: the counts of all rows with equal keys."""
    return grams.groupBy(*keys, "gram").agg(F.sum("cnt").alias("cnt"))


def add_weighted(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: float = 1.0) -> DataFrame:
    """Model a plus `weight` times model b."""
    return merged(a.unionByName(b.withColumn("cnt", F.col("cnt") * weight)), keys)


def without_stopwords(grams: DataFrame, stopwords: Sequence[str], whitelist: Sequence[str] = ()) -> DataFrame:
    """Drop stopwords; if a whitelist is given, keep its members alone.  Both lists are literals of the plan."""
    out = grams.filter(~F.col("gram").isin(list(stopwords))) if stopwords else grams
    return out.filter(F.col("gram").isin(list(whitelist))) if whitelist else out


def prune(grams: DataFrame, keys: Sequence[str], minimum: float = 1, vocabulary: DataFrame | None = None) -> DataFrame:
    """Counts below `minimum`, and grams outside `vocabulary` (gram), become one OOV gram per key."""
    keep = F.col("cnt") >= minimum
    if vocabulary is not None:
        grams = grams.join(vocabulary.select("gram").distinct().withColumn("_in", F.lit(True)), "gram", "left")
        keep = keep & F.coalesce("_in", F.lit(False))
    renamed = grams.select(*keys, F.when(keep, F.col("gram")).otherwise(OOV).alias("gram"), "cnt")
    return merged(renamed, keys)


def weighted(grams: DataFrame, weights: DataFrame, missing: float) -> DataFrame:
    """Counts times word weights (gram, weight); a weight of 0 drops the gram."""
    joined = grams.join(weights.select("gram", F.col("weight").alias("_wt")), "gram", "left")
    scaled = joined.withColumn("cnt", F.col("cnt") * F.coalesce("_wt", F.lit(missing))).drop("_wt")
    return scaled.filter("cnt != 0")


def word_weights(raw: DataFrame, top_percent: float = 100.0, cutoff: float | None = None) -> DataFrame:
    """(gram, weight) of the greatest `top_percent` of weights at or above `cutoff`, rescaled to a mean of 1."""
    rows = raw if cutoff is None else raw.filter(F.col("weight") >= cutoff)
    if top_percent < 100:
        (edge,) = rows.agg(F.percentile("weight", 1 - top_percent / 100)).first()
        rows = rows.filter(F.col("weight") >= edge)
    (mean,) = rows.agg(F.avg("weight")).first()
    return rows.select("gram", (F.col("weight") / F.lit(mean or 1.0)).alias("weight"))


def with_domain_copies(grams: DataFrame, domain: Column) -> DataFrame:
    """Each gram and its copy `gram_domain`, both with the same count."""
    copies = F.when(domain.isNotNull(), F.array("gram", F.concat_ws("_", "gram", domain))).otherwise(F.array("gram"))
    return grams.withColumn("gram", F.explode(copies))


def duplicate_words(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and grams that a count list names twice: an error in the input."""
    return pairs.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


@dataclass(frozen=True)
class Smoothing:
    """How much mass a model leaves to words it has not seen."""

    kind: str = "dirichlet"
    value: float = 1_000_000.0
    interpolate: bool = True

    @staticmethod
    def parse(text: str, interpolate: bool | None = None) -> Smoothing:
        """`dirichlet:M`, `jelinek-mercer:L`, `pseudo-good-turing` or `unsmoothed`; bare names have defaults."""
        kind, _, value = text.partition(":")
        kind = {"jm": "jelinek-mercer", "jelinek": "jelinek-mercer", "pgt": "pseudo-good-turing"}.get(kind, kind)
        defaults = {"dirichlet": 500.0, "jelinek-mercer": 0.3, "pseudo-good-turing": 0.0, "unsmoothed": 0.0}
        if kind not in defaults:
            raise ValueError(f"unknown language model: {text}")
        mixed = kind != "pseudo-good-turing" if interpolate is None else interpolate
        return Smoothing(kind, float(value) if value else defaults[kind], mixed)

    def unseen(self, total: Column, singles: Column) -> Column:
        """Unseen mass of a model of `total` tokens with `singles` grams that occur once."""
        if self.kind == "dirichlet":
            return 1 - total / (total + self.value)
        if self.kind == "jelinek-mercer":
            return F.lit(self.value)
        if self.kind == "pseudo-good-turing":
            share = F.greatest(F.lit(1), singles) / F.greatest(total, F.lit(1e-300))
            return F.when(total == 0, 0.5).otherwise(F.least(F.lit(0.5), share))
        return F.lit(0.0)


def global_counts(doc_grams: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(gram, cnt, df) over the training documents; `doc_grams` has one row per document and gram."""
    return doc_grams.groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("df"))


def global_probs(doc_grams: DataFrame, id_col: str = "doc_id", tf_idf: bool = False) -> DataFrame:
    """(gram, cnt, df, g): global probability, optionally of count * ln(documents / df)."""
    stats = global_counts(doc_grams, id_col)
    mass = F.col("cnt")
    if tf_idf:
        n = doc_grams.agg(F.count_distinct(id_col).alias("_n"))
        stats = stats.join(F.broadcast(n))  # one row
        mass = F.col("cnt") * F.ln(F.col("_n") / F.col("df"))
    stats = stats.withColumn("_m", mass)
    total = stats.agg(F.sum("_m").alias("_t"))  # one row
    return stats.join(F.broadcast(total)).withColumn("g", F.col("_m") / F.col("_t")).select("gram", "cnt", "df", "g")


def scale_idf(grams: DataFrame, global_stats: DataFrame, n_docs: float) -> DataFrame:
    """Counts times ln(D / (df + 1)), or times 0.0001 where that is not positive."""
    return scaled_by_df(grams.join(global_stats.select("gram", "df"), "gram", "left"), n_docs)


def scaled_by_df(joined: DataFrame, n_docs: float) -> DataFrame:
    """`scale_idf` of grams that have their `df`."""
    idf = F.ln(F.lit(float(n_docs)) / (F.coalesce("df", F.lit(0)) + 1))
    return joined.withColumn("cnt", F.col("cnt") * F.when(idf > 0, idf).otherwise(0.0001)).drop("df")


def scale_l2(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over the root of the sum of their squares."""
    norms = grams.groupBy(*keys).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("_n"))
    return grams.join(norms, list(keys)).withColumn("cnt", F.col("cnt") / F.col("_n")).drop("_n")


def totals(grams: DataFrame, keys: Sequence[str], smoothing: Smoothing, global_stats: DataFrame | None = None) -> DataFrame:
    """(keys, types, total, u, big_u): tokens, unseen mass, and the global mass of unseen words.

    `big_u` is 1 under interpolation, else 1 less the global probability of the
    model's own words.
    """
    source, seen = grams, F.lit(0.0)
    if not smoothing.interpolate and global_stats is not None:
        source = grams.join(global_stats.select("gram", "g"), "gram", "left")
        seen = F.sum(F.coalesce("g", F.lit(0.0)))
    out = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("types"),
        F.sum("cnt").alias("total"),
        F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("_once"),
        seen.alias("_seen"),
    )
    big = F.lit(1.0) if smoothing.interpolate else 1 - F.col("_seen")
    return out.withColumns({"u": smoothing.unseen(F.col("total"), F.col("_once")), "big_u": big}).drop("_once", "_seen")


def probability(cnt: Column, total: Column, u: Column, g: Column, big_u: Column, interpolate: bool = True) -> Column:
    """Smoothed probability of a gram with count `cnt` (null or 0: unseen) and global probability `g` (null: never seen)."""
    c, g = F.coalesce(cnt, F.lit(0.0)), F.coalesce(g, F.lit(0.0))
    own = F.when(total > 0, c / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0)
    if interpolate:
        return own * (1 - u) + u * g
    rest = F.when(big_u > 0, u * g / F.when(big_u > 0, big_u).otherwise(1.0)).otherwise(0.0)
    return F.when(c > 0, own * (1 - u)).otherwise(rest)


def log_or_zero(p: Column) -> Column:
    """ln p; a word of probability 0 counts as nothing."""
    return F.when(p > 0, F.ln(F.when(p > 0, p).otherwise(1.0))).otherwise(0.0)


def smoothed(
    grams: DataFrame, keys: Sequence[str], global_stats: DataFrame, smoothing: Smoothing
) -> DataFrame:
    """(keys, gram, cnt, mle, p) of the grams a model holds."""
    sums = totals(grams, keys, smoothing, global_stats)
    joined = grams.join(sums, list(keys)).join(global_stats.select("gram", "g"), "gram", "left")
    c = {n: F.col(n) for n in ("cnt", "total", "u", "g", "big_u")}
    p = probability(c["cnt"], c["total"], c["u"], c["g"], c["big_u"], smoothing.interpolate)
    return joined.select(*keys, "gram", "cnt", (c["cnt"] / c["total"]).alias("mle"), p.alias("p"))


def most_common(grams: DataFrame, keys: Sequence[str], test: Column | None = None) -> DataFrame:
    """(keys, gram, cnt) of the greatest count among grams that pass `test`; the least gram of equals."""
    rows = grams if test is None else grams.filter(test)
    best = rows.groupBy(*keys).agg(F.min(F.struct((-F.col("cnt")).alias("n"), F.col("gram"))).alias("b"))
    return best.select(*keys, F.col("b.gram").alias("gram"), (-F.col("b.n")).alias("cnt"))


def most_contributing(joined: DataFrame, score: Column, k: int) -> DataFrame:
    """The k grams with the greatest absolute contribution (a top-k report)."""
    return joined.withColumn("contribution", score).orderBy(F.abs("contribution").desc(), "gram").limit(k)


def counts_once_per_user(docs: DataFrame, keys: Sequence[str], user: str, tokens: Column) -> DataFrame:
    """(keys, gram, cnt): of each token the users that have it, so that one user's many documents count once.

    Pairs are made distinct before they are counted; no set of users is held in memory.
    """
    pairs = docs.select(*keys, F.col(user).alias("_user"), F.explode(tokens).alias("gram")).filter("gram is not null")
    return pairs.distinct().groupBy(*keys, "gram").agg(F.count(F.lit(1)).cast("double").alias("cnt"))
