"""Features of (document, cell) pairs, linear learners, and iterated label propagation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- features -------------------------------------------------------------------------


def log_bin(x: Column, base: float = 2.0) -> Column:
    """Label of a logarithmic bin; zero and negative numbers have their own."""
    size = F.floor(F.log(base, F.when(x != 0, F.abs(x)))).cast("int").cast("string")
    return F.when(x == 0, "zero").when(x < 0, F.concat(F.lit("neg"), size)).otherwise(size)


def fraction_bin(x: Column, step: float = 0.1) -> Column:
    return F.floor(x / step + 1e-9).cast("int").cast("string")


def cell_features(cells: DataFrame) -> DataFrame:
    """(cell, feat, value) of the cell alone: documents, types, tokens, tokens per type and per document, salience."""
    pairs = {
        "$num-docs": F.col("n_docs"),
        "$num-types": F.col("types"),
        "$num-tokens": F.col("total"),
        "$tokens-per-type": F.try_divide(F.col("total"), F.col("types")),
        "$tokens-per-doc": F.try_divide(F.col("total"), F.col("n_docs")),
        "$types-per-doc": F.try_divide(F.col("types"), F.col("n_docs")),
        "$salience": F.col("salience"),
    }
    items = F.array(*[F.struct(F.lit(k).alias("feat"), v.cast("double").alias("value")) for k, v in pairs.items()])
    return cells.select("cell", F.explode(items).alias("f")).select("cell", "f.feat", "f.value").filter("value is not null")


def score_features(scored: DataFrame) -> DataFrame:
    """(doc, cell, feat, value) of score columns: KL, cosine, naive Bayes and the like."""
    names = [c for c in scored.columns if c not in ("doc", "cell")]
    items = F.array(*[F.struct(F.lit(f"${n}").alias("feat"), F.col(n).alias("value")) for n in names])
    return scored.select("doc", "cell", F.explode(items).alias("f")).select("doc", "cell", "f.feat", "f.value")


def gram_features(grams: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, feat, value): binary, count or prob of each gram of a document or cell."""
    if kind == "binary":
        value = F.lit(1.0)
    elif kind == "count":
        value = F.col("cnt")
    elif kind == "prob":
        value = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key))
    else:
        raise ValueError(f"unknown gram feature: {kind}")
    return grams.select(key, F.concat(F.lit(f"{kind}:"), "gram").alias("feat"), value.alias("value"))


def matching_features(doc_grams: DataFrame, cell_grams: DataFrame) -> DataFrame:
    """(doc, cell, feat, value) of shared grams: product and quotient of shares, and their part of the KL divergence."""
    d = doc_grams.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("doc"))).select("doc", "gram", "p")
    k = cell_grams.withColumn("q", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("cell"))).select("cell", "gram", "q")
    p, q = F.col("p"), F.col("q")
    items = {"product": p * q, "quotient": p / q, "kl": p * F.ln(p / q)}
    rows = F.array(*[F.struct(F.concat(F.lit(f"{n}:"), "gram").alias("feat"), v.alias("value")) for n, v in items.items()])
    return d.join(k, "gram").select("doc", "cell", F.explode(rows).alias("f")).select("doc", "cell", "f.feat", "f.value")


def profile_features(users: DataFrame) -> DataFrame:
    """(doc, feat, value) of profile fields: language, time zone, words and word pairs of the location and all of it."""
    words = F.filter(F.split(F.lower(F.coalesce("location", F.lit(""))), r"[^\p{L}\d]+"), lambda w: w != "")
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    feats = F.concat(
        F.transform(words, lambda w: F.concat(F.lit("loc:"), w)),
        F.transform(at, lambda i: F.concat(F.lit("loc2:"), F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))),
        F.array(F.concat(F.lit("loc-all:"), F.lower(F.coalesce("location", F.lit("")))), F.concat(F.lit("lang:"), F.coalesce("lang", F.lit(""))), F.concat(F.lit("tz:"), F.coalesce("timezone", F.lit("")))),
    )
    return users.select("doc", F.explode(F.array_distinct(feats)).alias("feat"), F.lit(1.0).alias("value"))


#: Feature sets by name; `per_cell` sets describe a (document, cell) pair, the others a document alone.
FEATURE_SETS: dict[str, tuple[bool, Callable[..., DataFrame]]] = {
    "gram-binary": (False, lambda d, k, s: gram_features(d, "doc", "binary")),
    "gram-doc-count": (False, lambda d, k, s: gram_features(d, "doc", "count")),
    "gram-doc-prob": (False, lambda d, k, s: gram_features(d, "doc", "prob")),
    "matching-gram": (True, lambda d, k, s: matching_features(d, k)),
    "scores": (True, lambda d, k, s: score_features(s)),
    "trivial": (True, lambda d, k, s: score_features(s).limit(0)),
}


def features(names: Sequence[str], doc_grams: DataFrame, cell_grams: DataFrame, scored: DataFrame, per_cell: bool) -> DataFrame:
    """Union of the named feature sets that fit; those of the other kind are left out."""
    unknown = set(names) - set(FEATURE_SETS)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    chosen = [make(doc_grams, cell_grams, scored) for kind, make in (FEATURE_SETS[n] for n in names) if kind == per_cell]
    if not chosen:
        raise ValueError("none of the feature sets fits")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def feature_index(feats: DataFrame) -> DataFrame:
    """(feat, idx): stable numbers in the order of names, found without gathering them in one task."""
    from .rows import with_positions

    names = feats.select("feat").distinct()
    return with_positions(names, ["feat"]).select("feat", F.col("position").alias("idx"))


def rescaled(feats: DataFrame, keys: Sequence[str] = ("inst",)) -> DataFrame:
    """Values over the population deviation of the feature's present values in each instance; constants stay."""
    spread = feats.groupBy(*keys, "feat").agg(F.stddev_pop("value").alias("_s"))
    return feats.join(spread, [*keys, "feat"]).withColumn("value", F.when(F.col("_s") > 0, F.col("value") / F.col("_s")).otherwise(F.col("value"))).drop("_s")


def choice_specific(feats: DataFrame) -> DataFrame:
    """Features of (inst, label, feat, value) that differ between labels in some instance: unequal values, or missing for a label."""
    labels = feats.groupBy("inst").agg(F.count_distinct("label").alias("_depth"))
    seen = feats.groupBy("inst", "feat").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("label").alias("n"))
    good = seen.join(labels, "inst").filter((F.col("lo") != F.col("hi")) | (F.col("n") < F.col("_depth"))).select("feat").distinct()
    return feats.join(good, "feat", "left_semi")


def dense_instances(rows: DataFrame, label: str) -> DataFrame:
    """Simple-dense input to (inst, label, feat, value): numeric columns by value, others as one feature per value."""
    numeric = {f.name for f in rows.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    items = []
    for c in rows.columns:
        if c in (label, "inst"):
            continue
        if c in numeric:
            items.append(F.struct(F.lit(c).alias("feat"), F.col(c).cast("double").alias("value")))
        else:
            items.append(F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("feat"), F.lit(1.0).alias("value")))
    return rows.select("inst", F.col(label).alias("label"), F.explode(F.array(*items)).alias("f")).select("inst", "label", "f.feat", "f.value").filter("value is not null and feat is not null")


def sparse_instances(lines: DataFrame, col: str = "value") -> DataFrame:
    """Simple-sparse lines `label feature value feature value ..` to (inst, label, feat, value); `inst` must be a column."""
    parts = F.split(F.col(col), r"\s+")
    at = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct(F.element_at(parts, i).alias("feat"), F.element_at(parts, i + 1).try_cast("double").alias("value")))
    return lines.select("inst", parts[0].alias("label"), F.explode(pairs).alias("f")).select("inst", "label", "f.feat", "f.value")


# --- linear learners ------------------------------------------------------------------


@dataclass
class Linear:
    """Weights by label and feature number."""

    weights: np.ndarray
    errors: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(axis=1)


def _step(variant: int | None, loss: float, size: float, aggressiveness: float) -> float:
    """Passive-aggressive step: 0 unbounded, 1 bounded, 2 softened; None is the perceptron's."""
    if variant is None:
        return aggressiveness
    if size <= 0:
        return 0.0
    if variant == 0:
        return loss / size
    if variant == 1:
        return min(aggressiveness, loss / size)
    return loss / (size + 1 / (2 * aggressiveness))


def train_linear(
    x: np.ndarray,
    y: np.ndarray,
    n_labels: int,
    variant: int | None = None,
    averaged: bool = False,
    decay: float = 0.0,
    aggressiveness: float = 1.0,
    threshold: float = 1e-10,
    rounds: int = 10_000,
    costs: np.ndarray | None = None,
    max_loss: bool = False,
) -> Linear:
    """Perceptron or passive-aggressive learner over rows in their order.

    Updates depend on the order of rows, so this is a sequential pass on the
    driver; give it a bounded sample.  With `costs` (rows x labels) the update is
    cost-sensitive: the rival label is the predicted one or the one of greatest
    loss, and the loss holds the root of its cost.  Each round the step shrinks
    by `decay`; it ends when a round changes weights by less than `threshold`.
    """
    w = np.zeros((n_labels, x.shape[1]))
    total, steps, errors, power = np.zeros_like(w), 0, [], aggressiveness
    for _ in range(rounds):
        wrong, moved = 0, 0.0
        for k, (row, right) in enumerate(zip(x, y, strict=True)):
            s = w @ row
            wrong += int(s.argmax() != right)
            if costs is not None:
                losses = s - s[right] + np.sqrt(costs[k])
                rival = int(losses.argmax()) if max_loss else int(s.argmax())
                loss = float(losses[rival])
            else:
                others = s.copy()
                others[right] = -np.inf
                rival = int(others.argmax()) if n_labels > 1 else right
                loss = float(max(0.0, 1 + s[rival] - s[right])) if variant is not None else float(s[rival] >= s[right])
            if rival != right and loss > 0:
                tau = _step(variant, loss, 2 * float(row @ row), power)
                w[right] += tau * row
                w[rival] -= tau * row
                moved += abs(tau)
            total += w
            steps += 1
        errors.append(wrong / max(1, len(y)))
        power *= 1 - decay
        if moved < threshold:
            break
    return Linear(total / max(1, steps) if averaged else w, errors)


def collect_matrix(feats: DataFrame, labels: Sequence, most: int = 20_000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Dense matrix of at most `most` instances (a bounded sample by hash) of (inst, label, feat, value)."""
    chosen = feats.select("inst").distinct().orderBy(F.xxhash64("inst"), "inst").limit(most)
    rows = feats.join(F.broadcast(chosen), "inst", "left_semi").collect()
    names = sorted({r["feat"] for r in rows})
    at, known = {n: i for i, n in enumerate(names)}, {v: i for i, v in enumerate(labels)}
    insts: dict = {}
    for r in sorted(rows, key=lambda r: str(r["inst"])):
        insts.setdefault(r["inst"], (known[r["label"]], np.zeros(len(names))))[1][at[r["feat"]]] = r["value"]
    x = np.stack([v for _, v in insts.values()]) if insts else np.zeros((0, len(names)))
    return x, np.array([c for c, _ in insts.values()], int), names


def linear_scores(feats: DataFrame, weights: DataFrame) -> DataFrame:
    """(inst, label, score): sparse dot products of (inst, feat, value) with (feat, label, weight)."""
    joined = feats.join(weights, "feat")
    return joined.groupBy("inst", "label").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def cost_column(km: Column, kind: str = "dist") -> Column:
    return {"dist": km, "sqrt-dist": F.sqrt(km), "log-dist": F.log1p(km)}[kind]


def cell_classifier(train: DataFrame, tokens: str = "tokens", label: str = "label", size: int = 1 << 16, rounds: int = 50):
    """Multinomial logistic regression on hashed term counts (pyspark.ml), a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        HashingTF(inputCol=tokens, outputCol="_x", numFeatures=size),
        LogisticRegression(labelCol="_y", featuresCol="_x", maxIter=rounds, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(train)


def accuracy_table(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """(label, n, right, accuracy) of predictions."""
    hit = F.sum(F.when(F.col(label) == F.col(guess), 1).otherwise(0))
    return predicted.groupBy(label).agg(F.count(F.lit(1)).alias("n"), hit.alias("right"), (hit / F.count(F.lit(1))).alias("accuracy"))


# --- reranking ------------------------------------------------------------------------


def rerank_training(ranked: DataFrame, truth: DataFrame, n: int = 10) -> DataFrame:
    """(doc, cell, score, correct) of the n best cells; a correct cell below them takes the place of the n-th."""
    joined = ranked.join(truth.select("doc", "correct_cell"), "doc")
    joined = joined.withColumn("correct", F.col("cell") == F.col("correct_cell"))
    inside = F.max(F.when(F.col("correct") & (F.col("rank") <= n), 1).otherwise(0)).over(Window.partitionBy("doc"))
    has = F.max(F.col("correct").cast("int")).over(Window.partitionBy("doc"))
    marked = joined.withColumns({"_in": inside, "_has": has})
    last = F.when((F.col("_in") == 1) | (F.col("_has") == 0), n).otherwise(n - 1)
    return marked.filter((F.col("rank") <= last) | F.col("correct")).select("doc", "cell", "score", "rank", "correct")


def folds(docs: DataFrame, k: int = 5, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """k (training, held-out) pairs by a seeded hash of `doc`."""
    from .rows import fold_number

    marked = docs.withColumn("_f", fold_number(F.col("doc"), k, seed))
    return [(marked.filter(F.col("_f") != i).drop("_f"), marked.filter(F.col("_f") == i).drop("_f")) for i in range(k)]


# --- propagation ----------------------------------------------------------------------


def propagate_ideology(accounts: DataFrame, references: DataFrame, rounds: int = 1, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(user, ideology) after `rounds` passes: the mean ideology of the accounts a user refers to, weighted by times.

    accounts: (user, ideology) that are known; references: (user, ref, times).
    Names are compared in lower case.  Users that refer to no known account keep
    their own.  `checkpoint` cuts the lineage between passes.
    """
    links = references.select(F.lower("user").alias("user"), F.lower("ref").alias("ref"), "times")
    links = links.groupBy("user", "ref").agg(F.sum("times").alias("times"))
    fixed = accounts.select(F.lower("user").alias("user"), F.col("ideology").alias("own"))
    at = fixed.select("user", F.col("own").alias("ideology"))
    for _ in range(rounds):
        near = links.join(at.select(F.col("user").alias("ref"), "ideology"), "ref")
        new = near.groupBy("user").agg((F.sum(F.col("ideology") * F.col("times")) / F.sum("times")).alias("found"))
        at = new.join(fixed, "user", "full").select("user", F.coalesce("found", "own").alias("ideology"))
        at = checkpoint(at) if checkpoint else at
    return at


def feature_ideology(uses: DataFrame, ideology: DataFrame, limits: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """Per value of a feature: accounts, references, those of either camp, weighted ideology, and spellings.

    uses: (user, value, times); values are merged in lower case.
    """
    low, high = limits
    rows = uses.withColumn("user", F.lower("user")).join(ideology, "user").withColumn("key", F.lower("value"))
    times, i = F.col("times"), F.col("ideology")
    out = rows.groupBy("key").agg(
        F.count_distinct("user").alias("n_accounts"),
        F.sum("times").alias("n_refs"),
        F.sum(F.when(i <= low, times).otherwise(0)).alias("lib_refs"),
        F.sum(F.when(i >= high, times).otherwise(0)).alias("con_refs"),
        (F.sum(i * times) / F.sum(times)).alias("ideology"),
    )
    spelled = rows.groupBy("key", "value").agg(F.sum("times").alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("spellings"))
    return out.join(spelled, "key")


def windows_of(tokens: Column, places: Column, reach: int = 10) -> Column:
    """Pseudo-documents: the `reach` tokens to both sides of each 0-based place."""
    return F.transform(places, lambda i: F.slice(tokens, F.greatest(F.lit(1), i + 1 - reach), F.least(F.lit(2 * reach + 1), i + 1 + reach)))


def co_train(
    labelled: DataFrame, unlabelled: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], least_batch: int, rounds: int, confidence: float = 0.0
) -> Iterable[DataFrame]:
    """Grow the labelled set: predict the rest, take the confident ones if there are `least_batch`, fit again.

    `fit(labelled)` returns a function rows -> rows with `label` and
    `confidence`.  Yields the labelled set after each round.
    """
    at, rest = labelled, unlabelled
    for _ in range(rounds):
        sure = fit(at)(rest).filter(F.col("confidence") >= confidence)
        if sure.count() < least_batch:
            return
        at = at.unionByName(sure.select(*at.columns))
        rest = rest.join(sure.select("doc"), "doc", "left_anti")
        yield at
