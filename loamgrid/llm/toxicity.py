"""Toxicity: classifier chains over labelled categories."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, labelled_sample, write_table

#: Chain order: category -> the label column and the value that means it.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: Prefixes of a word that are terms too, so inflected forms share weight.
PREFIXES = (4, 5)
#: Labelled documents that the models are fitted on, at most; terms chosen for each category.
SAMPLE, TERMS = 8000, 500
FOLDS = 4
_WORDS = re.compile(r"[^\W\d_]+").findall
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
DENSE = 5


def terms_of(text: str) -> set[str]:
    """Lower-cased words of a text and marked prefixes of the longer ones."""
    words = set(_WORDS(text.lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def dense_of(data: bytes) -> list[float]:
    """Shares of symbols and capitals, of distinct words, mean word length and log length, all about 0 to 1."""
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    return [
        (len(data) - len(data.translate(None, _SYMBOLS))) / size * 10,
        (len(data) - len(data.translate(None, _UPPER))) / size * 2,
        len(set(words)) / n,
        size / n / 10,
        float(np.log1p(n)) / 10,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(
    rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, l2: float = 0.1, rounds: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """(term weights, dense weights with the bias last) of a ridge logistic regression.

    Inputs are sets of term numbers and dense columns; both classes weigh alike.
    Full-batch gradients, each weight's step bounded by its own curvature: no
    random state, so equal data give equal weights.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    dense = np.concatenate([dense, np.ones((len(rows), 1))], axis=1)
    p = max(1, int(y.sum()))
    cost = np.where(y, len(y) / (2 * p), len(y) / (2 * max(1, len(y) - p)))
    width = np.bincount(owner, minlength=len(rows)) + (dense**2).sum(axis=1)  # terms that move together
    step = 1 / (np.bincount(flat, weights=(cost * np.sqrt(width))[owner], minlength=size) / 4 + l2)
    dense_step = 1 / ((dense**2 * (cost * np.sqrt(width))[:, None]).sum(axis=0) / 4 + l2)
    w, d, vw, vd = np.zeros(size), np.zeros(dense.shape[1]), np.zeros(size), np.zeros(dense.shape[1])
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + dense @ d
        g = (_sigmoid(z) - y) * cost
        vw = 0.8 * vw - 0.4 * step * (np.bincount(flat, weights=g[owner], minlength=size) + l2 * w)
        vd = 0.8 * vd - 0.4 * dense_step * (dense.T @ g)
        w, d = w + vw, d + vd
    return w, d


def _apply(rows: list[np.ndarray], dense: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w, d = weights
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    return _sigmoid(np.bincount(owner, weights=w[flat], minlength=len(rows)) + dense @ d[:-1] + d[-1])


@dataclass
class Chain:
    """Fitted models, one for each category in order; `limits` are the least probabilities that mean it."""

    names: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)

    def numbers(self, text: str) -> np.ndarray:
        found = [self.vocabulary[t] for t in self.vocabulary.keys() & terms_of(text)]
        return np.array(sorted(found), np.int64)

    def score(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, each fed to the models after it."""
        out = np.zeros((len(rows), 0))
        for weights in self.weights:
            p = _apply(rows, np.concatenate([dense, out], axis=1), weights)
            out = np.concatenate([out, p[:, None]], axis=1)
        return out


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the greatest F1, in the middle of the gap below the last score accepted."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    ends = np.append(np.flatnonzero(p[1:] < p[:-1]), len(p) - 1)
    f1 = 2 * hits[ends] / (ends + 1 + y.sum())
    at = int(ends[int(np.argmax(f1))])
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def fit_chain(
    names: Sequence[str], vocabulary: dict[str, int], rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray
) -> Chain:
    """Fit the chain.  Later models learn from out-of-fold probabilities of the earlier categories.

    Folds go by position, so the caller gives rows in a fixed order.  The
    threshold of a category is the best one on its out-of-fold probabilities.
    A negative value in `y` is no label: the row takes no part in that
    category's models, and later ones get the probability of the full model.
    """
    chain, fold = Chain(tuple(names), vocabulary), np.arange(len(rows)) % FOLDS
    fed = dense
    for c in range(len(names)):
        known, target, held = y[:, c] >= 0, y[:, c] > 0, np.zeros(len(rows))

        def fitted(at: np.ndarray, fed: np.ndarray = fed, target: np.ndarray = target) -> tuple[np.ndarray, np.ndarray]:
            return fit_logistic([rows[i] for i in at], fed[at], target[at], len(vocabulary))

        whole = fitted(np.flatnonzero(known))
        for f in range(FOLDS):
            train, test = np.flatnonzero(known & (fold != f)), np.flatnonzero(known & (fold == f))
            if len(train) and len(test):
                held[test] = _apply([rows[i] for i in test], fed[test], fitted(train))
        rest = np.flatnonzero(~known)
        held[rest] = _apply([rows[i] for i in rest], fed[rest], whole)
        chain.weights.append(whole)
        chain.limits.append(best_limit(held[known], target[known]))
        fed = np.concatenate([fed, held[:, None]], axis=1)
    return chain


def choose_terms(sample: DataFrame, per_category: int = TERMS) -> dict[str, int]:
    """Terms whose document frequencies differ most between a category and the rest, at most `per_category` each.

    `sample` has `text` and one 0/1 column y0, y1, .. for each category.
    Frequencies are counted by Spark over the whole sample.
    """
    flags = [c for c in sample.columns if c.startswith("y")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [list(terms_of(x.as_py() or "")) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.string())), *b.columns[1:]], ["terms", *flags])

    cut_rows = sample.select("text", *flags).mapInArrow(cut, "terms array<string>, " + ", ".join(f"{c} int" for c in flags))
    counted = cut_rows.select(F.explode("terms").alias("term"), *flags).groupBy("term")
    sums = [x for c in flags for x in (F.coalesce(F.sum(c), F.lit(0)).alias(c), F.count(c).alias(f"n_{c}"))]
    counted = write_table(counted.agg(F.count(F.lit(1)).alias("n"), *sums).filter("n >= 3"), "toxicity-terms")
    totals = sample.agg(*sums).first()
    chosen: set[str] = set()
    for c in flags:
        total, one = max(1, totals[f"n_{c}"]), totals[c]
        one, zero = max(1, one), max(1, total - one)
        gap = F.abs(F.col(c) / one - (F.col(f"n_{c}") - F.col(c)) / zero) / F.sqrt((F.col(f"n_{c}") + 1) / total)
        top = counted.orderBy(gap.desc(), "term").limit(per_category)
        chosen.update(r[0] for r in top.select("term").collect())
    return {t: i for i, t in enumerate(sorted(chosen))}


def learned_on(
    docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str, int]] = CATEGORIES, rows: int = SAMPLE
) -> Chain:
    """Fit the chain on at most `rows` labelled documents of `docs` (a bounded sample, by hash).

    A row labelled for some categories alone counts for those.  Of different
    texts under one id the least counts, and of equal texts the labels of the
    least id, so equal rows give equal models in any order.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, rows, label_cols=sorted({c for _, c, _ in categories}))
    flags = [(F.col(f"_y_{c}") == v).cast("int").alias(f"y{i}") for i, (_, c, v) in enumerate(categories)]
    names = [f"y{i}" for i in range(len(flags))]
    sample = sample.select("doc_id", F.col("text").cast("string").alias("text"), *flags)
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in names])
    sample = sample.groupBy("text").agg(F.min(F.struct("doc_id", *names)).alias("s")).select("s.doc_id", "text", *[f"s.{c}" for c in names])
    sample = write_table(sample, "toxicity-sample")
    vocabulary = choose_terms(sample.drop("doc_id"))
    chain, n_flags = Chain(tuple(n for n, _, _ in categories), vocabulary), len(flags)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            found = pa.array([chain.numbers(t).tolist() for t in texts], pa.list_(pa.int32()))
            dense = pa.array([dense_of(t.encode()) for t in texts], pa.list_(pa.float64()))
            names = ["doc_id", "terms", "dense", *[f"y{i}" for i in range(n_flags)]]
            yield pa.RecordBatch.from_arrays([b.column(0), found, dense, *b.columns[2:]], names)

    kind = sample.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, terms array<int>, dense array<double>, " + ", ".join(f"y{i} int" for i in range(len(flags)))
    got = sorted(sample.mapInArrow(numbered, schema).collect(), key=lambda r: r[0])  # numbers only, of `rows` rows
    terms = [np.array(r[1], np.int64) for r in got]
    dense = np.array([r[2] for r in got], float).reshape(-1, DENSE)
    y = np.array([[-1 if v is None else v for v in r[3:]] for r in got], np.int64).reshape(-1, len(categories))
    return fit_chain(chain.names, vocabulary, terms, dense, y)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """`docs` with a column p_<category> for each category and `is_<category>` verdicts.

    A null text is scored as an empty one; every row and column stays (a column
    of one of these names is replaced); an empty table gives an empty result.
    """
    probabilities = [f"p_{n}" for n in chain.names]
    kept = [c for c in docs.columns if c == text_col or c not in {*probabilities, *[f"is_{n}" for n in chain.names]}]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            at = kept.index(text_col)
            for start in range(0, b.num_rows, 1024):
                texts = [x.as_py() or "" for x in b.column(at).slice(start, 1024)]
                rows, dense = [chain.numbers(t) for t in texts], [dense_of(t.encode()) for t in texts]
                parts.append(chain.score(rows, np.array(dense, float).reshape(-1, DENSE)))
            p = np.concatenate([*parts, np.zeros((0, len(chain.names)))])
            columns = [pa.array(p[:, i]) for i in range(len(chain.names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*kept, *probabilities])

    out = docs.select(*kept).mapInArrow(scored, ", ".join([*fields, *[f"{n} double" for n in probabilities]]))
    for n, limit in zip(chain.names, chain.limits, strict=True):
        out = out.withColumn(f"is_{n}", F.col(f"p_{n}") >= limit)
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` that the chain does not find toxic, with the columns of `docs`.

    Null and empty texts are scored as empty; equal texts go or stay together;
    an empty table gives an empty result; without labels every row stays.
    """
    chain = learned_on(docs, labels)
    (taken,) = fresh(docs, "_row")  # a user's column may have the name of a verdict
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(taken), F.col("text").cast("string").alias("text"))
    return score(rows, chain).filter(~F.col("is_toxic")).select(f"{taken}.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = learned_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).drop("text")
