"""Quality rules: text statistics and a learned decision list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_marks")
_BLANK, _SYMBOLS, _UPPER, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), b"!?"
#: Ratios the rules put thresholds on, as SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "word_length": "n_words_safe.word_chars",
    "symbols": "n_words_safe.n_symbols",
    "dup_lines": "n_lines_safe.n_dup_lines",
    "repeats": "n_words_safe.n_repeat_words",
    "distinct": "n_words_safe.n_distinct",
    "upper": "word_chars_safe.n_upper",
    "marks": "n_words_safe.n_marks",
}


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of `width` words that occurs twice or more in the list.  Exact."""
    n = len(words)
    if n <= width:
        return 0
    ids = {w: i for i, w in enumerate(set(words))}
    if len(ids) == n:
        return 0
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    m, v = n - width + 1, len(ids)
    key = codes[:m]
    top = v
    for j in range(1, width):
        if top * v >= 1 << 62:  # number the prefixes anew, so products stay exact
            key = np.unique(key, return_inverse=True)[1]
            top = int(key.max()) + 1
        key = key * v + codes[j : j + m]
        top *= v
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(n, bool)
    for j in range(width):
        inside[j : j + m] |= again
    return int(inside.sum())


def text_stats(data: bytes) -> tuple[int, ...]:
    """Values of BASE and MORE for one UTF-8 text."""
    words = data.split()
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    lines = [x for x in data.split(b"\n") if x.strip()]

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return (
        len(words),
        points - count(_BLANK),
        count(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        count(_UPPER),
        count(_MARKS),
    )


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` and the statistics of each row's text, in Arrow batches.  A null text has zeros."""
    kinds = docs.select(*keep).schema
    names = [*keep, *BASE, *MORE]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [f"{c} long" for c in (*BASE, *MORE)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(bytes(x.as_buffer())) if x.is_valid else (0,) * 9 for x in b.column(b.num_columns - 1)]
            stats = np.array(rows, np.int64).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(stats[:, i]) for i in range(9)]], names)

    text = F.col(text_col).cast("string").cast("binary").alias("_text")
    return docs.select(*keep, text).mapInArrow(measured, schema)


def feature(name: str) -> Column:
    """One ratio of FEATURES as a Spark column; a zero divisor counts as one."""
    spec = FEATURES[name]
    if "." not in spec:
        return F.expr(spec)
    by, of = spec.split(".")
    return F.col(of) / F.greatest(F.col(by.removesuffix("_safe")), F.lit(1))


def feature_matrix(stats: np.ndarray) -> np.ndarray:
    """The same ratios of rows of (BASE, MORE)."""
    names = [*BASE, *MORE]
    at = {c: stats[:, i].astype(float) for i, c in enumerate(names)}
    out = []
    for spec in FEATURES.values():
        if "." in spec:
            by, of = spec.split(".")
            out.append(at[of] / np.maximum(at[by.removesuffix("_safe")], 1))
        else:
            out.append(at[spec[7:-1]])
    return np.stack(out, axis=1)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def test(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, longest: int) -> Rule:
    """Add the condition with the most information gain until no negative is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for i, name in enumerate(FEATURES):
            v, t = x[inside, i], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            low_p = np.cumsum(t)[ends].astype(float)
            low_n = (ends + 1) - low_p
            middle = (v[ends] + v[ends + 1]) / 2
            for above, pp, nn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = pp * (np.log2((pp + 1e-12) / (pp + nn)) - np.log2(p / (p + n)))
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), Condition(name, above, float(middle[at])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].test(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    inside = _covers(rule, x)
    p, n = int(y[inside].sum()), int((~y[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(
    x: np.ndarray, y: np.ndarray, most: int = 12, longest: int = 4, least_precision: float = 0.9, seed: int = 3
) -> list[Rule]:
    """Ordered rules for y = True by sequential covering.

    Each rule is grown on two thirds of the rows left, pruned from its end on
    the other third by (p - n) / (p + n), and kept if its precision there is at
    least `least_precision`; the rows it covers then go.
    """
    left, rules, order = np.arange(len(x)), [], np.random.default_rng(seed).permutation(len(x))
    left = left[order]
    while len(rules) < most and y[left].sum() >= 5:
        grow, prune = left[np.arange(len(left)) % 3 != 0], left[np.arange(len(left)) % 3 == 0]
        rule = _grow(x[grow], y[grow], longest)
        if not rule:
            break
        cut = max(range(1, len(rule) + 1), key=lambda k: (_worth(rule[:k], x[prune], y[prune]), -k))
        rule = rule[:cut]
        if _worth(rule, x[prune], y[prune]) < 2 * least_precision - 1:
            break
        rules.append(rule)
        left = left[~_covers(rule, x[left])]
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """1-based number of the first rule that fires, else null: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        test = F.lit(True)
        for c in rules[i]:
            test = test & c.column()
        out = F.when(test, i + 1).otherwise(out)
    return out


def learned_on(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> list[Rule]:
    """Rules for quality = 0 from at most `rows` labelled documents (a bounded sample, by hash).

    Of different texts under one id the one of the least statistics counts, so
    equal rows give equal rules in any order.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, rows)
    stats = with_stats(sample, ["doc_id", "_y_quality"])
    least = stats.groupBy("doc_id").agg(F.min(F.struct("_y_quality", *BASE, *MORE)).alias("s")).select("s.*")
    got = np.array(sorted(tuple(r) for r in least.collect()), np.int64).reshape(-1, 10)
    return learn_rules(feature_matrix(got[:, 1:]), got[:, 0] == 0) if len(got) else []


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdicts of every row: (id, statistics, base_failed, rule, kept).

    Null and empty texts have zeros and fail the base rule; equal rows get equal
    verdicts and all stay; an empty table gives an empty result; further
    columns are ignored.
    """
    out = with_stats(docs, [id_col], text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: statistics, base rule and learned verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learned_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules)
