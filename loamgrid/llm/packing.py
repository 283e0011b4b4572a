"""Packing into optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_ranks, fresh, write_table

RANK_BITS = 12


def optimal_buckets(lengths, counts, k: int) -> list[int]:
    """Upper bounds of at most `k` buckets with the least total padding.

    Padding of bucket (i, j] is sum(count * (length_j - length)).  That cost has
    the concave Monge property, so each layer of the dynamic program is filled
    by divide and conquer over its optimal split points, all midpoints of one
    depth at once.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    d = len(lengths)
    if d == 0:
        return []
    if k >= d:
        return lengths.tolist()
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(object if int(counts.sum()) * int(lengths[-1]) > 2**62 else np.int64)
    mass = np.concatenate([[0], np.cumsum(counts.astype(rows.dtype) * lengths)])

    def cost(i, j):
        """Padding of values i+1..j (1-based)."""
        return (rows[j] - rows[i]) * lengths[j - 1] - (mass[j] - mass[i])

    best = np.concatenate([[0], cost(0, np.arange(1, d + 1))]).astype(rows.dtype)
    splits = []
    for _ in range(1, k):
        new, cut = best.copy(), np.zeros(d + 1, np.int64)
        stack = [(1, d, 0, d - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            at = int(np.argmin(total))
            new[mid], cut[mid] = total[at], i[at]
            stack.append((lo, mid - 1, a, int(i[at])))
            stack.append((mid + 1, hi, int(i[at]), b))
        best = new
        splits.append(cut)
    bounds, j = [], d
    for cut in reversed(splits):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    if j:
        bounds.append(int(lengths[j - 1]))
    return bounds[::-1]


def pack(
    rows: DataFrame, length_col: str, id_col: str = "doc_id", k: int = 16, budget: int = 32768, seed: int = 5
) -> DataFrame:
    """Put rows into length buckets and token-budget batches.

    The global histogram of lengths (one row per distinct length: at most the
    root of twice the corpus's tokens) goes to the driver, where a dynamic
    program picks the `k` bounds with the least padding.  In each bucket rows
    take a seeded random order and every max(1, budget // bound) of them form a
    batch; a row longer than the budget is a batch alone, whole.  Ranks are
    counted in hash buckets, so a bucket with most of the rows is not gathered.

    Adds bucket (0-based), bucket_len, batch (0-based in its bucket), slot and
    padding; columns of these names are replaced, all others pass through.  A
    null length counts as 0; equal rows stay, each in its own slot; an empty
    table gives an empty result.
    """
    length, h, b, rank, total = fresh(rows, "_len", "_h", "_b", "_rank", "_total")
    made = ["bucket", "bucket_len", "batch", "slot", "padding"]
    rows = rows.drop(*[c for c in made if c not in (id_col, length_col)])
    salt = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns])  # one id may be that of many rows
    rows = rows.withColumn(length, F.coalesce(F.col(length_col), F.lit(0)).cast("long")).withColumn(h, salt)
    histogram = rows.groupBy(length).agg(F.count(F.lit(1))).collect()
    bounds = optimal_buckets([r[0] for r in histogram], [r[1] for r in histogram], k)
    bucket = F.lit(max(0, len(bounds) - 1))
    bound = F.lit(bounds[-1] if bounds else 0).cast("long")
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col(length) <= bounds[i], i).otherwise(bucket)
        bound = F.when(F.col(length) <= bounds[i], F.lit(bounds[i]).cast("long")).otherwise(bound)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", bound)
    rows = rows.withColumn(b, F.shiftrightunsigned(h, 64 - RANK_BITS))
    ranked = bucket_ranks(rows, ["bucket"], b, [h, id_col, length], rank, total)
    per = f"greatest(1L, {budget} div greatest(bucket_len, 1L))"
    return (
        ranked.withColumn("batch", F.expr(f"{rank} div {per}"))
        .withColumn("slot", F.expr(f"cast({rank} % {per} as int)"))
        .withColumn("padding", F.col("bucket_len") - F.col(length))
        .drop(h, b, rank, total, length)
    )


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Length of each text: its words plus one for the end mark.  A null text has length 1.

    Each word with the blanks after it becomes one letter, and letters are
    counted.  regexp_count would hold an array of all words of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    letters = F.regexp_replace(text, F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit("x"))
    words = F.octet_length(F.ltrim(letters, F.lit(" \t\n\v\f\r")))  # blanks before the first word
    return docs.select(F.col(id_col), (words + 1).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame, k: int = 16, budget: int = 32768) -> DataFrame:
    """The lengths are written once, so texts are read a single time."""
    return pack(write_table(word_lengths(docs), "pack-lengths"), "n_tokens", k=k, budget=budget)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 optimal buckets with batches of 32,768 padded tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
