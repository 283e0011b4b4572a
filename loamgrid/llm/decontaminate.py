"""Benchmark decontamination by winnowing (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, write_table

#: Words of a shared span that must be found; k-grams of GRAM words, the least of each WINDOW is kept.
SPAN, GRAM = 8, 5
WINDOW = SPAN - GRAM + 1
#: Words to each side of a matched k-gram that decide whether a span of SPAN words holds it.
SIDE = SPAN - GRAM
#: Low bits of a fingerprint hold the position, the rest is the hash.  No array of Spark's reaches 2^28 words: it
#: takes 8 bytes a word besides the words, and 2^31 bytes at most.
POS_BITS = 28
#: Most benchmark rows in a broadcast (about 200 bytes each); a larger benchmark is joined by a shuffle.
BLOCK_ROWS = 400_000
#: Words, with A-Z still in them: they are lower-cased word by word.  ASCII letters and digits, and all
#: beyond ASCII; Java tests these two classes four times as fast as the ranges they stand for.
WORD = r"[\p{Alnum}[^\p{ASCII}]]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""

    def folded(w: Column) -> Column:
        return (
            F.when(F.octet_length(w) == F.char_length(w), F.lower(w))
            .when(F.lower(w) == w, w)
            .otherwise(F.translate(w, UPPER, LOWER))
        )

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), folded)


def _packed(i: Column, *hashed: Column) -> Column:
    """Hash of some columns in the high bits, position `i` in the low ones."""
    return F.xxhash64(*hashed).bitwiseAND(F.lit(-(1 << POS_BITS))).bitwiseOR(i.cast("long"))


def _winnowed() -> Column:
    """Packed (hash, position) minima of the windows of k-grams in `words`; none for fewer than SPAN words."""
    none = F.array().cast("array<bigint>")
    gram = F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: _packed(i, *[F.get("words", i + j) for j in range(GRAM)]))

    def minima(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.least(*[F.get(h, i + j) for j in range(WINDOW)]))

    return F.when(F.size("words") >= SPAN, F.array_distinct(F.transform(F.array(gram), minima)[0])).otherwise(none)


def _runs(n: int) -> Column:
    """Packed hashes of all runs of `n` words, for items of that many words."""
    run = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: _packed(i, F.lit(n), *[F.get("words", i + j) for j in range(n)]))
    return F.when(F.size("words") >= n, run).otherwise(F.array().cast("array<bigint>"))


def _at(offset: int) -> Column:
    return F.get("words", F.col("pos") + offset)


def _unpacked(rows: DataFrame, fps: Column) -> DataFrame:
    """One row per fingerprint, as `key` and `pos`.

    `explode_outer`: the filter of `explode` would be pushed below, and the
    words be cut again inside it.
    """
    exploded = rows.withColumn("_fp", F.explode_outer(fps))
    return exploded.withColumn("key", F.shiftright("_fp", POS_BITS)).withColumn("pos", F.col("_fp").bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")).drop("_fp")


def shared_spans(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, short: bool = True
) -> DataFrame:
    """(id, text_hash, item_id, start, stop): word runs of a text that an item holds too.

    Texts and items are winnowed alike, so a shared span of SPAN words always
    shares a kept k-gram at the same place.  Benchmark rows carry the SIDE words
    to the left and right of their k-gram; after the join on the fingerprint the
    words are compared and the hit is extended to both sides.  It counts if it
    reaches SPAN words: each span is then found through its own k-gram.  An item
    of fewer than SPAN words is one span and is looked up whole, if `short`.

    Texts are cut into words once.  Up to BLOCK_ROWS benchmark rows are
    broadcast; more are joined by a shuffle, with the texts' rows carrying the
    words around their k-gram instead of the whole text.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        words_of(F.col(text_col).cast("string")).alias("words"),
    )
    bench = items.select(
        F.col(item_col).cast("string").alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("words")
    )
    places = range(-SIDE, GRAM + SIDE)
    context = F.array(*[_at(j) for j in places])
    grams = _unpacked(bench, _winnowed()).filter("key is not null").select("key", "item_id", F.lit(0).alias("n"), context.alias("c"))
    if short:
        few = bench.filter(F.size("words").between(1, SPAN - 1)).withColumn("n", F.size("words")).withColumn("pos", F.lit(0))
        key = F.lit(None).cast("long")
        for n in range(1, SPAN):
            key = F.when(F.col("n") == n, F.shiftright(_packed(F.lit(0), F.lit(n), *[_at(j) for j in range(n)]), POS_BITS)).otherwise(key)
        grams = grams.unionByName(few.select(key.alias("key"), "item_id", "n", context.alias("c")))
    grams = write_table(grams, "bench-grams")
    lengths = [r[0] for r in grams.filter("n > 0").select("n").distinct().collect()]  # SPAN - 1 at most
    fps = F.concat(_winnowed(), *[_runs(n) for n in sorted(lengths)])
    at = _unpacked(rows, fps)
    if grams.count() <= BLOCK_ROWS:
        hit, word = at.join(F.broadcast(grams), "key"), _at
    else:
        slim = at.select("id", "text_hash", "key", "pos", F.when(F.col("key").isNotNull(), context).alias("w"))
        hit = slim.join(grams, "key")

        def word(j: int) -> Column:
            return F.get("w", F.lit(j + SIDE))

    def other(j: int) -> Column:
        return F.get("c", F.lit(j + SIDE))

    same = F.lit(True)
    for j in range(SPAN - 1):
        needed = F.when(F.col("n") > 0, F.col("n")).otherwise(GRAM)
        same = same & ((F.lit(j) >= needed) | (word(j) == other(j)))
    left, right = F.lit(SIDE), F.lit(SIDE)
    for j in range(SIDE, 0, -1):  # the nearest difference decides
        left = F.when(word(-j).eqNullSafe(other(-j)) & word(-j).isNotNull(), left).otherwise(j - 1)
        reach = GRAM + j - 1
        right = F.when(word(reach).eqNullSafe(other(reach)) & word(reach).isNotNull(), right).otherwise(j - 1)
    whole = F.col("n") > 0
    found = hit.filter(same).select(
        "id",
        "text_hash",
        "item_id",
        F.when(whole, F.col("pos")).otherwise(F.col("pos") - left).alias("start"),
        F.when(whole, F.col("pos") + F.col("n")).otherwise(F.col("pos") + GRAM + right).alias("stop"),
        "n",
    )
    return found.filter((F.col("n") > 0) | (F.col("stop") - F.col("start") >= SPAN)).drop("n")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: (id, text_hash, n_words, n_hit, items).

    n_hit counts the words inside any shared span, items is the sorted list of
    the items that hold one, as strings.  A null or empty text has no words;
    equal rows are all kept with equal results; rows with one id and different
    texts are judged apart; null ids and null items are values like others
    (a null item is left out of the list); empty tables give no hits; further
    columns are ignored.
    """
    spans = shared_spans(docs, items, id_col, text_col, item_col, item_text_col)
    grouped = spans.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    union = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["upto"], r["stop"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(a["upto"], r["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = grouped.select(F.col("id").alias("_id"), F.col("text_hash").alias("_h"), union.alias("n_hit"), "items")
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_words"),
    )
    joined = base.join(hits, base.id.eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select(
        "id",
        "text_hash",
        "n_words",
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` that share no span of SPAN words with an item; those that do go.

    An item of fewer words removes nothing here: one of a few common words would
    take clean documents with it.  Judged by (id, text), so repeated rows go or
    stay together and different texts of one id are judged apart; null and empty
    texts and rows with a null id that share no span stay; all columns stay.
    """
    spans = shared_spans(docs, items, id_col, text_col, "item_id", "text", short=False)
    # As a table its size is known: the texts are shuffled only if it is too large to broadcast.
    hit = write_table(spans.select("id", "text_hash").distinct(), "contaminated")
    (key,) = fresh(docs, "_hash")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    out = keyed.join(hit, keyed[id_col].eqNullSafe(hit.id) & (keyed[key] == hit.text_hash), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: words of `documents` inside spans of `benchmark`."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    n = F.size("items").cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        n.alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (n >= 2).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (
  SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bs),
lens AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM ds),
hits AS (SELECT dw.doc_id, dw.n, dw.p, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
spots AS (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hits)),
nh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM spots GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(nh.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
