"""Rewriting of rows and columns, keyed set operations, reports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import capfirst

#: Values that the edges of ranges are chosen from.
SAMPLE = 8192


def rename(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(names)


def remove(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.drop(*names)


def add_fixed(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


def range_of(value: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """Label of the first (label, greatest) that is not below the value, compared as text; an empty greatest takes all."""
    out = F.lit(None).cast("string")
    text = value.cast("string")
    for label, most in reversed(ranges):
        out = F.lit(label) if most == "" else F.when(text <= most, label).otherwise(out)
    return out


def membership(value: Column, lists: Sequence[tuple[str, Sequence]]) -> Column:
    """Label of the first list that has the value."""
    out = F.lit(None).cast("string")
    for label, members in reversed(lists):
        out = F.when(value.isin(list(members)), label).otherwise(out)
    return out


def unigram_maps(rows: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, counts): count map of each row's single-space separated words.  Counted by exploding, so long texts cost no more."""
    words = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), " ")).alias("_k")).filter("_k != ''")
    counted = words.groupBy(*keys, "_k").agg(F.count(F.lit(1)).cast("int").alias("_v"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("counts"))


def take_coordinates(rows: DataFrame, found: DataFrame, key: str = "title") -> DataFrame:
    """Coordinates of `found` (key, pred_lat, pred_lon) replace those of the rows it names."""
    joined = rows.join(found.select(key, "pred_lat", "pred_lon"), key, "left")
    out = joined.withColumns({"lat": F.coalesce("pred_lat", "lat"), "lon": F.coalesce("pred_lon", "lon")})
    return out.select(*rows.columns)


def output_fields(spec: str, default: Sequence[str], everything: Sequence[str], sets: dict[str, Sequence[str]] | None = None) -> list[str]:
    """Fields of `default all none +f -f set`, read from left to right."""
    sets = {"all": everything, "default": default, "none": ()} | (sets or {})
    out: list[str] = []
    for i, word in enumerate(spec.replace(",", " ").split()):
        sign, name = (word[0], word[1:]) if word[0] in "+-" else ("", word)
        members = list(sets.get(name, [name]))
        if any(m not in everything for m in members):
            raise ValueError(f"unknown field: {name}")
        if sign == "-":
            out = [f for f in (out or (list(default) if i == 0 else out)) if f not in members]
        else:
            base = list(default) if sign == "+" and i == 0 else out
            if name == "none":
                base = []
            out = base + [m for m in members if m not in base]
    return out


def split_by_field(rows: DataFrame, field: str, path: str) -> None:
    """One folder for each value; rows of a frequent value are spread over files."""
    rows.repartition(field, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(field).parquet(path)


def fix_redirects(rows: DataFrame) -> DataFrame:
    return rows.withColumn("redir", capfirst(F.col("redir")))


def reorder(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    return rows.select(*first, *[c for c in rows.columns if c not in first])


# --- keyed joins and sets -------------------------------------------------------------


def intersect_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


def union_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "full")


def difference_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def types_in_common(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(key_a, key_b, n): grams that two models share."""
    pairs = a.select(key_a, "gram").join(b.select(key_b, "gram"), "gram")
    return pairs.groupBy(key_a, key_b).agg(F.count(F.lit(1)).alias("n"))


def combined_articles(articles: DataFrame, coords: DataFrame, links: DataFrame) -> DataFrame:
    """Articles with coordinates and incoming links; links to a redirect count for its target.

    articles: (title, redir); coords: (title, lat, lon); links: (title, n).
    """
    target = F.when(F.coalesce(F.length("redir"), F.lit(0)) > 0, F.col("redir")).otherwise(F.col("title"))
    moved = links.join(articles.select("title", target.alias("_to")), "title").groupBy("_to").agg(F.sum("n").alias("incoming_links"))
    own = articles.join(coords, "title", "left").join(moved, F.col("title") == F.col("_to"), "left").drop("_to")
    return own.withColumn("incoming_links", F.coalesce("incoming_links", F.lit(0)))


def metadata_with_counts(metadata: DataFrame, counts: DataFrame) -> DataFrame:
    """Metadata with its counts by title; `missing` marks titles without any."""
    return metadata.join(counts, "title", "left").withColumn("missing", F.col("counts").isNull())


# --- tables ---------------------------------------------------------------------------


def pivot_table(rows: DataFrame, x: str, y: str, value: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Matrix of y by the given x values; of several values the last by `order` counts, `n_duplicates` tells how many went."""
    last = F.max_by(value, order or value)
    cells = rows.groupBy(y, x).agg(last.alias("_v"), (F.count(F.lit(1)) - 1).alias("_d"))
    wide = [F.max(F.when(F.col(x).cast("string") == c, F.col("_v"))).alias(c) for c in columns]
    return cells.groupBy(y).agg(*wide, F.sum("_d").alias("n_duplicates"))


def latex_table(rows: Sequence[Sequence[object]], head: Sequence[str]) -> str:
    """A small result as a LaTeX tabular."""
    lines = [" & ".join(map(str, r)) + r" \\" for r in (head, *rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", *lines, r"\end{tabular}"])


def text_table(rows: Sequence[Sequence[object]], head: Sequence[str]) -> str:
    """A small result with aligned columns."""
    cells = [[str(x) for x in r] for r in (head, *rows)]
    widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells)


# --- splits ---------------------------------------------------------------------------


def fold_number(key: Column, n: int, seed: int = 0) -> Column:
    """Fold 0 .. n-1 of a key by a seeded hash: no sort and the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")


def three_way_split(key: Column, shares: tuple[int, int, int] = (80, 10, 10)) -> Column:
    """training, dev or test by the key modulo the sum of the shares, so an owner's rows stay together."""
    at = F.pmod(key, F.lit(sum(shares)))
    return F.when(at < shares[0], "training").when(at < shares[0] + shares[1], "dev").otherwise("test")


def round_robin(rows: DataFrame, order: Sequence[str], weights: Sequence[int]) -> DataFrame:
    """`split` number of each row by position in a repeating pattern that spreads each weight evenly.

    Positions come from counts of range partitions, so rows are not gathered in
    one task; `order` must be unique.
    """
    total = sum(weights)
    places = sorted((i * total / w + total / (2 * w), s) for s, w in enumerate(weights) for i in range(w))
    pattern = F.array(*[F.lit(s) for _, s in places])
    numbered = with_positions(rows, order)
    return numbered.withColumn("split", F.element_at(pattern, (F.col("position") % total + 1).cast("int")))


def with_positions(rows: DataFrame, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """Adds `position` from 0 in the given order: a range cut at sampled edges, counts below, ranks inside.

    The edges come from at most SAMPLE values of the first sort column, the
    first by hash; they only decide how evenly the buckets are filled.  The
    positions are exact.  Nulls come first.
    """
    first = order[0]
    sample = rows.select(F.col(first).alias("v")).filter("v is not null").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    values = sorted(r[0] for r in sample)
    edges = sorted({values[i * len(values) // buckets] for i in range(1, buckets)}) if values else []
    bucket = F.lit(0)
    for i, e in enumerate(edges, 1):  # the greatest edge is asked first
        bucket = F.when(F.col(first) > F.lit(e), i).otherwise(bucket)
    placed = rows.withColumn("_b", bucket)
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_s"))  # a row per bucket
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return placed.join(F.broadcast(starts), "_b").withColumn("position", F.col("_s") + inside).drop("_b", "_s")


def permuted(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in a seeded random order: a distributed sort by hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def sorted_by(rows: DataFrame, value: str, most_first: bool = True) -> DataFrame:
    """Table sorted by value, the greatest first, or the least; ties by all columns in their order."""
    col = F.col(value)
    return rows.orderBy(col.desc() if most_first else col.asc(), *rows.columns)


def counted(rows: DataFrame, name: str, tests: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and counters by name that are filled while an action reads them."""
    seen = Observation(name)
    return rows.observe(seen, *[F.count(F.when(test, 1)).alias(n) for n, test in tests.items()]), seen
