"""Grouping and merging of event records, duplicates, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import whole_groups

MULTIPLE = "[multiple]"
BLANKABLE = ("type", "lang", "location", "timezone", "utc_offset", "path")
COUNTED = ("user_mentions", "retweets", "hashtags", "urls")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by `order`.  A partial minimum runs before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def group_key(kind: str, slice_ms: int = 6000) -> Column:
    """`user`, `file`, `time` (slices by integer division of the least time) or `none`."""
    if kind == "user":
        return F.col("user").cast("string")
    if kind == "file":
        return F.col("path")
    if kind == "time":
        return (F.floor(F.col("ts") / slice_ms) * slice_ms).cast("string")
    if kind == "none":
        return F.lit("")
    raise ValueError(f"unknown grouping: {kind}")


def _merged_blank(name: str) -> Column:
    """Blanks yield; equal values stay; different ones become MULTIPLE."""
    value = F.nullif(F.col(name), F.lit(""))
    low, high = F.min(value), F.max(value)
    return F.when(low == high, low).when(low.isNull(), F.lit("")).otherwise(F.lit(MULTIPLE)).alias(name)


def count_map_sum(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Sum of count maps per key, item by item; the sums are formed before maps are."""
    items = rows.select(*keys, F.explode(name).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    return items.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(name))


def merge_events(events: DataFrame, key: Column, location: str = "centroid") -> DataFrame:
    """One record per key.

    id: the common one, else -1; blank-yielding fields as above; followers and
    following: the greatest; numtweets: the sum; texts in order of (time, id);
    positions: those of all, the last record's of a time; user: of the first
    record; times: least and greatest; the place is the centroid of the
    positions or the earliest one; matches: any.  Fields that `events` lacks are
    left out.  Count maps are summed.
    """
    rows = events.withColumn("key", key)
    has = set(rows.columns)
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    order = F.struct("ts", "id")
    aggs = [
        F.when(F.min("id") == F.max("id"), F.min("id")).otherwise(-1).alias("id"),
        F.min_by("user", order).alias("user"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.count(F.lit(1)).alias("n_records"),
    ]
    aggs += [_merged_blank(c) for c in BLANKABLE if c in has]
    aggs += [F.max(c).alias(c) for c in ("followers", "following") if c in has]
    if "numtweets" in has:
        aggs.append(F.sum("numtweets").alias("numtweets"))
    if "text" in has:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda t: t["text"]).alias("text"))
    if "matches" in has:
        aggs.append(F.bool_or("matches").alias("matches"))
    if "lat" in has:
        spot = F.struct("ts", "id", "lat", "lon")
        aggs += [
            F.array_sort(F.collect_list(F.when(located, spot))).alias("_spots"),
            F.min(F.when(located, spot)).alias("_first"),
        ]
    out = rows.groupBy("key").agg(*aggs)
    if "lat" in has:
        spots = F.filter(
            "_spots", lambda s, i: (i + 1 == F.size("_spots")) | (F.get("_spots", i + 1)["ts"] != s["ts"])
        )  # the last of each time
        place = lambda s: F.struct(s["ts"], F.struct(s["lat"].cast("double").alias("lat"), s["lon"].cast("double").alias("lon")))
        out = out.withColumn("positions", F.map_from_entries(F.transform(spots, place)))

        def centre(c: str) -> Column:
            n = F.greatest(F.size("positions"), F.lit(1))
            return F.aggregate(F.map_values("positions"), F.lit(0.0), lambda a, p: a + p[c], lambda a: a / n)

        mean = {c: centre(c) for c in ("lat", "lon")}
        some = F.size("positions") > 0
        for c in ("lat", "lon"):
            out = out.withColumn(c, F.when(some, mean[c]) if location == "centroid" else F.col(f"_first.{c}"))
        out = out.withColumn("geo_ts", F.coalesce("_first.ts", "min_ts")).drop("_spots", "_first")
    for c in COUNTED:
        if c in has:
            sums = count_map_sum(rows, ["key"], c)
            out = out.join(sums, "key", "left")
    return out


def group_and_filter(
    events: DataFrame, group: Column | None = None, filter_key: Column | None = None, test: Column | None = None, same_key: bool = False
) -> DataFrame:
    """The five plans: pass, group, filter groups, group then keep those that match, filter groups then group.

    `test` is asked of single records; a group matches if any of its records does.
    """
    if test is None:
        return events if group is None else merge_events(events, group)
    if group is not None and same_key:
        return merge_events(events.withColumn("matches", test), group).filter("matches")
    if filter_key is not None:
        kept = whole_groups(events.withColumn("_fk", filter_key), ["_fk"], test).drop("_fk")
    else:
        kept = events.filter(test)
    return kept if group is None else merge_events(kept, group)


# --- statistics -----------------------------------------------------------------------

#: Calendar groupings and their patterns (fixed values); W is the week of the month, QQ the weekday from Sunday = 1.
CALENDAR = {
    "year": "yyyy",
    "year/month": "yyyy-MM (MMM)",
    "year/month/day": "yyyy-MM-dd (MMM d)",
    "month": "'month' MM (MMM)",
    "month/week": "'month' MM (MMM), 'week' W",
    "month/day": "MM-dd (MMM d)",
    "weekday": "'weekday' QQ (EEE)",
    "hour": "HHa",
    "weekday/hour": "'weekday' QQ (EEE), HHa",
    "hour/weekday": "HHa, 'weekday' QQ (EEE)",
    "weekday/month": "'weekday' QQ (EEE), 'month' MM (MMM)",
    "month/weekday": "'month' MM (MMM), 'weekday' QQ (EEE)",
}


def calendar_values(at: Column) -> Column:
    """Array of (type, value) of a timestamp for every grouping of CALENDAR.

    Spark's patterns lack week of month and weekday number, so these two come
    from arithmetic.
    """
    week = F.floor((F.dayofmonth(at) + F.dayofweek(F.trunc(at, "month")) - 2) / 7) + 1

    def shown(pattern: str) -> Column:
        for mark, number in ((" W", week), (" QQ", F.dayofweek(at))):
            if mark in pattern:
                head, _, tail = pattern.partition(mark)
                ends = [F.date_format(at, head)] if head else []
                rest = [F.date_format(at, tail)] if tail else []
                return F.concat(*ends, F.lit(" "), number.cast("string"), *rest)
        return F.date_format(at, pattern)

    return F.array(*[F.struct(F.lit(n).alias("type"), shown(p).alias("value")) for n, p in CALENDAR.items()])


def property_values(rows: DataFrame, properties: Sequence[str], at: str = "ts", key2: str | None = None) -> DataFrame:
    """(type, key2, value, n, first, last) of the named columns: one scan, one aggregate."""
    pairs = F.array(*[F.struct(F.lit(p).alias("type"), F.col(p).cast("string").alias("value")) for p in properties])
    second = F.col(key2).cast("string") if key2 else F.lit("")
    flat = rows.select(F.explode(pairs).alias("p"), second.alias("key2"), at).filter("p.value is not null")
    return flat.groupBy("p.type", "key2", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def property_types(values: DataFrame) -> DataFrame:
    """Second level: lowest, highest, most and least common value, kinds, occurrences and their ratio."""
    common = F.max_by(F.struct("value", "n"), F.struct(F.col("n"), F.col("value")))
    rare = F.min_by(F.struct("value", "n"), F.struct(F.col("n"), F.col("value")))
    out = values.groupBy("type", "key2").agg(
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        common.alias("_c"),
        rare.alias("_r"),
        F.count(F.lit(1)).alias("n_values"),
        F.sum("n").alias("n_occurrences"),
    )
    return out.select(
        "type", "key2", "lowest", "highest",
        F.col("_c.value").alias("most_common"), F.col("_c.n").alias("most_common_n"),
        F.col("_r.value").alias("least_common"), F.col("_r.n").alias("least_common_n"),
        "n_values", "n_occurrences", (F.col("n_occurrences") / F.col("n_values")).alias("avg_occurrences"),
    )


def frequency_of_frequencies(rows: DataFrame, key: str) -> DataFrame:
    """(k, n_keys): how many keys have k rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_keys"))


def location_statistics(rows: DataFrame, by: str, at: str = "ts") -> DataFrame:
    """Box, centroid, quartiles, population variance, first and last place of each author."""
    aggs = []
    for c in ("lat", "lon"):
        aggs += [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("var", F.var_pop))]
        aggs += [F.percentile(c, q).alias(f"q{int(q * 100)}_{c}") for q in (0.25, 0.5, 0.75)]
        aggs += [F.min_by(c, F.struct(at, "lat", "lon")).alias(f"first_{c}"), F.max_by(c, F.struct(at, "lat", "lon")).alias(f"last_{c}")]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)


def distance_spread(rows: DataFrame, by: str) -> DataFrame:
    """Mean, population variance and maximum of the distances to each author's centroid (two passes)."""
    from ..functions.geo import distance_km

    centre = rows.groupBy(by).agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"))
    km = distance_km(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))
    near = rows.join(centre, by).withColumn("_km", km)
    return near.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_km").alias("mean_km"), F.var_pop("_km").alias("var_km"), F.max("_km").alias("max_km")
    )


def quantile_times(rows: DataFrame, at: str = "ts", parts: int = 100) -> DataFrame:
    """(percent, at): the time by which that share of all rows has come.  Times are counted by second first."""
    seconds = rows.groupBy(F.floor(F.col(at) / 1000).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("s") / 86400)
    days = seconds.groupBy(day.alias("day")).agg(F.sum("n").alias("dn"))
    whole = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("dn").over(whole), F.lit(0)).alias("before"), F.sum("dn").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("day").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = seconds.withColumn("day", day).join(F.broadcast(days), "day").withColumn("upto", F.col("before") + F.sum("n").over(inside))
    percent = F.explode(F.sequence(F.floor((F.col("upto") - F.col("n")) * parts / F.col("total")).cast("int") + 1, F.floor(F.col("upto") * parts / F.col("total")).cast("int")))
    good = running.filter(F.floor((F.col("upto") - F.col("n")) * parts / F.col("total")) < F.floor(F.col("upto") * parts / F.col("total")))
    return good.select(percent.alias("percent"), (F.col("s") * 1000).alias("at"))


def equal_bins(rows: DataFrame, value: str, order: Sequence[str], bins: int = 20) -> DataFrame:
    """Bins that start at rank n * i // bins (not ntile, which puts the remainder first): (bin, n, low, high, mean)."""
    from .rows import with_positions

    whole = rows.agg(F.count(F.lit(1)).alias("_n"))  # one row
    ranked = with_positions(rows.select(value, *order), [value, *order]).join(F.broadcast(whole))
    number = F.floor(((F.col("position") + 1) * bins - 1) / F.col("_n")).cast("int")
    return ranked.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
