"""Other inputs: messages, dumps, books, photos, lists, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.times import millis, short_message_time


def lines_with_path(spark: SparkSession, path: str) -> DataFrame:
    """(text, path) of every line; folders are read with all below them."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, without empty ones: (title, text)."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    named = whole.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("title"), F.col("value").alias("text"))
    return named.filter(F.trim("text") != "")


#: Fields of a short message in JSON: fixed values.
MENTIONS = "array<struct<screen_name:string, indices:array<int>>>"
MESSAGE = (
    "id_str string, text string, created_at string, "
    "user struct<screen_name:string, followers_count:int, friends_count:int, lang:string, location:string, time_zone:string, utc_offset:string>, "
    "coordinates struct<type:string, coordinates:array<double>>, "
    f"entities struct<user_mentions:{MENTIONS}, "
    "hashtags:array<struct<text:string>>, urls:array<struct<url:string, expanded_url:string>>>, "
    "`delete` struct<status:struct<id_str:string>>, `limit` struct<track:long>"
)


def messages(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (text, path): one row each, `status` ok, delete, limit or bad.

    A retweet is a mention that follows `RT `.  Count columns are arrays of
    values; the merge counts them.
    """
    j = lines.select("path", F.col("text").alias("raw"), F.from_json("text", MESSAGE).alias("j"))
    status = (
        F.when(F.col("j.delete").isNotNull(), "delete")
        .when(F.col("j.limit").isNotNull(), "limit")
        .when(F.col("j.id_str").isNull() | F.col("j.text").isNull(), "bad")
        .otherwise("ok")
    )
    mentions = F.coalesce("j.entities.user_mentions", F.array().cast(MENTIONS))
    before = lambda m: F.substring("j.text", F.greatest(F.lit(1), m["indices"][0] - 2), F.lit(3))
    is_retweet = lambda m: (m["indices"][0] >= 3) & (before(m) == "RT ")
    point = F.col("j.coordinates.coordinates")
    here = (F.col("j.coordinates.type") == "Point") & (F.size(point) == 2)
    return j.select(
        "path",
        status.alias("status"),
        F.lit("tweet").alias("type"),
        F.col("j.id_str").try_cast("long").alias("id"),
        F.col("j.text").alias("text"),
        millis(short_message_time(F.col("j.created_at"))).alias("ts"),
        F.col("j.user.screen_name").alias("user"),
        F.col("j.user.followers_count").alias("followers"),
        F.col("j.user.friends_count").alias("following"),
        *[F.coalesce(F.col(f"j.user.{a}"), F.lit("")).alias(b) for a, b in (("lang", "lang"), ("location", "location"), ("time_zone", "timezone"), ("utc_offset", "utc_offset"))],
        F.lit(1).alias("numtweets"),
        F.when(here, F.get(point, 1)).alias("lat"),
        F.when(here, F.get(point, 0)).alias("lon"),
        F.transform(mentions, lambda m: m["screen_name"]).alias("user_mentions"),
        F.transform(F.filter(mentions, is_retweet), lambda m: m["screen_name"]).alias("retweets"),
        F.transform("j.entities.hashtags", lambda h: h["text"]).alias("hashtags"),
        F.transform("j.entities.urls", lambda u: F.coalesce(u["expanded_url"], u["url"])).alias("urls"),
    )


def json_path(text: Column, path: str) -> Column:
    """Value at a path; missing or null is blank."""
    return F.coalesce(F.get_json_object(text, path), F.lit(""))


#: Columns of a tab-separated message dump, in order: fixed values.
DUMP_FIELDS = (
    "rsrc", "tweet_id", "created_at", "user_id", "screen_name", "search_id", "in_reply_to_user_id", "in_reply_to_screen_name",
    "in_reply_to_search_id", "in_reply_to_status_id", "text", "source", "lang", "lat", "lon", "geo", "retweet_count", "rest",
)


def message_dump(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in DUMP_FIELDS])
    return spark.read.csv(path, sep="\t", schema=schema, quote="")


def world_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects (lat, lon, uid, city, fea): fea maps words to counts."""
    return spark.read.schema("lat double, lon double, uid string, city string, fea map<string, int>").json(path)


def count_sections(lines: DataFrame, order: str, group: str = "path", col: str = "text") -> DataFrame:
    """(title, gram, cnt) of `Article title: T` headings with lines `word = n` below them.

    A file is a sequence, so its lines are taken in order within the file.
    """
    title = F.when(F.col(col).startswith("Article title: "), F.substring(F.col(col), F.lit(16), F.length(col)))
    at = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lines.withColumn("title", F.last(title, ignorenulls=True).over(at))
    pair = r"^(\S+) = (\d+)$"
    found = filled.filter(F.col(col).rlike(pair) & F.col("title").isNotNull())
    return found.select("title", F.regexp_extract(col, pair, 1).alias("gram"), F.regexp_extract(col, pair, 2).cast("double").alias("cnt"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of XML files: dump pages, book paragraphs, photo records."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


PAGE = "title string, ns int, id long, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, ns, redir, text) of a wiki dump."""
    rows = xml_rows(spark, path, "page", PAGE)
    return rows.select("id", "title", "ns", F.coalesce("redirect._title", F.lit("")).alias("redir"), F.col("revision.text._VALUE").alias("text"))


def sequence_xml(spark: SparkSession, path: str) -> DataFrame:
    """(name, xml) of a sequence file of (file name, bytes); the one place where Spark has no DataFrame reader."""
    rdd = spark.sparkContext.sequenceFile(path)
    return spark.createDataFrame(rdd.map(lambda kv: (kv[0], bytes(kv[1]).decode("utf-8", "replace"))), "name string, xml string")


def photos(rows: DataFrame, split: bool = True) -> DataFrame:
    """(photo, owner, lat, lon, tags, split) of photo records (xml), bulk uploads reduced to their first photo."""
    from ..operators.grouping import first_of
    from ..operators.rows import three_way_split

    x = lambda p: F.expr(f"xpath_string(xml, '{p}')")
    out = rows.select(
        x("//photo/@id").try_cast("long").alias("photo"),
        x("//owner/@nsid").alias("owner"),
        x("//location/@latitude").try_cast("double").alias("lat"),
        x("//location/@longitude").try_cast("double").alias("lon"),
        F.array_join(F.expr("xpath(xml, '//tag/@raw')"), " ").alias("tags"),
    ).filter("photo is not null and lat is not null and lon is not null")
    out = first_of(out, ["tags", "owner"], ["photo"])
    key = F.coalesce(F.regexp_extract("owner", r"^(\d+)", 1).try_cast("long"), F.xxhash64("owner"))
    return out.withColumn("split", three_way_split(key)) if split else out


def regions(spark: SparkSession, path: str) -> list[tuple[str, str, list[tuple[float, float]]]]:
    """(id, name, ring of (lat, lon)) of GeoJSON polygons of one ring; a list for the driver."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    import json

    out = []
    for f in json.loads(text)["features"]:
        rings = f["geometry"]["coordinates"]
        if len(rings) != 1:
            raise ValueError("a region must have one ring")
        out.append((str(f["properties"]["id"]), f["properties"]["name"], [(y, x) for x, y in rings[0]]))
    return out


def city_table(spark: SparkSession, cities: str, admin: str, countries: str) -> DataFrame:
    """(name, lat, lon, population, admin, country) of a gazetteer and its two code lists."""
    raw = spark.read.csv(cities, sep="\t", quote="")
    base = raw.select(
        F.col("_c1").alias("name"), F.col("_c4").try_cast("double").alias("lat"), F.col("_c5").try_cast("double").alias("lon"),
        F.col("_c8").alias("cc"), F.concat_ws(".", "_c8", "_c10").alias("ac"), F.col("_c14").try_cast("long").alias("population"),
    )
    a = spark.read.csv(admin, sep="\t", quote="").select(F.col("_c0").alias("ac"), F.col("_c1").alias("admin"))
    c = spark.read.csv(countries, sep="\t", quote="", comment="#").select(F.col("_c0").alias("cc"), F.col("_c4").alias("country"))
    return base.join(a, "ac", "left").join(c, "cc", "left").drop("ac", "cc")


def id_counts(spark: SparkSession, users: str, vocabulary: str, counts: str) -> DataFrame:
    """(user, lat, lon, gram, cnt) of numbered users, words and count lines `user word n`."""
    u = spark.read.csv(users, sep="\t", quote="").select(F.col("_c0").alias("user"), F.col("_c1").try_cast("double").alias("lat"), F.col("_c2").try_cast("double").alias("lon"), F.col("_c3").try_cast("long").alias("u"))
    v = spark.read.csv(vocabulary, sep="\t", quote="").select(F.col("_c0").alias("gram"), F.col("_c1").try_cast("long").alias("w"))
    n = spark.read.csv(counts, sep=" ").select(F.col("_c0").try_cast("long").alias("u"), F.col("_c1").try_cast("long").alias("w"), F.col("_c2").try_cast("double").alias("cnt"))
    return n.join(u, "u").join(v, "w").select("user", "lat", "lon", "gram", "cnt")


def article_data(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header line."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def clean_event_fields(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fields without quotes, footnote marks and repeated blanks."""
    clean = {c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), '"', ""), r"\s+", " ")) for c in columns}
    return rows.withColumns(clean)


def annotated_spans(rows: DataFrame) -> DataFrame:
    """(volume, span, lat, lon, text) of volumes (volume, text, spans): the centre of each span's points.

    spans is JSON: [{"start": 0, "end": 10, "points": [[lon, lat], ..]}, ..].
    """
    kind = "array<struct<start: int, end: int, points: array<array<double>>>>"
    each = rows.select("volume", "text", F.posexplode(F.from_json("spans", kind)).alias("span", "s"))
    mean = lambda i: F.aggregate("s.points", F.lit(0.0), lambda a, p: a + p[i], lambda a: a / F.greatest(F.size("s.points"), F.lit(1)))
    cut = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    good = each.filter(F.size("s.points") > 0)
    return good.select("volume", "span", mean(1).alias("lat"), mean(0).alias("lon"), cut.alias("text"))
