"""Predicates as columns, and the filter language for event records."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import in_box, valid_coordinate
from ..functions.text import contains_sequence, short_text_tokens
from ..functions.times import parse_date, parse_interval


def in_set(field: Column, values: Sequence) -> Column:
    """A missing field is in no set."""
    return F.coalesce(field.isin(list(values)), F.lit(False))


def not_in_set(field: Column, values: Sequence) -> Column:
    """A missing field is kept."""
    return F.coalesce(~field.isin(list(values)), F.lit(True))


@dataclass(frozen=True)
class EventColumns:
    """Columns the filter language asks for; times are milliseconds."""

    tokens: Column
    time: Column
    lat: Column
    lon: Column
    index: Column


_TOKEN = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|(<=|>=|<|>|[(),])|([^\s()<>,"']+))""")
_WORDS = {"AND", "OR", "NOT", "TIME", "LOCATION", "TWEETINDEX", "WITHIN", "EXISTS"}


class FilterParser:
    """Recursive descent over `expr := and (OR and)*`, `and := term (AND term)*`.

    A term is a run of words (found as neighbours in the text), a bracket, NOT
    term, TIME op date, TIME WITHIN interval or (date date), LOCATION WITHIN
    (south, west, north, east), LOCATION EXISTS or TWEETINDEX op number.  Quoted
    words are words even if they spell a keyword.  The result is one column, so
    the filter runs where the scan does.
    """

    def __init__(self, text: str, on: EventColumns, fold: bool = False, tokenizer=None) -> None:
        self.on, self.fold, self.items, self.at = on, fold, [], 0
        self.split = tokenizer or str.split
        place = 0
        text = text.rstrip()
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"bad syntax at {text[place:]!r}")
            quoted = m[1] if m[1] is not None else m[2]
            if quoted is not None:
                self.items.append(("word", quoted))
            elif m[3]:
                self.items.append(("mark", m[3]))
            else:
                self.items.append(("key" if m[4] in _WORDS else "word", m[4]))
            place = m.end()

    def parse(self) -> Column:
        out = self._or()
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def _peek(self, kind: str, value: str | None = None) -> bool:
        if self.at >= len(self.items):
            return False
        k, v = self.items[self.at]
        return k == kind and (value is None or v == value)

    def _take(self, kind: str, value: str | None = None) -> str:
        if not self._peek(kind, value):
            got = self.items[self.at][1] if self.at < len(self.items) else "the end"
            raise ValueError(f"expected {value or kind}, got {got!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def _or(self) -> Column:
        out = self._and()
        while self._peek("key", "OR"):
            self.at += 1
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._term()
        while self._peek("key", "AND"):
            self.at += 1
            out = out & self._term()
        return out

    def _compare(self, value: Column, read) -> Column:
        op = self._take("mark")
        if op not in ("<", "<=", ">", ">="):
            raise ValueError(f"not a comparison: {op!r}")
        limit = F.lit(read(self._take("word")))
        test = {"<": value < limit, "<=": value <= limit, ">": value > limit, ">=": value >= limit}[op]
        return F.coalesce(test, F.lit(False))

    def _term(self) -> Column:
        if self._peek("mark", "("):
            self.at += 1
            out = self._or()
            self._take("mark", ")")
            return out
        if self._peek("key", "NOT"):
            self.at += 1
            return ~self._term()
        if self._peek("key", "TIME"):
            self.at += 1
            if not self._peek("key", "WITHIN"):
                return self._compare(self.on.time, parse_date)
            self.at += 1
            if self._peek("mark", "("):
                self.at += 1
                start, end = parse_date(self._take("word")), parse_date(self._take("word"))
                self._take("mark", ")")
            else:
                start, end = parse_interval(self._take("word"))
            return F.coalesce((self.on.time >= start) & (self.on.time < end), F.lit(False))
        if self._peek("key", "LOCATION"):
            self.at += 1
            if self._peek("key", "EXISTS"):
                self.at += 1
                return valid_coordinate(self.on.lat, self.on.lon)
            self._take("key", "WITHIN")
            self._take("mark", "(")
            box = [float(self._take("word"))]
            for _ in range(3):
                self._take("mark", ",")
                box.append(float(self._take("word")))
            self._take("mark", ")")
            return in_box(self.on.lat, self.on.lon, tuple(box))
        if self._peek("key", "TWEETINDEX"):
            self.at += 1
            return self._compare(self.on.index, int)
        words = [self._take("word")]
        while self._peek("word"):
            words.append(self._take("word"))
        wanted = [w for part in words for w in self.split(part)]
        return contains_sequence(self.on.tokens, [w.lower() if self.fold else w for w in wanted])


def parse_filter(text: str, events: DataFrame, fold: bool = False) -> Column:
    """Filter on columns text (or tokens), ts (milliseconds), lat, lon and index, those that `events` has."""

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in events.columns else F.lit(None).cast(kind)

    tokens = F.col("tokens") if "tokens" in events.columns else short_text_tokens(F.col("text"), fold)
    return FilterParser(text, EventColumns(tokens, column("ts", "long"), column("lat", "double"), column("lon", "double"), column("index", "long")), fold).parse()


def valid_event(e: DataFrame) -> Column:
    """A single message with an id, a time and a user, and not at (0, 0)."""
    origin = F.coalesce((e.lat == 0) & (e.lon == 0), F.lit(False))
    return F.coalesce((e.type == "tweet") & (e.id != 0) & (e.ts != 0) & (e.user != ""), F.lit(False)) & ~origin


def not_spam(e: DataFrame) -> Column:
    return e.following.between(5, 1000) & (e.followers >= 10) & e.numtweets.between(10, 1000)


def whole_groups(rows: DataFrame, keys: Sequence[str], test: Column) -> DataFrame:
    """All rows of each group in which any row passes.  The keys that pass are joined, so no group is gathered."""
    passing = rows.filter(test).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(passing, same, "left_semi")


def listed_seconds(events: DataFrame, listed: DataFrame) -> DataFrame:
    """Events whose (user, second) is in `listed` (user, ts in milliseconds)."""
    wanted = listed.select(F.col("user"), F.floor(F.col("ts") / 1000).alias("_s")).distinct()
    return events.withColumn("_s", F.floor(F.col("ts") / 1000)).join(wanted, ["user", "_s"], "left_semi").drop("_s")


def by_titles(sections: DataFrame, titles: DataFrame, invert: bool = False) -> DataFrame:
    """Sections whose title is listed, or isn't."""
    return sections.join(titles.select("title").distinct(), "title", "left_anti" if invert else "left_semi")


def main_namespace(title: Column) -> Column:
    return ~title.contains(":")


#: US states and their postal codes: fixed values.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}


def declared_city(location: Column) -> Column:
    """(city, state) of `City, ST` or `city state`, lower-cased; null where no state ends the text.  Longest names first."""
    names = sorted({**{k: k for k in STATES}, **{v: k for k, v in STATES.items()}}.items(), key=lambda x: -len(x[0]))
    pattern = r"^\s*(.+?)[,\s]+(" + "|".join(n for n, _ in names) + r")\.?\s*$"
    low = F.lower(location)
    full = F.create_map(*[F.lit(x) for pair in names for x in pair])
    city, state = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    return F.when(low.rlike(pattern), F.struct(F.rtrim(F.regexp_replace(city, ",", "")).alias("city"), F.element_at(full, state).alias("state")))


def declared_cities(users: DataFrame, least_users: int = 1) -> DataFrame:
    """(user, city, state) of users that declare exactly one city, in cities of at least `least_users` such users."""
    found = users.withColumn("_c", declared_city(F.col("location"))).filter("_c is not null")
    single = found.groupBy("user").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi")).filter("lo = hi").select("user", "lo.city", "lo.state")
    large = single.groupBy("city", "state").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_users)
    return single.join(large.drop("_n"), ["city", "state"], "left_semi").select("user", "city", "state")


def alphabetic_words(grams: DataFrame, least_count: float = 1, least_length: int = 1) -> DataFrame:
    """Words of letters alone, long and frequent enough."""
    return grams.filter((F.col("cnt") >= least_count) & (F.length("gram") >= least_length) & F.col("gram").rlike(r"^\p{L}+$"))


def carry_forward(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Fill gaps of `value` with the last one above it in its file; leading gaps count back from the first: `offset` -n .. -1.

    A file is read in one order, so its rows are gathered by file.
    """
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(group).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = F.last(value, ignorenulls=True).over(upto)
    filled = rows.withColumns({"_seen": seen, "_next": F.first(value, ignorenulls=True).over(after), "_run": F.count(value).over(upto)})
    place = Window.partitionBy(group, "_run").orderBy(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(group, "_run"))
    number = F.row_number().over(place)
    offset = F.when(F.col("_run") == 0, number - size - 1).otherwise(number - 1)
    return filled.withColumns({"offset": offset, value: F.coalesce("_seen", "_next")}).drop("_seen", "_next", "_run")


def matching_text(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows whose text has a match of the pattern anywhere; a null text has none."""
    return rows.filter(F.col(text).rlike(pattern))
