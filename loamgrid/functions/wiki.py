"""Wiki and HTML text: coordinates, links, plain text, metadata."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def html_text(page: Column) -> Column:
    """Visible words of an HTML page: scripts, styles and comments go, tags become blanks, entities characters."""
    bare = F.regexp_replace(page, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))


def balanced(text: str, left: str, right: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of the outermost balanced brackets of a text."""
    depth, start, i = 0, 0, 0
    while i < len(text):
        if text.startswith(left, i):
            if depth == 0:
                start = i
            depth += 1
            i += len(left)
        elif depth and text.startswith(right, i):
            depth -= 1
            i += len(right)
            if depth == 0:
                yield start, i
        else:
            i += 1


def without(text: str, left: str, right: str) -> str:
    out, at = [], 0
    for a, b in balanced(text, left, right):
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


def template_fields(body: str) -> tuple[str, list[str], dict[str, str]]:
    """(name, positional, named) of the inside of a template; bars in inner links and templates don't split."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = depth - 1, i + 2
        else:
            if body[i] == "|" and depth == 0:
                parts.append(body[last:i])
                last = i + 1
            i += 1
    parts.append(body[last:])
    named, positional = {}, []
    for p in parts[1:]:
        key, eq, value = p.partition("=")
        if eq:
            named[key.strip().lower()] = value.strip()
        else:
            positional.append(p.strip())
    return parts[0].strip().lower(), positional, named


def _number(text: str | None) -> float | None:
    try:
        return float((text or "").replace(",", ".").replace("−", "-"))
    except ValueError:
        return None


#: Letters of the directions in the languages read: fixed values.
SIGNS = {"n": 1, "s": -1, "e": 1, "w": -1, "o": 1}
#: Parameter names of latitude and longitude in info boxes: fixed values.
LATITUDE = ("latitude", "lat", "breitengrad", "latitud", "lat_deg", "latd", "lat_d")
LONGITUDE = ("longitude", "long", "längengrad", "longitud", "lon", "lon_deg", "longd", "long_d")


def dms(degrees: float, minutes: float = 0.0, seconds: float = 0.0, direction: str = "n") -> float:
    sign = SIGNS.get(direction.lower()[:1], 1) * (-1 if degrees < 0 else 1)
    return sign * (abs(degrees) + minutes / 60 + seconds / 3600)


def _positional(values: list[str]) -> tuple[float, float] | None:
    """Degrees with up to two parts and a letter, twice; or two plain numbers."""
    found, group = [], []
    for v in values:
        n = _number(v)
        if n is not None:
            group.append(n)
        elif v.lower() in SIGNS and group:
            found.append(dms(*group[:3], *[0.0] * (3 - len(group[:3])), v))
            group = []
        elif v:
            break
        if len(found) == 2:
            return found[0], found[1]
    return (group[0], group[1]) if not found and len(group) >= 2 else None


def page_coordinate(text: str) -> tuple[float, float] | None:
    """The first coordinate of a page's coordinate or info-box templates."""
    for a, b in balanced(text, "{{", "}}"):
        name, positional, named = template_fields(text[a + 2 : b - 2])
        if name.startswith(("coord", "coor", "geo")) or name in ("koordinate", "coordenadas"):
            found = _positional(positional)
            if found is None and "ns" in named and "ew" in named:
                found = _positional([*named["ns"].split("/"), *named["ew"].split("/")])
            if found:
                return found
        values = []
        for keys, minutes, seconds, side in (
            (LATITUDE, ("latm", "lat_m", "lat_min"), ("lats", "lat_s", "lat_sec"), ("latns", "lat_ns", "lat_dir")),
            (LONGITUDE, ("longm", "long_m", "lon_min"), ("longs", "long_s", "lon_sec"), ("longew", "long_ew", "lon_dir")),
        ):
            degree = next((n for k in keys if (n := _number(named.get(k))) is not None), None)
            if degree is None:
                break
            m, s = (next((n for k in ks if (n := _number(named.get(k))) is not None), 0.0) for ks in (minutes, seconds))
            values.append(dms(degree, m, s, next((named[k] for k in side if named.get(k)), "n")))
        if len(values) == 2:
            return values[0], values[1]
        inner = page_coordinate(text[a + 2 : b - 2])
        if inner:
            return inner
    return None


_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")


def page_links(text: str) -> list[tuple[str, str]]:
    """(target, anchor) of the links to main-namespace pages; sections are cut off, the target's first letter is capital."""
    out = []
    for target, anchor in _LINK.findall(text):
        page = target.split("#")[0].replace("_", " ").strip()
        if page and ":" not in page:
            out.append((page[0].upper() + page[1:], (anchor or target).strip()))
    return out


def plain_text(text: str) -> str:
    """Useful text of wiki markup: comments, references, tables, templates and marks go, links keep their anchors."""
    text = re.sub(r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>|<(math|nowiki|gallery)\b.*?</\1>", " ", text)
    text = without(without(text, "{{", "}}"), "{|", "|}")
    text = re.sub(r"(?i)\[\[(?:file|image|category|datei|bild|kategorie|archivo|imagen|categoría)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", " ", text)
    text = _LINK.sub(lambda m: m[2] or m[1], text)
    text = re.sub(r"\[https?://\S+ ?([^\]]*)\]", r"\1", text)
    text = re.sub(r"<[^>]+>|'{2,}|^[=*#:;]+|=+\s*$|__[A-Z]+__", " ", text, flags=re.M)
    return " ".join(html.unescape(text).split())


def toponym_data(text: str, reach: int = 10) -> list[tuple[str, str, str]]:
    """(anchor, target, context): each link as a gold place name, with the words about it."""
    out = []
    for m in _LINK.finditer(text):
        page = m[1].split("#")[0].strip()
        if page and ":" not in page:
            left, right = plain_text(text[: m.start()]).split()[-reach:], plain_text(text[m.end() :]).split()[:reach]
            out.append(((m[2] or m[1]).strip(), page[0].upper() + page[1:], " ".join([*left, "_", *right])))
    return out


def _texts(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def coordinates(text: pd.Series) -> pd.DataFrame:
    found = [page_coordinate(t) if t else None for t in text]
    return pd.DataFrame([x or (None, None) for x in found], columns=["lat", "lon"], dtype=float)


@F.pandas_udf(_texts("target", "anchor"))
def links(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"target": a, "anchor": b} for a, b in page_links(t)] if t else [])


@F.pandas_udf(T.StringType())
def useful_text(text: pd.Series) -> pd.Series:
    return text.map(plain_text, na_action="ignore")


@F.pandas_udf(_texts("anchor", "target", "context"))
def toponyms(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("anchor", "target", "context"), x, strict=True)) for x in toponym_data(t)] if t else [])


def article_flags(title: Column, text: Column) -> dict[str, Column]:
    """namespace, is_list_of, is_disambig and is_list of a page."""
    space = F.when(title.contains(":"), F.substring_index(title, ":", 1)).otherwise("Main")
    list_of = F.lower(title).startswith("list of ")
    ambiguous = F.coalesce(F.lower(text).rlike(r"\{\{\s*(?:disambig\w*|begriffsklärung|desambiguación|homonymie)\b"), F.lit(False))
    return {"namespace": space, "is_list_of": list_of, "is_disambig": ambiguous, "is_list": list_of | ambiguous}


def add_coordinates(xml: Column, tag: str = "place") -> Column:
    """lat and lon attributes after the tag's name; columns `lat` and `lon` hold them."""
    return F.regexp_replace(xml, f"<{tag}(?=[\\s>])", F.concat(F.lit(f"<{tag} lat=\""), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"')))
