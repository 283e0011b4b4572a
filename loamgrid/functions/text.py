"""Columns on text: tokenizers, n-grams, table escapes, titles."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = "-LINK-"

# --- tokenizers -----------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-cased runs of letters of any script, with their combining marks; the plain tokenizer of the query suite."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), "")


def split_keeping(text: Column, pattern: str) -> Column:
    """Pieces and delimiters in their order; no empty pieces."""
    return F.filter(F.split(text, f"(?={pattern})|(?<={pattern})"), lambda w: w != "")


def split_words(text: Column) -> Column:
    """White-space tokens with closing punctuation and opening brackets or quotes set apart."""
    apart = F.regexp_replace(text, r"([,;.\"):]+)(?=\s|$)", " $1")
    apart = F.regexp_replace(apart, r"(^|\s)([(\"]+)(?=\S)", "$1$2 ")
    return F.filter(F.split(apart, r"\s+"), lambda w: w != "")


#: What a short message keeps whole, in the order it is tried; anything else is a run of letters or one mark.
SHORT_TEXT = "|".join(
    (
        r"(?:https?://|www\.)[^\s<>\"]+",  # addresses
        r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
        r"&(?:[A-Za-z]+|#\d+);",  # entities
        r"[@#]\w+",
        r"[<>]?[:;=8xX][-o*']?[)\](\[dDpPoO/\\|@3]+(?!\w)|[)\](\[/\\|][-o*']?[:;=8](?!\w)|<3+|\^[_.]*\^",  # faces
        r"\d{1,2}:\d\d(?::\d\d)?(?:\s?[apAP]\.?[mM]\b\.?)?",  # times
        r"[$€£]?\d+(?:[.,]\d+)*%?",  # numbers
        r"(?:[A-Za-z]\.){2,}",  # abbreviations
        r"[^\W\d_]+(?=n't\b)|n't\b|'(?:s|m|re|ve|ll|d|t)\b",  # contractions
        r"[^\W\d_]+(?:[-'][^\W\d_]+)*?(?=n't\b|'(?:s|m|re|ve|ll|d|t)\b)",
        r"\w+(?:-\w+)*",
        r"([.!?,;:~*=_-])\1*",  # runs of one mark
        r"\S",
    )
)


def short_text_tokens(text: Column, fold: bool = False) -> Column:
    """Tokens of a short message: links, faces, times, numbers and entities stay whole, contractions are split."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SHORT_TEXT), F.lit(0))
    return F.transform(found, lambda w: F.lower(w)) if fold else found


def normalize_word(word: Column) -> Column:
    lowered = F.lower(word)
    return F.when(lowered.contains("http://") | lowered.contains("https://"), LINK).otherwise(lowered)


def ngrams(tokens: Column, longest: int, shortest: int = 1) -> Column:
    """All n-grams of `shortest` to `longest` tokens, as arrays; shorter ones first."""

    def of(n: int) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(none)
        return F.transform(starts, lambda i: F.slice(tokens, i, n))

    return F.flatten(F.array(*[of(n) for n in range(shortest, longest + 1)]))


def tag_ngrams(tag: Column, longest: int) -> Column:
    """n-grams of 1 to `longest` words of a tag, shorter ones first, each an array.

    Words lie between runs of white space and are normalized.  A tag with fewer
    words than n gives all of its words as its one n-gram; a null tag gives null.
    """
    parts = F.transform(F.split(F.regexp_replace(tag, r"(?<=\S)\s+$", ""), r"\s+"), normalize_word)

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: F.slice(parts, i, n))

    return F.when(tag.isNotNull(), F.flatten(F.array(*[of(n) for n in range(1, longest + 1)])))


def pretty_json(value: Column) -> Column:
    """Struct, map or array as JSON over several lines."""
    return F.to_json(value, {"pretty": "true"})


def without_link_grams(grams: Column) -> Column:
    """Drop grams that start or end with a link or are links alone."""
    return F.filter(grams, lambda g: (g[0] != LINK) & (F.element_at(g, -1) != LINK))


# --- escapes of the table format ----------------------------------------------------

_ESCAPES = {"%": "%25", "\t": "%09", "\n": "%0A", "\r": "%0D", "\f": "%0C"}


def _encode(text: Column, more: dict[str, str]) -> Column:
    out = text
    for raw, code in (_ESCAPES | more).items():
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def _decode(text: Column, more: dict[str, str]) -> Column:
    out = text
    for raw, code in reversed((_ESCAPES | more).items()):  # the percent sign comes last
        out = F.replace(out, F.lit(code), F.lit(raw))
    return out


def encode_field(text: Column) -> Column:
    return _encode(text, {})


def decode_field(text: Column) -> Column:
    return _decode(text, {})


def encode_word(word: Column) -> Column:
    return _encode(word, {":": "%3A", " ": "%20"})


def decode_word(word: Column) -> Column:
    return _decode(word, {":": "%3A", " ": "%20"})


#: A null item, and a list of one empty item (nothing is the empty list); encoded text holds neither.
_NO_ITEM, _EMPTY_ITEM = "%N", "%E"


def encode_sequence(items: Column) -> Column:
    shown = F.transform(items, lambda x: F.coalesce(_encode(x, {">": "%3E"}), F.lit(_NO_ITEM)))
    return F.when((F.size(items) == 1) & (F.get(items, F.lit(0)) == ""), _EMPTY_ITEM).otherwise(F.array_join(shown, ">>"))


def decode_sequence(text: Column) -> Column:
    parts = F.transform(F.split(text, ">>", -1), lambda x: _decode(F.nullif(x, F.lit(_NO_ITEM)), {">": "%3E"}))
    return F.when(text == "", F.array().cast("array<string>")).when(text == _EMPTY_ITEM, F.array(F.lit(""))).otherwise(parts)


def encode_counts(counts: Column) -> Column:
    """`word:count` pairs of a map, the greatest count first, then by word; a null count is empty."""
    return encode_pairs(F.map_entries(counts), "key", "value")


def encode_pairs(entries: Column, word: str = "gram", number: str = "cnt") -> Column:
    """`encode_counts` of an array of (word, number)."""
    pairs = F.transform(entries, lambda e: F.struct((-e[number]).alias("n"), e[word].alias("w")))
    count = lambda p: F.coalesce((-p["n"]).cast("string"), F.lit(""))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encode_word(p["w"]), F.lit(":"), count(p))), " ")


def decode_counts(text: Column) -> Column:
    """Map of `word:count` pairs; what follows the last colon is the count, so n-grams `a:b:2` keep `a:b`."""
    pairs = F.filter(F.split(text, " "), lambda p: p != "")
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            decode_word(F.regexp_extract(p, "^(.*):[^:]*$", 1)), F.regexp_extract(p, "([^:]*)$", 1).try_cast("int")
        ),
    )
    return F.map_from_entries(entries)


def decode_gram(text: Column) -> Column:
    return F.transform(F.split(text, ":"), decode_word)


def encode_string_map(pairs: Column) -> Column:
    entries = F.transform(F.map_entries(pairs), lambda e: F.concat(encode_word(e["key"]), F.lit(":"), encode_word(e["value"])))
    return F.array_join(F.array_sort(entries), " ")


def decode_string_map(text: Column) -> Column:
    pairs = F.filter(F.split(text, " "), lambda p: p != "")
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(decode_word(F.substring_index(p, ":", 1)), decode_word(F.substring_index(p, ":", -1))))
    )


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no")


def parse_yes_no(text: Column) -> Column:
    return F.when(text == "yes", True).when(text == "no", False)


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- titles and words ---------------------------------------------------------------


def capfirst(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def pluralize(word: Column) -> Column:
    """English plural: -y after a consonant, sibilants, else -s; capitals are kept in an all-capital word."""
    plural = (
        F.when(word.rlike("(?i)[^aeiou]y$"), F.regexp_replace(word, "(?i)y$", "ies"))
        .when(word.rlike("(?i)(?:ch|sh|s|x|z)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(plural)).otherwise(plural)


def short_title(title: Column) -> Column:
    """`A, B` and `A (B)` without the second part."""
    return F.regexp_extract(title, r"^(.*?)(?:,\s.*|\s*\([^)]*\))?$", 1)


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """Named and numeric character entities; Spark has no such function."""
    return text.map(html.unescape, na_action="ignore")


def significant(number: Column, digits: int = 4) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(number))))
    return F.when(number == 0, 0.0).otherwise(F.round(number * scale) / scale)


def with_commas(number: Column, decimals: int = 0) -> Column:
    return F.format_number(number, decimals)


def contains_sequence(tokens: Column, wanted: list[str]) -> Column:
    """Whether `wanted` occurs in `tokens` as neighbours."""
    if len(wanted) == 1:
        return F.array_contains(tokens, wanted[0])
    mark = "\u0001"
    inner = F.concat(F.lit(mark), F.array_join(tokens, mark), F.lit(mark))
    return inner.contains(mark + mark.join(wanted) + mark)
