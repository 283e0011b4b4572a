"""Personal data: format-preserving Feistel pseudonyms (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
#: Characters of an IBAN by country: in print, in groups of four, only the length tells where it ends.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _printed(n: int, countries: str) -> str:
    last = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})\d\d(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{last}"


PRINTED_IBAN = "|".join(_printed(n, c) for n, c in IBAN_COUNTRIES.items())
IBAN = rf"(?<!\w)(?=[A-Z]{{2}}\d\d)(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{PRINTED_IBAN})(?!\w)"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w.-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?!\w|[./-]\d)"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\) ?\d{2,4}[ .-]?\d{2,4}(?:[ .-]\d{2,4})?|\+\d{1,3}(?:[ .-]\d{2,9}){1,4}|\+\d{8,15}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\w)"
#: A run of 13 to 19 digits; a blank in it is not followed by another kind of value.
CARD = rf"(?<![\w.-])\d(?: (?!{IP}|{DATE}|{SSN}|{PHONE})\d|-?\d){{12,18}}(?!\w|-\d)"
ANY = "|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, CARD))
#: A text with neither of these holds no value.
HINT = "[0-9@]"
#: 72,900 days from EPOCH on are permuted among themselves (270 * 270), so a recent date stays plausible; all other
#: days of the years 0001 to 9999 (1227 * 2917) among themselves.
EPOCH, NEAR, FAR = "1900-01-01", (270, 270), (1227, 2917)
BEFORE, DAYS = 693_595, 3_652_059


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def feistel(value: Column, a: Column, b: Column, tag: str | Column, key: str) -> Column:
    """Keyed permutation of 0 .. a*b-1, another one for each tag.

    An alternating Feistel network on (value div b, value mod b): each round
    adds a keyed SHA-256 of one half to the other, modulo that half's size.
    """
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def mixed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), tag, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(mixed(i, s["b"]), a), a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(mixed(i, s["a"]), b), b)).alias("b"),
        )

    # `/` is on doubles: the quotient is below 2^53, the dividend may not be, so the result is rounded.
    start = F.struct(F.round((value - F.pmod(value, b)) / b).cast("long").alias("a"), F.pmod(value, b).alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: s["a"] * b + s["b"])


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted(digits: Column, tag: str, key: str) -> Column:
    """Digits of any length up to 36, permuted among those of their length.

    Beyond 18 the last 18 are permuted under a tag with the others, then those
    under a tag with the new last 18.
    """
    powers = F.array(*[_long(10**i) for i in range(10)])

    def part(d: Column, tag: str | Column) -> Column:
        n = F.length(d)
        halves = [F.element_at(powers, (F.ceil(n / 2) + 1).cast("int")), F.element_at(powers, (F.floor(n / 2) + 1).cast("int"))]
        return F.when(n == 0, d).otherwise(F.lpad(feistel(d.cast("long"), *halves, tag, key).cast("string"), n, "0"))

    def long(d: Column) -> Column:
        head, tail = F.substring(d, F.lit(1), F.length(d) - 18), F.substring(d, F.length(d) - 17, F.lit(18))
        return _bound(part(tail, F.concat(F.lit(tag + "/"), head)), lambda t: F.concat(part(head, F.concat(F.lit(tag + "\\"), t)), t))

    return _bound(digits, lambda d: F.when(F.length(d) <= 18, part(d, tag)).otherwise(long(d)))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is the check digit."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _laid_out(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced, one by one."""
    chars = F.transform(
        F.split(form, ""),
        lambda c, i: F.when(
            c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))
        ).otherwise(c),
    )
    return F.array_join(chars, "")


def _card(m: Column, key: str) -> Column:
    """The run itself, if it holds; else the first part of whole groups that does, longest first; the rest stays."""

    def valid(d: Column) -> Column:
        return F.length(d).between(13, 19) & (_luhn(d) % 10 == 0)

    def separator(at: Column) -> Column:
        return F.substring(m, at, F.lit(1)).isin(" ", "-")

    def part(s: Column) -> Column:
        return F.substring(m, s["a"], s["b"] - s["a"] + 1)

    def new(form: Column, d: Column) -> Column:
        inner = F.concat(F.substring(d, 1, 1), _permuted(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        checked = _bound(inner, lambda x: F.concat(x, F.pmod(10 - F.pmod(_luhn(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return _bound(checked, lambda x: _laid_out(form, x))

    def replaced(s: Column) -> Column:
        changed = _bound(part(s), lambda form: _bound(_digits(form), lambda d: new(form, d)))
        return F.concat(F.substring(m, F.lit(1), s["a"] - 1), changed, F.substring(m, s["b"] + 1, F.length(m)))

    n = F.length(m)
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda a: (a == 1) | separator(a - 1))
    stops = F.reverse(F.filter(places, lambda b: (b == n) | separator(b + 1)))
    spans = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(stops, lambda b: b - a >= 12), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    whole = F.struct(F.lit(1).alias("a"), n.alias("b"))
    found = F.when(valid(_digits(m)), whole).otherwise(F.get(F.filter(spans, lambda s: valid(_digits(part(s)))), F.lit(0)))
    return _bound(found, lambda s: F.when(s.isNull(), m).otherwise(replaced(s)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays where it is set off; all further digits are permuted."""
    code = F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1)
    code = F.when((code == "") & m.startswith("+"), F.substring(m, 2, 1)).otherwise(code)

    def new(c: Column) -> Column:
        rest = F.substring(_digits(m), F.length(c) + 1, F.length(m))
        moved = _bound(rest, lambda d: F.when(F.length(d).between(4, 36), _permuted(d, "phone", key)).otherwise(d))
        return _bound(F.concat(c, moved), lambda x: _laid_out(m, x))

    return _bound(code, new)


def _ip(m: Column, key: str) -> Column:
    def value(parts: Column) -> Column:
        return ((parts[0].cast("long") * 256 + parts[1].cast("long")) * 256 + parts[2].cast("long")) * 256 + parts[3].cast("long")

    def dotted(v: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    def new(parts: Column) -> Column:
        good = F.forall(parts, lambda x: x.cast("int") <= 255)
        return F.when(good, _bound(feistel(value(parts), _long(65536), _long(65536), "ip", key), dotted)).otherwise(m)

    return _bound(F.split(m, r"\."), new)


def _ssn(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        area, group, serial = (p[i].cast("long") for i in range(3))
        good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        value = (index * 99 + group - 1) * 9999 + serial - 1

        def shown(v: Column) -> Column:
            i = F.expr("0") + F.floor(v / 9999)
            area = F.floor(i / 99)
            area = F.when(area >= 665, area + 2).otherwise(area + 1)
            return F.concat_ws(
                "-",
                F.lpad(area.cast("string"), 3, "0"),
                F.lpad((F.pmod(i, F.lit(99)) + 1).cast("string"), 2, "0"),
                F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"),
            )

        return F.when(good, _bound(feistel(value, _long(898 * 99), _long(9999), "ssn", key), shown)).otherwise(m)

    return _bound(F.split(m, "-"), new)


def _date(m: Column, key: str, day_first: Column) -> Column:
    """With slashes, the order that `day_first` says; the other one if that gives no date."""

    def formed(pattern: str) -> Column:
        def new(days: Column) -> Column:
            near = days.between(0, NEAR[0] * NEAR[1] - 1)
            count = (days + F.when(days < 0, BEFORE).otherwise(BEFORE - NEAR[0] * NEAR[1])).cast("long")
            far = _bound(
                feistel(count, _long(FAR[0]), _long(FAR[1]), "far-date", key),
                lambda v: F.when(v < BEFORE, v - BEFORE).otherwise(v - BEFORE + NEAR[0] * NEAR[1]),
            )
            moved = F.when(near, feistel(days.cast("long"), _long(NEAR[0]), _long(NEAR[1]), "date", key)).otherwise(far)
            good = days.between(-BEFORE, DAYS - BEFORE - 1)
            return F.when(good, F.date_format(F.date_add(F.lit(EPOCH).cast("date"), moved.cast("int")), pattern)).otherwise(m)

        return _bound(F.datediff(F.try_to_date(m, pattern), F.lit(EPOCH).cast("date")), new)

    days, months = "dd/MM/yyyy", "MM/dd/yyyy"
    by_day = (day_first & F.try_to_date(m, days).isNotNull()) | F.try_to_date(m, months).isNull()
    return (
        F.when(m.contains("-"), formed("yyyy-MM-dd"))
        .when(m.contains("/"), F.when(by_day, formed(days)).otherwise(formed(months)))
        .otherwise(formed("dd.MM.yyyy"))
    )


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and A-Z (10 to 35)."""

    def add(s: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """All digits after the check digits are permuted, in their places, and the check digits made anew; groups of four stay.

    A printed form that fails may still hold a card after its first group.
    """
    grouped = m.contains(" ")

    def new(compact: Column) -> Column:
        country, rest = F.substring(compact, 1, 2), F.substring(compact, F.lit(5), F.length(compact))
        good = _mod97(F.concat(rest, F.substring(compact, 1, 4))) == 1
        moved = _bound(_permuted(_digits(rest), "iban", key), lambda d: _laid_out(rest, d))

        def checked(x: Column) -> Column:
            check = 98 - _mod97(F.concat(x, country, F.lit("00")))
            made = F.concat(country, F.lpad(check.cast("string"), 2, "0"), x)
            return F.when(grouped, F.regexp_replace(made, "(.{4})(?=.)", "$1 ")).otherwise(made)

        after = F.substring(m, F.lit(6), F.length(m))
        kept = F.when(grouped & after.rlike(f"^(?:{CARD})$"), F.concat(F.substring(m, 1, 5), _card(after, key))).otherwise(m)
        return F.when(good, _bound(moved, checked)).otherwise(kept)

    return _bound(F.replace(m, F.lit(" "), F.lit("")), new)


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 12), F.lit("@pseudonym.invalid"))


def pseudonym(m: Column, key: str, day_first: Column) -> Column:
    """The pseudonym of one matched value; the value itself if it isn't valid in its format."""
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(f"^(?:{IBAN})$"), _iban(m, key))
        .when(m.rlike(f"^(?:{IP})$"), _ip(m, key))
        .when(m.rlike(f"^(?:{DATE})$"), _date(m, key, day_first))
        .when(m.rlike(f"^(?:{SSN})$"), _ssn(m, key))
        .when(m.rlike(f"^(?:{PHONE})$"), _phone(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymize(
    docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, lang_col: str = "lang"
) -> DataFrame:
    """Replace personal values in `text_col` by keyed pseudonyms of their own format.

    Card numbers (Luhn), IBANs (mod 97), IPv4 addresses (octets), US social
    security numbers, phone numbers and calendar dates (0001-01-01 to
    9999-12-31) are permuted within their format by a Feistel network keyed
    with `key`: check digits hold again, separators stay, and equal values get
    equal pseudonyms in every document, however they are laid out.  An e-mail
    address has no fixed format: it becomes a keyed hash under `.invalid`.
    Numbers that fail validation stay as they are, as does a phone number of
    fewer than 4 digits after its country code.

    An IBAN may be printed in groups of four.  Of 03/04/1990 the month comes
    first in English and where `lang_col` is null or missing, else the day; a
    date that only the other order allows is read in that one.  A card may have
    further groups of digits before or after it within a run of 19.

    A null text stays null; texts without digits and @ are untouched; rows,
    order of columns and all other columns stay; `count_col` adds the number of
    values that changed.
    """
    text = F.col(text_col)
    hint = text.rlike(HINT)
    found = F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    columns = docs.columns
    english = F.lower(F.col(lang_col).cast("string")).startswith("en") if lang_col in columns else F.lit(True)
    day_first = ~F.coalesce(english, F.lit(True))
    values, changed = fresh(docs, "_found", "_new")
    out = docs.withColumn(values, found)
    out = out.withColumn(changed, F.when(F.size(values) > 0, F.transform(values, lambda m: pseudonym(m, key, day_first))))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), changed, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    any_new = F.col(changed).isNotNull()
    more = []
    if count_col:
        differs = F.size(F.filter(F.zip_with(values, changed, lambda x, y: x != y), lambda x: x))
        more.append(F.when(any_new, differs).otherwise(0).cast("long").alias(count_col))
    kept = [F.when(any_new, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns if c != count_col]
    return out.select(*kept, *more)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced, and how many were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return pseudonymize(docs, "op8-demo-key", count_col="n_values").drop("lang")
