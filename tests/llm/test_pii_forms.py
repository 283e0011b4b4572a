"""Layouts of cards, dates and IBANs in running text."""

import re

from loamgrid.llm import pii


def replaced(spark, texts, lang="en"):
    table = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "i int, text string, lang string")
    return [r.text for r in sorted(pii.pseudonymize(table, "key").collect())]


def test_card_beside_other_digits(spark):
    texts = ["4111 1111 1111 1111.", "card 4111 1111 1111 1111 12/27", "4111111111111111 123", "no 12 4111-1111-1111-1111 ok",
             "4111 1111 1111 1111 12/31/1990", "4111 1111 1111 1112 34"]
    got = replaced(spark, texts)
    card = got[0][:-1]
    joined = card.replace(" ", "")
    assert card != "4111 1111 1111 1111"
    assert got[1] == f"card {card} 12/27" and got[2] == f"{joined} 123" and got[3] == f"no 12 {card.replace(' ', '-')} ok"
    assert got[4].startswith(f"{card} ") and not got[4].endswith("12/31/1990")
    assert got[5] == texts[5]


def test_dates_with_the_day_first(spark):
    texts = ["31/12/1990", "31.12.1990", "03/04/1990", "03.04.1990", "04.03.1990", "12/31/1990", "31/31/1990"]
    for lang in ("en", "de", None):
        got = replaced(spark, texts, lang)
        assert got[0] == got[1].replace(".", "/") != texts[0]
        assert got[2] == got[3 if lang == "de" else 4].replace(".", "/") if lang == "de" else got[2] != texts[2]
        month, day, year = got[5].split("/")
        assert [day, month, year] == got[1].split(".") and got[6] == texts[6]
        if lang != "de":
            day, month, year = got[4].split(".")
            assert got[2] == f"{month}/{day}/{year}"


def test_printed_ibans(spark):
    texts = ["DE89370400440532013000", "to DE89 3704 0044 0532 0130 00 or", "BE68 5390 0754 7034 4111 1111 1111 1111", "DE89 3704 0044 0532 0130 02",
             "GB82 WEST 1234 5698 7654 32, 1990-12-31", "DE12 4111 1111 1111 1111 12"]
    got = replaced(spark, texts)
    printed = re.sub("(.{4})(?=.)", r"\1 ", got[0])
    assert got[0] != texts[0] and got[1] == f"to {printed} or" and got[3] == texts[3]
    belgian, card = got[2][:19], got[2][20:]
    assert belgian.startswith("BE") and belgian != texts[2][:19] and card != "4111 1111 1111 1111" and re.fullmatch(r"4\d{3}( \d{4}){3}", card)
    for x in (belgian, got[4].split(",")[0]):
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert got[4].startswith("GB") and " WEST " in got[4] and "1990-12-31" not in got[4] and "5698" not in got[4]
    assert got[5] == f"DE12 {card} 12"
