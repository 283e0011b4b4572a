"""Operators on small tables with results worked out by hand or by brute force."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import geo, text, times, wiki
from loamgrid.operators import evaluation, filters, grids, grouping, learning, models, ranking, rows, wordstats
from loamgrid.sources import files, sinks, textdb


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# --- functions ------------------------------------------------------------------------


@pytest.mark.parametrize("raw", ["a:b c%d>>e", "", "tab\tand\nline", "%25", "%3A: >"])
def test_escapes_round_trip(spark, raw):
    x = F.lit(raw)
    got = one(
        spark,
        f=text.decode_field(text.encode_field(x)),
        w=text.decode_word(text.encode_word(x)),
        s=text.decode_sequence(text.encode_sequence(F.array(x, F.lit("z>"), x))),
        plain=text.encode_word(x),
    )
    assert got.f == raw and got.w == raw and got.s == [raw, "z>", raw]
    assert ":" not in got.plain and " " not in got.plain


def test_count_maps(spark):
    got = one(spark, s=text.encode_counts(F.create_map(F.lit("a:b"), F.lit(2), F.lit("c"), F.lit(5))), m=text.decode_counts(F.lit("c:5 a%3Ab:2 x:y:3")))
    assert got.s == "c:5 a%3Ab:2"
    assert got.m == {"c": 5, "a:b": 2, "x:y": 3}


def test_ngrams(spark):
    got = one(spark, g=text.ngrams(F.array(*map(F.lit, "abc")), 2), few=text.ngrams(F.array(F.lit("a")), 3))
    assert got.g == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]]
    assert got.few == [["a"]]


def test_times():
    day = 86_400_000
    assert times.parse_time_offset("3w2d12h") == (23 * 24 + 12) * 3_600_000
    assert times.parse_time_offset("5h-2m") == 298 * 60_000
    assert times.parse_time_offset("-1.5d") == -day * 3 // 2
    assert times.parse_date("19700102") == day
    assert times.parse_interval("19700103/-1d") == (day, 2 * day)
    with pytest.raises(ValueError):
        times.parse_time_offset("3x")


def test_distance(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = one(spark, a=geo.distance_km(*lit(0, 0, 0, 90)), same=geo.distance_km(*lit(12.3, 45.6, 12.3, 45.6)), none=geo.distance_km(F.lit(None).cast("double"), *lit(0, 0, 0)), mid=geo.average_longitude(*lit(170, -170)))
    assert got.a == pytest.approx(6376.774 * math.pi / 2)
    assert got.same == pytest.approx(0, abs=1e-3) and got.none == 1_000_000 and abs(got.mid) == 180


def test_polygon(spark):
    ring = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    points = spark.createDataFrame([(5.0, 5.0), (5.0, 15.0), (-1.0, 5.0), (9.9, 0.1), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in points.select(geo.in_polygon(F.col("lat"), F.col("lon"), ring)).collect()] == [True, False, False, True, False]


def test_wiki_text():
    page = "{{Infobox|name=X|lat_deg=30|lat_min=30|latns=S|lon_deg=10|longew=W}} '''X''' is in [[austin#parks|Austin]].<ref>no</ref> [[File:a.png|thumb]] {{a|{{b}}}} end"
    assert wiki.page_coordinate(page) == (-30.5, -10.0)
    assert wiki.page_coordinate("{{coord|41|30|N|2|15|36|E|display=title}}") == (41.5, pytest.approx(2.26))
    assert wiki.page_coordinate("no place") is None
    assert wiki.page_links(page) == [("Austin", "Austin")]
    assert wiki.plain_text(page) == "X is in Austin. end"
    assert wiki.toponym_data("near [[Paris]] now")[0] == ("Paris", "Paris", "near _ now")


# --- grids ----------------------------------------------------------------------------


def test_regular_cells(spark):
    grid = grids.RegularGrid(0.14)
    points = [(0.0, 175.0), (90.0, 180.0), (-90.0, -180.0), (89.999, 179.999)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = df.select(*[c.alias(n) for n, c in zip("rc", grid.cell(F.col("lat"), F.col("lon")), strict=True)]).collect()
    assert got[0].c == 1250  # 175 / 0.14 is just below
    one_degree = grids.RegularGrid(1.0)
    got = [tuple(r) for r in df.select(*one_degree.cell(F.col("lat"), F.col("lon"))).collect()]
    assert got == [(0, 175), (89, -180), (-90, -180), (89, 179)]
    got = df.select(*one_degree.parent(F.lit(-3), F.lit(5))).first()
    assert tuple(got) == (-2, 2)


@pytest.mark.parametrize("method", ["halfway", "median", "maxmargin"])
def test_kd_tree_against_recursion(spark, method):
    rng = np.random.default_rng(5)
    points = [(float(a), float(b)) for a, b in np.round(rng.normal(size=(300, 2)) * [10, 25], 1)] + [(1.0, 1.0)] * 40

    def build(part, path=""):
        if len(part) <= 30:
            return {path: len(part)}
        spans = [max(p[i] for p in part) - min(p[i] for p in part) for i in (0, 1)]
        axis = 1 if spans[1] > spans[0] else 0
        v = sorted(p[axis] for p in part)
        if v[0] == v[-1]:
            return {path: len(part)}
        if method == "halfway":
            at = (v[0] + v[-1]) * 0.5
        elif method == "median":
            at = float(np.median(v))
        else:
            gaps = [b - a for a, b in zip(v, v[1:])]
            i = gaps.index(max(gaps))
            at = v[i] + 0.5 * gaps[i]
        if at == v[-1]:
            at = v[0]
        return build([p for p in part if p[axis] <= at], path + "L") | build([p for p in part if p[axis] > at], path + "R")

    df = spark.createDataFrame(points, "lat double, lon double")
    nodes = grids.grow_kd(df, 30, method)
    got = {r[0]: r[1] for r in df.groupBy(grids.kd_path(nodes).alias("p")).count().collect()}
    assert got == build(points)
    up = df.select(F.explode(grids.kd_ancestors(grids.kd_path(nodes))).alias("n")).filter("n = ''").count()
    assert up == len(points)


def test_kd_interpolation(spark):
    grams = spark.createDataFrame([("", "a", 4.0), ("", "b", 2.0), ("L", "a", 4.0), ("R", "b", 2.0)], "path string, gram string, cnt double")
    got = {(r.path, r.gram): r.cnt for r in grids.kd_interpolate(grams, 0.5, 1).collect()}
    assert got == {("", "a"): 4, ("", "b"): 2, ("L", "a"): 4, ("L", "b"): 1, ("R", "b"): 2, ("R", "a"): 2}


# --- models ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["dirichlet:10", "jelinek-mercer:0.3", "pseudo-good-turing"])
def test_probabilities_sum_to_one(spark, kind):
    docs = spark.createDataFrame([(0, "a a b"), (1, "b c c d e")], "doc_id long, text string")
    grams = models.gram_counts(docs, ["doc_id"], F.split("text", " "))
    stats, smoothing = models.global_probs(grams), models.Smoothing.parse(kind)
    sums = models.totals(grams, ["doc_id"], smoothing, stats).drop("types")
    every = sums.crossJoin(stats.select("gram", "g")).join(grams, ["doc_id", "gram"], "left")
    p = models.probability(F.col("cnt"), F.col("total"), F.col("u"), F.col("g"), F.col("big_u"), smoothing.interpolate)
    for r in every.groupBy("doc_id").agg(F.sum(p).alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_backoff_scores_against_every_word(spark):
    """The sparse scores under back-off smoothing against a loop over all words."""
    rng = random.Random(4)
    train = [(i, f"c{i % 3}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12)))) for i in range(12)]
    test = [(i, " ".join(rng.choice("abcdefghz") for _ in range(6))) for i in range(4)]
    df = spark.createDataFrame(train, "doc_id long, cell string, text string")
    grams = models.gram_counts(df, ["doc_id", "cell"], F.split("text", " "))
    stats, cell_grams = models.global_probs(grams), models.merged(grams, ["cell"])
    tests = models.gram_counts(spark.createDataFrame(test, "doc long, text string"), ["doc"], F.split("text", " "))
    cells = df.groupBy("cell").agg(F.count(F.lit(1)).alias("n_docs"), F.lit(1.0).alias("salience"))
    smoothing = models.Smoothing.parse("pseudo-good-turing")
    got = {(r.doc, r.cell): r for r in ranking.scores(tests, cell_grams, cells, stats, smoothing, ["naive-bayes", "partial-kl-divergence", "average-cell-probability"], "num-docs").collect()}

    all_words = Counter(w for *_, t in train for w in t.split())
    g = {w: n / sum(all_words.values()) for w, n in all_words.items()}

    def model(words):
        c, n = Counter(words), len(words)
        u = min(0.5, max(1, sum(v == 1 for v in c.values())) / n)
        big = 1 - sum(g.get(w, 0) for w in c)
        return lambda w: c[w] / n * (1 - u) if c[w] else (u * g.get(w, 0) / big if big > 0 else 0), c

    held = {k: model([w for _, c, t in train if c == k for w in t.split()])[0] for k in ("c0", "c1", "c2")}
    for doc, t in test:
        p, c = model(t.split())
        acp = {k: sum(n * held[k](w) / s for w, n in c.items() if (s := sum(h(w) for h in held.values()))) for k in held}
        whole = sum(acp.values())
        for k, q in held.items():
            nb = 0.5 * sum(n * math.log(q(w)) for w, n in c.items() if q(w) > 0) + 0.5 * math.log(1 / 3)
            kl = sum(p(w) * math.log(p(w) / q(w)) for w in c if q(w) > 0)
            assert got[doc, k].naive_bayes == pytest.approx(nb)
            assert got[doc, k].partial_kl_divergence == pytest.approx(-kl)
            assert got[doc, k].average_cell_probability == pytest.approx(acp[k] / whole)


def test_word_weights_and_copies(spark):
    raw = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "gram string, weight double")
    assert {r.gram: r.weight for r in models.word_weights(raw).collect()} == {"a": 0.5, "b": 1.5}
    grams = spark.createDataFrame([("k", "a", 2.0)], "key string, gram string, cnt double")
    assert sorted(r.gram for r in models.with_domain_copies(grams, F.lit("x")).collect()) == ["a", "a_x"]
    pruned = models.prune(spark.createDataFrame([("k", "a", 2.0), ("k", "b", 1.0), ("k", "c", 1.0)], "key string, gram string, cnt double"), ["key"], 2)
    assert {r.gram: r.cnt for r in pruned.collect()} == {"a": 2, models.OOV: 2}


# --- ranking and evaluation -------------------------------------------------------------


def test_ranks_and_reranking(spark):
    scored = spark.createDataFrame([(0, c, s) for c, s in zip("abcd", (4.0, 3.0, 3.0, 1.0), strict=True)], "doc long, cell string, score double")
    ranked = ranking.ranked(scored, "score")
    assert [r.cell for r in ranked.orderBy("rank").collect()] == list("abcd")
    fresh = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0)], "doc long, cell string, new_score double")
    again = ranking.rerank(ranked, fresh, 2)
    assert [r.cell for r in again.orderBy("rank").collect()] == list("bacd")
    few = ranking.rerank(ranked.filter("rank <= 2"), fresh, 2)  # no others
    assert [r.cell for r in few.orderBy("rank").collect()] == list("ba")
    truth = spark.createDataFrame([(0, "d"), (1, "a")], "doc long, correct_cell string")
    assert {r.doc: r.correct_rank for r in evaluation.correct_rank(ranked, truth).collect()} == {0: 4, 1: evaluation.NO_RANK}
    train = learning.rerank_training(ranked, truth.filter("doc = 0"), 2).orderBy("rank").collect()
    assert [(r.cell, r.correct) for r in train] == [("a", False), ("d", True)]


def test_beam_keeps_the_best_child(spark):
    coarse = spark.createDataFrame([(0, "A", 0.0), (0, "B", -1.0), (0, "C", -9.0)], "doc long, cell string, score double")
    fine = spark.createDataFrame([(0, "A1", "A", -5.0), (0, "A2", "A", -4.0), (0, "B1", "B", -1.0), (0, "C1", "C", 9.0)], "doc long, cell string, parent string, score double")
    got = ranking.beam_search([coarse, fine], 2).orderBy("rank").collect()
    assert [(r.cell, r.score) for r in got] == [("B1", -2.0), ("A2", -4.0)]


def test_mean_shift_finds_the_dense_place(spark):
    points = [(0, 10.0, 10.0), (0, 10.1, 10.0), (0, 10.0, 10.1)]
    got = ranking.mean_shift(spark.createDataFrame(points, "doc long, lat double, lon double"), 1000.0).first()
    assert (got.lat, got.lon) == (pytest.approx(10.033, abs=0.01), pytest.approx(10.033, abs=0.01))


def test_toponyms(spark):
    titles = spark.createDataFrame([(1, "Tucson, Arizona", 9.0), (2, "Tucson (band)", 3.0), (3, "Paris", 50.0)], "id long, title string, salience double")
    names = ranking.toponym_candidates(titles, text.short_title(F.col("title")))
    tokens = spark.createDataFrame([(0, "Tucson", 2.0), (0, "Paris", 1.0), (0, "the", 9.0)], "doc long, token string, cnt double")
    assert [(r.name, r.id) for r in ranking.common_toponym(tokens, names).orderBy("rank").collect()] == [("tucson", 1), ("tucson", 2)]


def test_ranges_and_comparison(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(evaluation.range_label(F.col("x"), (0, 0.5, 1))).collect()] == [0, 0.5, 1, None]
    logs = spark.createDataFrame([("f", "Mean error distance = 12.5 km"), ("f", "median: 3"), ("f", "nothing")], "file string, value string")
    assert sorted((r.measure, r.km) for r in evaluation.log_results(logs).collect()) == [("mean", 12.5), ("median", 3.0)]


# --- events ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def posts(spark):
    data = [
        (1, "ann", 1000, "the hillary clinton show", 10.0, 20.0, "en", 5),
        (2, "ann", 2000, "bill said", None, None, "", 7),
        (3, "bob", 3000, "clinton and bill", -95.0, 0.0, "de", 1),
        (4, "ann", 2000, "AND so on", 30.0, 40.0, "fr", 2),
    ]
    return spark.createDataFrame(data, "id long, user string, ts long, text string, lat double, lon double, lang string, followers int")


@pytest.mark.parametrize(
    ("expression", "ids"),
    [
        ("hillary OR bill AND said", {1, 2}),
        ("(hillary OR bill) AND clinton", {1, 3}),
        ("NOT bill", {1, 4}),
        ("NOT bill AND clinton", {1}),
        ("hillary clinton", {1}),
        ("clinton hillary", set()),
        ('"AND"', {4}),
        ("LOCATION EXISTS", {1, 4}),
        ("LOCATION WITHIN (0, 0, 20, 30)", {1}),
        ("TIME > 19700101 OR bill", {1, 2, 3, 4}),
        ('TIME WITHIN "19700101/2s"', {1}),
        ("TIME WITHIN (19700101 19700102)", {1, 2, 3, 4}),
    ],
)
def test_filter_language(posts, expression, ids):
    tokens = posts.withColumn("tokens", F.split("text", " "))
    assert {r.id for r in tokens.filter(filters.parse_filter(expression, tokens)).collect()} == ids


@pytest.mark.parametrize("bad", ["", "a AND", "(a", "TIME ? 3", "LOCATION WITHIN (1, 2)", "a )"])
def test_filter_language_rejects(posts, bad):
    with pytest.raises(ValueError):
        filters.parse_filter(bad, posts)


def test_merge_does_not_depend_on_order(spark, posts):
    data = posts.collect()
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, posts.schema).repartition(seed + 1)
        r = grouping.merge_events(df, F.col("user")).filter("key = 'ann'").first()
        seen.add((r.id, r.user, r.min_ts, r.max_ts, tuple(r.text), r.lang, r.followers, r.lat, r.lon, r.geo_ts))
    assert seen == {(-1, "ann", 1000, 2000, ("the hillary clinton show", "bill said", "AND so on"), "[multiple]", 7, 20.0, 30.0, 1000)}


def test_plans_of_grouping(posts):
    test = F.col("text").contains("bill")
    assert {r.key for r in grouping.group_and_filter(posts, F.col("user"), test=test, same_key=True).collect()} == {"ann", "bob"}
    kept = grouping.group_and_filter(posts, filter_key=F.col("user"), test=F.col("text").contains("hillary"))
    assert {r.id for r in kept.collect()} == {1, 2, 4}
    assert grouping.group_and_filter(posts).count() == 4
    assert grouping.group_and_filter(posts, F.col("user")).count() == 2


def test_carry_forward(spark):
    lines = spark.createDataFrame([("f", 0, None), ("f", 1, None), ("f", 2, 7), ("f", 3, None), ("f", 4, 9)], "path string, n int, id int")
    got = [(r.id, r.offset) for r in filters.carry_forward(lines, "path", "n", "id").orderBy("n").collect()]
    assert got == [(7, -2), (7, -1), (7, 0), (7, 1), (9, 0)]


def test_declared_cities(spark):
    users = spark.createDataFrame([("a", "Austin, TX"), ("b", "austin texas"), ("c", "Charleston, West Virginia"), ("d", "nowhere"), ("e", "Austin, TX"), ("e", "Dallas, TX"), ("f", None)], "user string, location string")
    got = {r.user: (r.city, r.state) for r in filters.declared_cities(users).collect()}
    assert got == {"a": ("austin", "texas"), "b": ("austin", "texas"), "c": ("charleston", "west virginia")}
    assert {r.user for r in filters.declared_cities(users, 2).collect()} == {"a", "b"}


def test_messages(spark):
    raw = [
        {"id_str": "5", "text": "RT @bob hi @eve", "created_at": "Wed Aug 27 13:08:45 +0000 2008", "user": {"screen_name": "ann", "followers_count": 3}, "coordinates": {"type": "Point", "coordinates": [20.0, 10.0]},
         "entities": {"user_mentions": [{"screen_name": "bob", "indices": [3, 7]}, {"screen_name": "eve", "indices": [11, 15]}], "hashtags": [], "urls": []}},
        {"delete": {"status": {"id_str": "9"}}},
        {"limit": {"track": 3}},
    ]
    lines = spark.createDataFrame([(json.dumps(x), "f") for x in raw] + [("not json", "f")], "text string, path string")
    got = files.messages(lines).collect()
    assert [r.status for r in got] == ["ok", "delete", "limit", "bad"]
    assert (got[0].id, got[0].ts, got[0].lat, got[0].lon, got[0].user_mentions, got[0].retweets) == (5, 1219842525000, 10.0, 20.0, ["bob", "eve"], ["bob"])


# --- tables and files -------------------------------------------------------------------


def test_table_files(spark, tmp_path):
    (tmp_path / "toy-training.schema.txt").write_text("title\tcoord\tunigram-counts\nsplit\ttraining\ncorpus-type\twikipedia\tkind of corpus\n")
    (tmp_path / "toy-training.data.txt").write_text("Alpha\t30.25,-97.75\triver:3 bridge:1\nBad line\nBeta, Gamma\t51.5,-0.12\tfog:2 a%3Ab:1\nDelta\t\tx:1\n")
    got, bad = textdb.scan(spark, str(tmp_path), "-training", with_rejects=True)
    assert [r.line for r in bad.collect()] == ["Bad line"]
    assert got.columns == ["title", "coord", "unigram-counts", "split", "corpus-type"]
    good, rejects = textdb.documents(textdb.typed(got, {"unigram-counts": "counts"}), "wikipedia", split="training")
    assert {r.title: (r.lat, r["unigram-counts"]) for r in good.collect()} == {"Alpha": (30.25, {"river": 3, "bridge": 1}), "Beta, Gamma": (51.5, {"fog": 2, "a:b": 1})}
    assert [(r.title, r.status, r.reason) for r in rejects.collect()] == [("Delta", "skipped", "no coordinate")]
    with pytest.raises(ValueError):
        textdb.find(spark, str(tmp_path), "-dev")
    base = str(tmp_path / "out" / "again")
    textdb.write(good.select("title", "unigram-counts"), base, textdb.Schema(["title", "unigram-counts"], {"n": "2"}), compression="gzip")
    back = textdb.read_back(spark, base, kinds={"unigram-counts": "counts"})
    assert {r.title: (r["unigram-counts"], r.n) for r in back.collect()} == {"Alpha": ({"river": 3, "bridge": 1}, "2"), "Beta, Gamma": ({"fog": 2, "a:b": 1}, "2")}


def test_written_tables_come_back_whole(spark, tmp_path):
    values = [("a\tb", ["x>>y", "\t"], 1), ("line\nend\r\n", [], None), (None, None, 3), ("", [""], 4), ("%NULL", ["%N"], 5), ("n", [None], 8), ("m", ["", None, "x", ""], 9), ("100%25 %09", ["50%"], 6), ("long " * 20_000, ["é"], 7), ("a\tb", ["x>>y", "\t"], 1)]
    base = str(tmp_path / "all")
    textdb.write(spark.createDataFrame(values, "a string, b array<string>, `c.d` int"), base, suffix="-dev")
    raw, bad = textdb.scan(spark, base, "-dev", with_rejects=True)
    assert (raw.count(), bad.count()) == (len(values), 0)
    back = textdb.read_back(spark, base, "-dev", {"b": "sequence", "c.d": "int"})
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, values))
    textdb.write(spark.createDataFrame([], "a string"), str(tmp_path / "none"))
    assert textdb.read_back(spark, str(tmp_path / "none")).columns == ["a"]
    with pytest.raises(ValueError):
        textdb.write(spark.createDataFrame([((1,),)], "a struct<b: int>"), str(tmp_path / "struct"))


def test_output_fields():
    every = ["a", "b", "c", "d"]
    assert rows.output_fields("default -a", ["a", "b"], every) == ["b"]
    assert rows.output_fields("+d", ["a", "b"], every) == ["a", "b", "d"]
    assert rows.output_fields("none c", ["a"], every) == ["c"]
    assert rows.output_fields("all -b", ["a"], every) == ["a", "c", "d"]
    with pytest.raises(ValueError):
        rows.output_fields("x", ["a"], every)


def test_other_inputs(spark, tmp_path):
    (tmp_path / "counts.txt").write_text("Article title: One\nriver = 3\nbank = 1\nArticle title: Two\nfog = 2\n")
    lines = files.lines_with_path(spark, str(tmp_path / "counts.txt")).withColumn("n", F.monotonically_increasing_id())
    assert {(r.title, r.gram, r.cnt) for r in files.count_sections(lines, "n").collect()} == {("One", "river", 3), ("One", "bank", 1), ("Two", "fog", 2)}
    (tmp_path / "dump.xml").write_text('<mediawiki><page><title>Foo</title><ns>0</ns><id>3</id><redirect title="Bar"/><revision><text xml:space="preserve">hi [[Bar]]</text></revision></page></mediawiki>')
    page = files.dump_pages(spark, str(tmp_path / "dump.xml")).first()
    assert (page.title, page.id, page.redir) == ("Foo", 3, "Bar")
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"id": 1, "name": "box"}, "geometry": {"coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    assert files.regions(spark, str(tmp_path / "r.json")) == [("1", "box", [(0, 0), (0, 1), (1, 1), (0, 0)])]
    spans = spark.createDataFrame([("v", "abcdef", '[{"start":1,"end":3,"points":[[10,20],[30,40]]}]')], "volume string, text string, spans string")
    got = files.annotated_spans(spans).first()
    assert (got.lat, got.lon, got.text) == (30, 20, "bc")


def test_rendering(spark):
    cells = spark.createDataFrame([(0, 0, 1), (3, 11, 2)], "row int, col int, n_docs int")
    grid = grids.RegularGrid(15.0)
    assert sinks.polygons(cells, grid).count() == 8  # a cell may end at the antimeridian
    assert sinks.polygons(cells, grids.RegularGrid(15.0, 2)).count() == 4  # but not lie across it
    out = [r.asDict() for r in sinks.cell_rows(cells, grid).collect()]
    assert sinks.kml(out, "a<b", "n_docs").count("<Placemark>") == 2
    text_grid = sinks.raster([{"row": -1, "col": -2, "p": 0.5}, {"row": 0, "col": -1, "p": 0.25}], grid).splitlines()
    assert text_grid[-2:] == ["-9999 0.25", "0.5 -9999"]
    assert rows.text_table([(1, "a")], ("n", "name")).splitlines() == ["n  name", "1  a"]


def test_redirects_add_up(spark):
    articles = spark.createDataFrame([("A", ""), ("B", "A"), ("C", None)], "title string, redir string")
    coords = spark.createDataFrame([("A", 1.0, 2.0)], "title string, lat double, lon double")
    links = spark.createDataFrame([("A", 3), ("B", 4)], "title string, n int")
    assert {r.title: r.incoming_links for r in rows.combined_articles(articles, coords, links).collect()} == {"A": 7, "B": 0, "C": 0}


def test_splits(spark):
    many = spark.range(1000).withColumn("s", F.concat(F.lit("k"), "id"))
    got = rows.with_positions(many, ["s"], 7).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000)) and [r.s for r in got] == sorted(r.s for r in got)
    dealt = Counter(r.split for r in rows.round_robin(many, ["id"], (8, 1, 1)).collect())
    assert dealt == {0: 800, 1: 100, 2: 100}
    tests = evaluation.evaluation_subset(many, ["id"], skip=5, every=10, limit=3).collect()
    assert sorted(r.id for r in tests) == [5, 15, 25]


# --- statistics and learning --------------------------------------------------------------


def test_dunning_by_hand(spark):
    a, b, c, d = 10.0, 2.0, 90.0, 98.0
    e1, e2 = (a + c) * (a + b) / 200, (b + d) * (a + b) / 200
    lit = [F.lit(x) for x in (a, b, c, d)]
    got = one(spark, x=wordstats.dunning_2x1(*lit), y=wordstats.dunning_2x2(*lit), z=wordstats.dunning_2x1(F.lit(0.0), F.lit(3.0), F.lit(9.0), F.lit(9.0)))
    assert got.x == pytest.approx(2 * (a * math.log(a / e1) + b * math.log(b / e2)))
    m = lambda x: x * math.log(x)
    assert got.y == pytest.approx(2 * (m(a) + m(b) + m(c) + m(d) + m(200) - m(12) - m(188) - m(100) - m(100)))
    assert got.z > 0


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (-3.0,), (0.25,)], "x double")
    assert [r[0] for r in df.select(learning.log_bin(F.col("x"))).collect()] == ["zero", "2", "neg1", "-2"]
    assert one(spark, b=learning.fraction_bin(F.lit(0.3))).b == "3"


def test_features(spark):
    docs = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0)], "doc long, gram string, cnt double")
    cells = spark.createDataFrame([("k", "a", 2.0), ("k", "c", 2.0)], "cell string, gram string, cnt double")
    got = {r.feat: r.value for r in learning.matching_features(docs, cells).collect()}
    assert got == {"product:a": 0.125, "quotient:a": 0.5, "kl:a": pytest.approx(0.25 * math.log(0.5))}
    feats = spark.createDataFrame([(0, "x", "same", 1.0), (0, "y", "same", 1.0), (0, "x", "own", 2.0)], "inst long, label string, feat string, value double")
    assert {r.feat for r in learning.choice_specific(feats).collect()} == {"own"}
    dense = spark.createDataFrame([(0, "yes", 1.5, "red")], "inst long, label string, size double, colour string")
    assert {(r.feat, r.value) for r in learning.dense_instances(dense, "label").collect()} == {("size", 1.5), ("colour=red", 1.0)}
    lines = spark.createDataFrame([(0, "yes a 1 b 2")], "inst long, value string")
    assert {(r.label, r.feat, r.value) for r in learning.sparse_instances(lines).collect()} == {("yes", "a", 1.0), ("yes", "b", 2.0)}


@pytest.mark.parametrize("variant", [None, 0, 1, 2])
@pytest.mark.parametrize("averaged", [False, True])
def test_linear_learners_separate(variant, averaged):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    y = (x @ rng.normal(size=(3, 4)).T).argmax(axis=1)
    fitted = learning.train_linear(np.c_[x, np.ones(150)], y, 3, variant, averaged, rounds=300)
    assert (fitted.predict(np.c_[x, np.ones(150)]) == y).mean() > 0.95


@pytest.mark.parametrize("max_loss", [False, True])
def test_cost_sensitive_learner(max_loss):
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=(100, 2)), np.ones(100)]
    y = (x[:, 0] > 0).astype(int)
    fitted = learning.train_linear(x, y, 2, 1, rounds=200, costs=1.0 - np.eye(2)[y], max_loss=max_loss)
    assert (fitted.predict(x) == y).mean() > 0.95


def test_propagation(spark):
    known = spark.createDataFrame([("A", 1.0), ("B", 0.0)], "user string, ideology double")
    refs = spark.createDataFrame([("u", "a", 3), ("u", "b", 1), ("v", "u", 2), ("w", "nobody", 5)], "user string, ref string, times int")
    first = {r.user: r.ideology for r in learning.propagate_ideology(known, refs).collect()}
    assert first == {"a": 1.0, "b": 0.0, "u": 0.75}
    second = {r.user: r.ideology for r in learning.propagate_ideology(known, refs, 2).collect()}
    assert second["v"] == 0.75


def test_co_training_stops_below_the_batch(spark):
    labelled = spark.createDataFrame([(0, "x")], "doc long, label string")
    rest = spark.createDataFrame([(1,), (2,)], "doc long")
    fit = lambda seen: lambda r: r.withColumns({"label": F.lit("x"), "confidence": F.col("doc") / 2})
    steps = list(learning.co_train(labelled, rest, fit, least_batch=1, rounds=5, confidence=0.9))
    assert [s.count() for s in steps] == [2]
    assert one(spark, w=learning.windows_of(F.array(*[F.lit(str(i)) for i in range(9)]), F.array(F.lit(4), F.lit(0)), 2)).w == [["2", "3", "4", "5", "6"], ["0", "1", "2"]]


# --- variants --------------------------------------------------------------------------


def test_matching_text(spark):
    rows = spark.createDataFrame([(1, "in 1999 or so"), (2, "none"), (3, None), (4, "")], "id long, text string")
    assert [r.id for r in filters.matching_text(rows, "[0-9]{4}").collect()] == [1]


def test_short_word_counts(spark):
    lines = spark.createDataFrame([("a  b a",), ("",), ("   ",), ("muchlonger a ",), (None,)], "value string")
    assert {r.word: r.cnt for r in wordstats.short_word_counts(lines).collect()} == {"a": 3, "b": 1, "": 2}


def test_differing_features(spark):
    rows = [("g", 1, "same", 2.0), ("g", 2, "same", 2.0), ("g", 1, "once", 1.0), ("g", 1, "zero", 0.0), ("g", 1, "x", 1.0), ("g", 2, "x", 3.0), ("h", 1, "x", 1.0)]
    got = wordstats.differing_features(spark.createDataFrame(rows, "grp string, vec int, feature string, value double"), ["grp"], "vec")
    assert sorted(map(tuple, got.collect())) == [("g", "once"), ("g", "x")]


def test_counts_once_per_user(spark):
    rows = [("c", "ann", ["x", "x", "y"]), ("c", "ann", ["x"]), ("c", "bob", ["x", None]), ("d", None, ["x"]), ("d", None, ["x"])]
    got = models.counts_once_per_user(spark.createDataFrame(rows, "cell string, user string, tokens array<string>"), ["cell"], "user", F.col("tokens"))
    assert sorted(map(tuple, got.collect())) == [("c", "x", 2.0), ("c", "y", 1.0), ("d", "x", 1.0)]


def test_rerankings(spark):
    ranked = spark.createDataFrame([(d, f"c{i}", -float(i), i) for d in (1, 2) for i in range(1, 6)], "doc long, cell string, score double, rank int")
    shifted = {(r.doc, r.cell): r.score for r in ranking.rescaled(ranked.filter("doc = 1")).collect()}
    assert shifted == {(1, f"c{i}"): 1.0 - i for i in range(1, 6)}
    once, again = (sorted(map(tuple, ranking.randomly_reranked(ranked.repartition(n), 3, 5).collect())) for n in (1, 7))
    assert once == again
    assert sorted(r for d, _, r in once if d == 1) == [1, 2, 3, 4, 5]
    assert {c for d, c, r in once if d == 2 and r <= 3} == {"c1", "c2", "c3"}
    truth, cells = spark.createDataFrame([(1, "c4"), (2, "c9")], "doc long, correct_cell string"), ranked.select("cell").distinct()
    got = sorted(map(tuple, ranking.oracle_ranked(ranked, truth, cells).collect()))
    assert got == [(1, "c4", 0.0, 1)] + [(2, f"c{i}", -float(i), i) for i in range(1, 6)]


def test_sorted_tables(spark):
    data = [("a", 3, 0.5, 0.1, 9.0, 5.0, 7.0), ("b", 4, 0.9, 0.3, 8.0, 6.0, 7.0), ("c", 1, 0.1, 0.2, 1.0, 9.0, 5.0)]
    found = spark.createDataFrame(data, "file string, n_eval long, accuracy double, acc_161 double, mean_km double, median_km double, average_km double")
    orders = {by: "".join(r.file for r in evaluation.sorted_results(found, by).collect()) for by in evaluation.RESULT_ORDERS}
    assert orders == {"average": "cab", "mean": "cba", "median": "abc", "accuracy": "bac", "acc161": "bca", "numeval": "bac", "file": "abc"}
    assert [r.file for r in rows.sorted_by(found.select("file", "average_km"), "average_km").collect()] == ["a", "b", "c"]


def test_counters(spark):
    kept, seen = rows.counted(spark.range(10), "ids", {"even": F.col("id") % 2 == 0, "large": F.col("id") > 7})
    assert kept.filter("id < 100").count() == 10
    assert seen.get == {"even": 5, "large": 2}


def test_tag_ngrams_and_pretty_json(spark):
    tags = spark.createDataFrame([("Big  Red Bus ",), ("one",), ("",), (None,)], "tag string")
    got = [r[0] for r in tags.select(text.tag_ngrams(F.col("tag"), 2)).collect()]
    assert got == [[["big"], ["red"], ["bus"], ["big", "red"], ["red", "bus"]], [["one"], ["one"]], [[""], [""]], None]
    pretty = tags.limit(1).select(text.pretty_json(F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")))).first()[0]
    assert "\n" in pretty and json.loads(pretty) == {"a": 1, "b": [2]}
