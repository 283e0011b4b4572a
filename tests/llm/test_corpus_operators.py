"""Each operator against a brute-force version on small tables with awkward rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamgrid.llm import (
    decontaminate, license_scan, near_dups, packing, pii, quality_rules, sharding, token_output, toxicity, url_reputation,
)
from loamgrid.llm.common import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int"


def rows_of(texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "x", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Über", "naïve,", "A|B", "###"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(120)]
    texts += ["", " \n\t", None, "one", "one two", "a\nb\na\n\n \na", "word " * 30, "x" * 5000, " ".join(map(str, range(20000)))]
    texts += [texts[3]] * 4 + [texts[4] + " extra"]
    rows = rows_of(texts)
    rows += [rows[7]] * 3 + [(None, "no id here", "en", "s1", 10, "x", 7), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_and_components(docs, empty):
    def fp(text):
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = near_dups.near_duplicates(docs).collect()
    want = [(r.doc_id, fp(r.text)) for r in docs.collect()]
    assert Counter((r.id, r.fp % (1 << 64)) for r in got) == Counter(want)
    parent = {f: f for _, f in want}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for i, f in want:
        if i is not None and (least[root(f)] is None or i < least[root(f)]):
            least[root(f)] = i
    assert all(r.component_id == least[root(r.fp % (1 << 64))] for r in got)
    assert near_dups.near_duplicates(empty).count() == 0
    assert near_dups.drop_near_duplicates(docs).columns == docs.columns


def test_hot_blocks_lose_no_link(spark):
    """Thousands of fingerprints that share a block, linked in chains: midpoints against all pairs."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 12, 400)
    values = sorted({(0xABCDEF12 << 32) + int(x) for x in low} | {int(x) >> 1 for x in rng.integers(0, 1 << 62, 200)})
    edges = near_dups.links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long"))
    got = {r.node: r.root for r in near_dups.components(edges).collect()}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    groups = defaultdict(set)
    for v in values:
        groups[root(v)].add(signed[v])
    for members in groups.values():
        roots = {got.get(m, m) for m in members}
        assert roots == {min(members)}


def test_sharding(docs, empty, spark):
    got = sharding.interleave(docs, 8).collect()
    assert len(got) == docs.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.source) for r in docs.collect())
    assert Counter((r.id, r["size"], r.text_crc32, r.source) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    totals, per = Counter(r.source for r in got), Counter((r.shard, r.source) for r in got)
    assert all(abs(per[s, x] - n / 8) <= 2 for x, n in totals.items() for s in range(8))
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(sharding.interleave(docs.repartition(3), 8).collect(), key=str)]
    assert sharding.interleave(empty).count() == 0


def test_optimal_buckets_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.sort(rng.choice(50, rng.integers(1, 9), replace=False)) + 1
        counts = rng.integers(1, 9, len(lengths))
        k = int(rng.integers(1, 5))

        def waste(bounds, lengths=lengths, counts=counts):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))

        best = min(waste([*map(int, c), int(lengths[-1])]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        bounds = packing.optimal_buckets(lengths, counts, k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and waste(bounds) == best


def test_packing(docs, empty):
    got = packing.pack_documents(docs, k=4, budget=100).collect()
    want = Counter((r.doc_id, len(WORDS.findall(r.text or "")) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].bucket_len <= 100
        full = max(1, 100 // rows[0].bucket_len)
        assert len(rows) == full or (bucket, batch + 1) not in batches
    assert packing.pack_documents(empty).count() == 0


def test_packing_keeps_other_columns(spark):
    rows = [(None, i % 9, i, i + 1, i + 2, "u") for i in range(300)] + [(1, 3, 5, 5, 5, "v")] * 40
    table = spark.createDataFrame(rows, "doc_id long, n long, _len int, _h int, _below int, bucket string")
    got = packing.pack(table, "n", k=3, budget=60).collect()
    assert Counter((r.doc_id, r.n, r._len, r._h, r._below) for r in got) == Counter(r[:5] for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(rows)


def test_shards_on_disk(spark, tmp_path):
    table = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}", "old") for i in range(50)], "doc_id long, text string, source string, shard string")
    sharding.write_shards(table, sharding.interleave(table, 4), f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert got.groupBy("shard").count().filter("count between 12 and 13").count() == 4 and got.select("doc_id").distinct().count() == 50


def test_learning_does_not_depend_on_order(spark):
    rng = np.random.default_rng(13)
    rows = [(int(rng.integers(0, 80)), " ".join(rng.choice(["a", "bad", "word", "####", "more", f"w{i}"], 30))) for i in range(300)] + [(9, None), (None, "x")]
    marks = [(i, None if i % 11 == 0 else i % 2, None if i % 13 == 0 else int(i % 5 == 0)) for i in range(80)] + [(3, 1, 1), (5, None, None)]
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chains, lists = [], []
    for seed, parts in ((1, 1), (2, 4)):
        order = np.random.default_rng(seed).permutation(len(rows))
        table = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(parts)
        chains.append(toxicity.learned_on(table, marks))
        lists.append(quality_rules.learned_on(table, marks))
    one, two = chains
    assert one.vocabulary == two.vocabulary and one.limits == two.limits and lists[0] == lists[1]
    assert all((a == b).all() for x, y in zip(one.weights, two.weights, strict=True) for a, b in zip(x, y, strict=True))
    clash = toxicity.drop_toxic(table.withColumn("is_toxic", F.lit("mine")), marks)
    assert clash.columns == ["doc_id", "text", "is_toxic"] and all(r.is_toxic == "mine" for r in clash.collect())
    toxic_only = toxicity.learned_on(table, marks.withColumn("quality", F.lit(None).cast("int")))
    assert toxic_only.limits[0] > 1 and toxic_only.limits[1] < 1


def test_tokens_round_trip(docs, empty, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["naïve’s I'm <|endoftext|> x́ A.B, c.,d", "ß ªº İx été!? STRAẞE 12a we're 中文 é́ z\x85y Σας ΣΑΣ", "\x1cfile\x1dsep"]
    table = docs.unionByName(spark.createDataFrame([(900 + i, t, None, None, None, None, None) for i, t in enumerate(odd)], SCHEMA))
    token_output.write_tokens(table, f"{tmp_path}/t", path)
    got = sorted(token_output.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    want = Counter()
    for r in table.collect():
        want[r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    assert Counter((r.id, bytes(r.ids)) for r in got) == want
    names = [r.id for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    token_output.write_tokens(empty, f"{tmp_path}/e", path)
    assert token_output.read_tokens(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1])
def test_codes_round_trip(top):
    for n in (0, 1, 3, 4, 5, 1000):
        x = np.random.default_rng(n).integers(0, top, n, endpoint=True).astype(np.uint32)
        control, data = token_output.encode_codes(x)
        assert len(control) == -(-n // 4) and (token_output.decode_codes(control, data, n) == x).all()


def test_text_statistics(docs, empty):
    def want(text):
        text = text or ""
        words = WORDS.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        repeats = sum(x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(inside)

    got = quality_rules.judge(docs, []).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == Counter((r.doc_id, *want(r.text)) for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) == (not r.kept) for r in got)
    assert quality_rules.judge(empty, []).count() == 0


def test_repeats_with_many_words():
    """Vocabularies too large for one packed key take the renumbering path."""
    rng = np.random.default_rng(0)
    words = [f"{x}".encode() for x in rng.permutation(30000)]
    assert quality_rules.repeated_words(words + words[100:106]) == 12


def test_decision_list_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    stats = rng.integers(10, 400, (3000, 9))
    x = quality_rules.feature_matrix(stats)
    y = (x[:, 2] > 2) & (x[:, 0] < 150) | (x[:, 6] > 8)
    rules = quality_rules.learn_rules(x[:2000], y[:2000])
    said = np.zeros(1000, bool)
    for rule in rules:
        said |= quality_rules._covers(rule, x[2000:])
    assert (said == y[2000:]).mean() > 0.95
    columns = [*quality_rules.BASE, *quality_rules.MORE]
    df = spark.createDataFrame([tuple(map(int, r)) for r in stats[2000:]], ", ".join(f"{c} long" for c in columns))
    fired = [r[0] is not None for r in df.select(quality_rules.rule_column(rules)).collect()]
    assert fired == said.tolist()
    assert quality_rules.learn_rules(np.zeros((0, 8)), np.zeros(0, bool)) == []


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/7x?q", "https://example.com", "x://net/de/1#f", "no scheme", None, "", "a://b.example.net/de/81",
            "h://notexample.com/en/7", "h://org/es/", "h://x/y://z/en/", "h://É.Org/es/1", "h://com/e"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")

    def want(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [h + p for _, h, p in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len) if fit else None

    action = {h + p: a for a, h, p in url_reputation.RULES}
    got = url_reputation.judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == want(urls[r.page_id if r.page_id is not None else 0])
        assert r.verdict == action[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0
    assert url_reputation.judge_urls(pages, labels.limit(0)).count() == len(urls) + 1


def test_reputation_shrinks(spark):
    outcomes = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 60 + [("one.a.com", 1)] + [(f"h{i}.b.com", i % 4 == 0) for i in range(40)]
    hosts = spark.createDataFrame([(h,) for h in {h for h, _ in outcomes} | {"new.a.com"}], "host string")
    found = url_reputation.host_reputation(spark.createDataFrame([(h, int(b)) for h, b in outcomes], "host string, bad long"), hosts)
    got = {r.host: r for r in found.collect()}
    assert got["bad.a.com"].bound > 0.8 and got["good.a.com"].mean < 0.1
    assert got["good.a.com"].mean < got["new.a.com"].mean < got["one.a.com"].mean < got["bad.a.com"].mean
    assert got["one.a.com"].bound < 0.5  # one page is no proof


def test_levels_of_hosts(spark):
    want = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "me:pw@www.x.org": ("x.org", "org"),
            "1.2.3.4:80": ("1.2.3.4", ""), "[::1]:80": ("[::1]", ""), "localhost": ("localhost", "localhost"), "": ("", ""), "1.2.3.4.5": ("4.5", "5")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = url_reputation.levels(F.col("host"))
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want
    domain, suffix = url_reputation.levels(F.col("host"), ["k12.ca.us", "uk"])
    df = spark.createDataFrame([("www.school.k12.ca.us",), ("a.b.co.uk",)], "host string")
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [("school.k12.ca.us", "k12.ca.us"), ("co.uk", "uk")]


def test_bound_is_near_the_beta_quantile(spark):
    rng = np.random.default_rng(7)
    sizes = {"a.com": (40, 36), "b.com": (10, 5), "c.com": (30, 3), "d.com": (0, 0), "e.com": (5, 5)}
    rows = [(h, int(i < k)) for h, (n, k) in sizes.items() for i in range(n)]
    hosts = spark.createDataFrame([(h,) for h in sizes], "host string")
    by_host = spark.createDataFrame([(n, k) for n, k in sizes.values()], "n long, k long")
    strength = url_reputation._strength(by_host)
    for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad long"), hosts).collect():
        n, _ = sizes[r.host]
        a = r["mean"] * (n + strength)
        exact = np.quantile(rng.beta(a, n + strength - a, 200_000), 0.05)
        assert r.bound < exact + 0.03
        if n + strength - a >= 1:
            assert r.bound > exact - 0.1


def test_bound_decides_both_ways(spark):
    urls = [(i, f"http://{'bad' if i % 2 else 'good'}.host{i % 2}.info/p/{i}") for i in range(200)]
    pages = spark.createDataFrame(urls + [(900, "http://bad.host1.info/unknown"), (901, "http://new.host0.info/x"), (902, "http://bad.host1.info:81/" + "x" * 100_000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_reputation.judge_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(200))
    assert got[900] == "block" and got[901] == "allow"


def spans_of(text, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, hits = low(text), set(), set()
    for name, item in items:
        x = low(item)
        n = min(8, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    hits.add(str(name))
    return len(words), len(hit), sorted(hits)


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(9)
    vocabulary = ["the", "of", "Na", "ïv", "x1", "Q"]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([30, 12, 8, 7, 3, 1, 0, 40])]
    items += [(8, None), (9, "the the the the the the the the the"), (1, "rare word only")]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 80))) for _ in range(60)]
    texts += [a + " sep " + b[5:] for _, a in items if a for _, b in items if b][:40] + ["", None, "THE of-na\nïv"]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, None, None)]
    table = spark.createDataFrame(rows + [(None, texts[1], None, None, None, None, None)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(table, bench).collect()
    want = Counter((r.doc_id, *map(str, spans_of(r.text, items))) for r in table.collect())
    assert Counter((r.id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
    kept = decontaminate.drop_contaminated(table, bench)
    long = [x for x in items if x[1] and len(x[1].split()) >= 8]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in table.collect() if not spans_of(r.text, long)[1])
    clash = decontaminate.drop_contaminated(table.select("doc_id", "text", F.lit(1).alias("_hash"), F.lit(2).alias("id"), F.lit(3).alias("text_hash")), bench)
    assert Counter(tuple(r)[2:] for r in clash.collect()) == {(1, 2, 3): kept.count()}
    assert kept.columns == table.columns
    assert decontaminate.contamination(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_large_benchmark_by_shuffle(spark, monkeypatch):
    items = [(i, " ".join(f"w{(i * j) % 17}" for j in range(20))) for i in range(12)]
    texts = [(i, "a b " + t + " c") for i, t in items]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted(map(str, decontaminate.contamination(table, bench).collect()))
    bench = bench.unionByName(spark.createDataFrame([(90, "a b w0"), (91, "c")], bench.schema))
    whole = sorted(map(str, decontaminate.contamination(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 10)
    assert sorted(map(str, decontaminate.contamination(table, bench).collect())) == whole


def test_feistel_is_a_permutation(spark):
    for a, b in ((1, 1), (3, 5), (10, 100), (270, 270)):
        df = spark.range(a * b).select(pii.feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "t", "k").alias("v"))
        assert sorted(r.v for r in df.collect()) == list(range(a * b))


def feistel(value, a, b, tag, key="k"):
    """The permutation in plain Python."""
    import hashlib

    x, y = divmod(value, b)
    for i in range(pii.ROUNDS):
        mixed = int(hashlib.sha256(f"{key}:{tag}:{i}:{y if i % 2 == 0 else x}".encode()).hexdigest()[:15], 16)
        x, y = ((x + mixed) % a, y) if i % 2 == 0 else (x, (y + mixed) % b)
    return x * b + y


def permuted(digits, tag):
    def part(d, tag):
        n = len(d)
        return str(feistel(int(d), 10 ** (-(-n // 2)), 10 ** (n // 2), tag)).zfill(n)

    if len(digits) <= 18:
        return part(digits, tag)
    tail = part(digits[-18:], f"{tag}/{digits[:-18]}")
    return part(digits[:-18], f"{tag}\\{tail}") + tail


def test_pseudonyms_against_plain_python(spark):
    from datetime import date, timedelta

    rng = np.random.default_rng(6)
    digits = ["".join(map(str, rng.integers(0, 10, n))) for n in range(1, 37) for _ in range(3)] + ["9" * 18, "0" * 20, "9" * 36]
    df = spark.createDataFrame([(d,) for d in digits], "d string").select("d", pii._permuted(F.col("d"), "phone", "k").alias("p"))
    assert all(r.p == permuted(r.d, "phone") for r in df.collect())
    epoch = date(1900, 1, 1)
    days = [date(1, 1, 1), date(9999, 12, 31), date(1899, 12, 31), epoch, epoch + timedelta(72_899), epoch + timedelta(72_900), date(1985, 12, 31)]
    got = pii.pseudonymize(spark.createDataFrame([(i, f"on {d.isoformat()} it", "en") for i, d in enumerate(days)], "i int, text string, lang string"), "k")
    for r in got.collect():
        n = (days[r.i] - epoch).days
        if 0 <= n < 72_900:
            want = feistel(n, 270, 270, "date")
        else:
            v = feistel(n + (693_595 if n < 0 else 693_595 - 72_900), 1227, 2917, "far-date")
            want = v - 693_595 if v < 693_595 else v - 693_595 + 72_900
        assert r.text == f"on {(epoch + timedelta(want)).isoformat()} it"
    iban = "FR1420041010050500013M02606"
    (r,) = pii.pseudonymize(spark.createDataFrame([(f"{iban} " + "word 7 " * 50_000 + iban,)], "text string"), "k").collect()
    one, two = r.text[:27], r.text[-27:]
    new = permuted("2004101005050001302606", "iban")
    assert one == two and one[4:] == new[:17] + "M" + new[17:] and int("".join(str(int(c, 36)) for c in one[4:] + one[:4])) % 97 == 1


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms(spark, empty):
    texts = {
        "card": "pay 4111 1111 1111 1111 or 4111111111111111, not 4111-1111-1111-1112.",
        "ip": "from 97.216.119.150 not 300.1.2.3 nor 1.2.3.4.5",
        "phone": "+1 (532) 555-7857 or 532-555-7857 end",
        "date": "1987-02-28 and 28.02.1987 and 02/28/1987 but 1987-02-30",
        "ssn": "123-45-6789 and 000-12-3456",
        "iban": "DE89370400440532013000 not DE89370400440532013001",
        "mail": "to saee.80@mail7.example.com please",
        "clean": "nothing here, in 1999 there were 12 of 345 things; v2.0 #1",
    }
    table = spark.createDataFrame([(k, v, 1, "f") for k, v in texts.items()] + [("null", None, 2, None), ("", "", 3, "g")] + [("card", texts["card"], 4, "h")], "k string, text string, _new int, _found string")
    rows = pii.pseudonymize(table, "key", count_col="n").collect()
    assert sorted((r._new, r._found or "") for r in rows) == sorted((r._new, r._found or "") for r in table.collect())
    assert len({r.text for r in rows if r.k == "card"}) == 1
    got = {r.k: r for r in rows}
    assert got["null"].text is None and got[""].text == "" and got["clean"].text == texts["clean"]
    assert {k: r.n for k, r in got.items()} == {"card": 2, "ip": 1, "phone": 2, "date": 3, "ssn": 1, "iban": 1, "mail": 1, "clean": 0, "null": 0, "": 0}
    one, two = re.search(r"pay ([\d ]+) or (\d+), not 4111-1111-1111-1112\.", got["card"].text).groups()
    assert one.replace(" ", "") == two != "4111111111111111" and luhn(two) and two[0] == "4" and re.fullmatch(r"\d{4}( \d{4}){3}", one)
    one, two = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\S+) end", got["phone"].text).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "5325557857"
    y, m, d = re.match(r"(\d{4})-(\d\d)-(\d\d) and", got["date"].text).groups()
    assert f"{d}.{m}.{y} and {m}/{d}/{y} but 1987-02-30" in got["date"].text
    iban = got["iban"].text.split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert all(int(x) < 256 for x in got["ip"].text.split()[1].split(".")) and got["ip"].text.endswith("not 300.1.2.3 nor 1.2.3.4.5")
    assert re.fullmatch(r"to u[0-9a-f]{12}@pseudonym\.invalid please", got["mail"].text)
    assert pii.pseudonymize(empty, "key").count() == 0


def test_toxicity_chain_on_held_out_rows(spark, empty):
    rng = np.random.default_rng(8)
    vocabulary = [f"wort{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic, junk = i % 5 == 0, i % 7 == 0
        words = list(rng.choice(vocabulary, rng.integers(5, 60)))
        words += list(rng.choice(["vile", "nasty"], 2)) if toxic else []
        words += ["####"] * 9 + ["spam"] if junk else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), 0.5))
        if i < 400:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(601, None, 1.0), (602, "", None), (0, rows[0][1], 0.5), (None, "no id", 0.1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.learned_on(table.drop("p_toxic"), marks)
    got = toxicity.score(table, chain).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(r.is_toxic == (r.doc_id % 5 == 0) for r in held) >= 195
    assert sum(r.is_low_quality == (r.doc_id % 7 == 0) for r in held) >= 195
    assert toxicity.score(empty, chain).count() == 0
    none = toxicity.learned_on(table.drop("p_toxic"), marks.limit(0))
    assert not any(r.is_toxic for r in toxicity.score(table, none).collect())


def test_license_notices(docs, empty, spark):
    index = license_scan.build_index(license_scan.TEMPLATES)
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            found = license_scan.scan(f"before it\n{t.upper()} after", index)
            assert [(x[0], x[1]) for x in found] == [(name, 1.0)] and found[0][2] == 10 + license_scan._TOKEN.search(t).start()  # whole texts begin with blanks
    near = license_scan.scan("This work is now licensed under the GNU General Public License version 3", index)
    assert [x[0] for x in near] == ["gpl-3.0"] and near[0][1] >= 0.9
    assert license_scan.scan("licensed under the stars, version 2.0 of the public", index) == []
    two = "Released under the MIT License. " * 3
    assert len(license_scan.scan(two, index)) == 3
    assert sum(r.n_notices for r in license_scan.license_notices(docs).collect()) == 0
    assert license_scan.license_notices(docs).count() == docs.count() and license_scan.license_notices(empty).count() == 0


def test_alignment_against_full_matrix():
    rng = np.random.default_rng(3)

    def full(template, ids):
        best = [0] * (len(ids) + 1)
        for w in template:
            row = [best[0] - 1]
            for j, x in enumerate(ids):
                row.append(max(best[j] + (2 if x == w else -1), best[j + 1] - 1, row[-1] - 1))
            best = row
        return max(best)

    for _ in range(40):
        template = rng.integers(0, 4, 8)
        ids = np.concatenate([rng.integers(4, 6, rng.integers(0, 5)), np.delete(template, rng.integers(0, 8)), rng.integers(4, 6, 3)])
        start = int(np.flatnonzero(ids < 4)[0])
        matched, a, z = license_scan.align(template, ids, start)
        assert matched == 7 and full(template, ids) == 2 * 7 - 1 and z - a >= 7


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
