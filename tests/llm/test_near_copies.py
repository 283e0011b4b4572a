"""The pipeline's near-duplicate stage against all pairs of 5-word shingle sets."""

from itertools import combinations

import numpy as np

from loamgrid.llm import near_dups


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def kept_by_brute_force(rows):
    """Of each component the row of the least id, a null id coming last."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 0, i)), (r[0] is None, r[0] or 0, i))
    return sorted([rows[i] for *_, i in least.values()], key=str)


def test_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(60, 400))) for _ in range(40)]
    for i in range(30):  # scattered changes of words: similarity falls below 0.8 for some
        words = texts[i].split()
        for at in rng.integers(0, len(words), 1 + i % 6):
            words[at] = "changed"
        texts.append(" ".join(words))
    base = rng.choice(vocabulary, 200)
    for i in range(150):  # one large group, linked in chains
        words = list(base)
        for at in rng.integers(0, 200, i % 5):
            words[at] = f"n{i}"
        texts.append(" ".join(words))
    texts += [f"one common line that many short texts do hold and then number {i} of them all" for i in range(80)]
    slot = list(rng.choice(vocabulary, 30))  # a form with one word to fill in: alike, but not enough
    texts += [" ".join([*slot[:15], f"f{i}", *slot[15:]]) for i in range(120)]
    texts += [" ".join([*slot, *rng.choice(vocabulary, 4)]) for i in range(60)]
    texts += [texts[0].upper(), "Short text", "short  text", "short", "", " \n", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y"), (None, None, "y")]
    rows += [rows[3]] * 5 + [rows[-1]] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, _hash string")
    got = near_dups.drop_near_duplicates(table)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect()), key=str) == kept_by_brute_force(rows)
    assert near_dups.drop_near_duplicates(table.limit(0)).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.integers(0, 20) :], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)]))
        bits = sum((a ^ b).bit_count() if a ^ b >= 0 else 64 - (~(a ^ b)).bit_count() for a, b in zip(near_dups._parities(x), near_dups._parities(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(135, 90), (200, 201)]
    got = {r.node: r.root for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 90 for i in [90, *range(100, 140)]}, 200: 200, 201: 200}


def test_different_texts_under_one_id(spark):
    rows = [(1, "one text of its own"), (1, "another text that is not alike"), (0, "another text that is not alike"), (1, "one text of its own"), (1, "a third one, quite unlike both")]
    got = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [rows[2], rows[4], rows[0]]


def test_simhash_links_are_candidates(spark):
    """Fingerprints within 2 bits, or equal, make candidates without any band key; Jaccard decides."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice([f"w{i}" for i in range(4000)], n))
    long = say(600)
    texts = [long, long + " more", say(50), say(50), say(50)]
    sets = [near_dups._shingles(t.encode(), near_dups.WIDTH)[1] for t in texts]
    fps = [near_dups._fingerprint(s) for s in sets]
    assert 0 <= (fps[0] ^ fps[1]).bit_count() <= 2
    fps[3], fps[4] = fps[2] ^ 1, fps[2]  # candidates that are not alike
    rows = [(i, len(s), fp, []) for i, (s, fp) in enumerate(zip(sets, fps, strict=True))]
    nodes = spark.createDataFrame(rows, "n long, size long, fp long, keys array<long>")
    named = spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "n long, text binary")
    got = near_dups.jaccard_components(nodes, lambda wanted: named.join(wanted, "n"))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0)]
    found = near_dups._simhash_pairs(nodes).select("a", "b").collect()
    assert {(0, 1), (2, 3), (2, 4)} <= set(map(tuple, found))


def test_fingerprint_is_the_simhash_of_the_set():
    rng = np.random.default_rng(8)
    shingles = np.unique(rng.integers(0, 1 << 63, 301).astype(np.uint64))
    want = sum(1 << i for i in range(64) if sum(int(h) >> i & 1 for h in shingles) * 2 > len(shingles))
    assert near_dups._fingerprint(shingles) % (1 << 64) == want
    assert near_dups._fingerprint(shingles[:0]) == 0


def _moved(node):
    """Rows that the exchanges of an executed plan have written."""
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    below = node.children()
    return own + sum(_moved(below.apply(i)) for i in range(below.size()))


def test_texts_of_no_copies_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(4000)], 60)) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate([*texts, *(f"{t} more" for t in texts[:4]), texts[5]])] + [(None, texts[6]), (None, "alone")]
    moved, write = {}, near_dups.write_table

    def counted(df, tag):
        if tag == "minhash-texts":
            df.collect()
            moved[tag] = _moved(df._jdf.queryExecution().executedPlan())
        return write(df, tag)

    monkeypatch.setattr(near_dups, "write_table", counted)
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    try:
        out = near_dups.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [tuple(r) for r in out.collect()]
        moved["result"] = _moved(out._jdf.queryExecution().executedPlan())
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
    assert sorted(got, key=str) == kept_by_brute_force(rows)
    assert max(moved.values()) < 200 and len(moved) == 2


def test_marks_miss_no_key(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 7 else None, i * 31, "x") for i in range(2000)], "id long, h long, _slot string")
    keys = rows.filter("h % 5 = 0 or id is null").select("id", "h")
    for words in (1 << 18, 1):  # the least map marks nearly all
        monkeypatch.setattr(near_dups, "MAP", words)
        got = near_dups._marked(rows, ["id", "h"], keys, "_mark")
        assert got.columns == ["id", "h", "_slot", "_mark"] and got.count() == 2000
        assert got.filter("not _mark and (h % 5 = 0 or id is null)").isEmpty()
        assert (got.filter("not _mark").count() > 1000) == (words > 1)
    assert near_dups._marked(rows, ["id", "h"], keys.limit(0), "_mark").filter("_mark").isEmpty()
