"""All stages on one small corpus with planted cases, each against brute force on its own input."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from test_near_copies import kept_by_brute_force


def planted(rng):
    """Documents (doc_id, text, lang, source, n_chars), labels and benchmark items."""
    vocabulary = [f"wort{i}x" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    texts, toxic = [], set()
    for i in range(240):
        words = say(rng.integers(20, 90)).split()
        if i % 6 == 0:
            toxic.add(i)
            words += ["vile", "nasty", "vile"]
        texts.append(" ".join(words))
    items = [(i, say(20)) for i in range(5)] + [(5, "wort1x"), (6, None), (7, "")]
    texts += [f"{say(30)} {t} {say(10)}" for _, t in items[:5]]
    texts += [texts[1], texts[2].upper(), texts[3] + " more", " ".join([*texts[4].split()[:-1], "else"]), texts[3]]
    texts += ["", None, " ", "pay 4111 1111 1111 1111 on 1985-12-31 please " + say(20), "x " * 20_000 + "1899-12-31"]
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[7], docs[7], (None, say(25), None, None, None), (8, say(30), "de", "s1", 5)]
    labels = [(i, 1, int(i in toxic)) for i in range(240)] + [(None, 1, 1), (3, None, None)]
    return docs, labels, items, toxic


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items, toxic = planted(np.random.default_rng(21))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = table.columns, [[tuple(r) for r in table.collect()]]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        assert out.columns == columns or name == "packing"
        out.write.parquet(f"{tmp_path}/out-{n}")
        table = spark.read.parquet(f"{tmp_path}/out-{n}")
        seen.append([tuple(r) for r in table.collect()])
    start, clean, single, free, private, packed = seen
    gone = {r[0] for r in start} - {r[0] for r in clean}
    assert gone == toxic and len(clean) == len(start) - sum(r[0] in toxic for r in start)
    assert Counter(map(str, single)) == Counter(map(str, kept_by_brute_force(sorted(clean, key=str))))

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    spans = {tuple(w[i : i + 8]) for _, t in items for w in [words(t)] for i in range(len(w) - 7)}
    hit = [r for r in single if any(tuple(w[i : i + 8]) in spans for w in [words(r[1])] for i in range(len(w) - 7))]
    assert Counter(map(str, free)) == Counter(map(str, single)) - Counter(map(str, hit)) and len(hit) == 5
    changed = [(a, b) for a, b in zip(sorted(free, key=str), sorted(private, key=str), strict=True) if a != b]
    assert len(changed) == 2 and not any("4111 1111" in (r[1] or "") or "1899-12-31" in (r[1] or "") or "1985-12-31" in (r[1] or "") for r in private)
    assert Counter((r[0], *r[2:4]) for r in free) == Counter((r[0], *r[2:4]) for r in private)
    at = table.columns.index
    assert Counter((r[at("doc_id")], r[at("n_tokens")]) for r in packed) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1) for r in private)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r[at("doc_id")] for r in packed)


def test_empty_tables(spark, tmp_path):
    docs, labels, items, _ = planted(np.random.default_rng(1))
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
