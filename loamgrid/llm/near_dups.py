"""SimHash near-duplicates: pigeonhole blocks, verified links, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, write_table

#: Fingerprints are cut into this many blocks; two that differ in at most `distance` bits agree on the others.
BLOCKS = 4
#: A block value held by more fingerprints is linked through midpoints instead of pairs.
PAIRED = 64
SEED = 42
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_AT_ONCE = 1 << 16
#: Near duplicates of the pipeline: words in a shingle and least Jaccard similarity of the shingle sets.
WIDTH, SIMILAR = 5, 0.8
#: MinHash bands and the hashes in each: one band agrees with probability s ** ROWS at similarity s.
BANDS, ROWS = 24, 5
#: Parities of a shingle set, in 64-bit words.
SKETCH = 8
#: More pairs than this a row in the exact join between components, and one member is compared with all others first.
DENSE = 1024
#: Earlier shingles of its set that a prefix key carries.
EARLIER = 8
#: 64-bit words, at most, of the broadcast bitmap that spares the texts of other rows a shuffle.
MAP = 1 << 18
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed integer."""
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def simhash(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of word shingles, as a signed integer.

    A bit is set if it is set in over half the shingles' hashes.  No words: 0.
    """
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(spans), _AT_ONCE):
        part = spans[at : at + _AT_ONCE]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += _votes(h)
    return _majority(ones, len(spans))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of `docs`: (id, fp).  Texts are streamed in Arrow batches."""
    schema = docs.select(F.col(id_col).alias("id"))
    kind = schema.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(x.as_buffer() and bytes(x.as_buffer()), width) if x.is_valid else 0 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"id {kind}, fp long")


def _block_masks(distance: int) -> list[int]:
    """Masks of the kept bits: each choice of BLOCKS - distance blocks."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, BLOCKS - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of "differ in at most 2 bits".

    Each fingerprint is keyed by every choice of two of its four blocks; two
    that differ in at most 2 bits share a key.  A key of at most PAIRED
    fingerprints is joined with itself and the Hamming distance verified.  In a
    hotter key, each fingerprint sends itself and its one-bit variants outside
    the key's bits: two fingerprints differ in at most 2 bits exactly if they
    send a common variant, so all that sent one are linked to the least of them
    (every such link is within 2 bits).  That is exact and linear, so no key's
    pairs are ever enumerated and nothing is capped.

    `distinct` has one column `fp` of distinct values.
    """
    if distance != 2:
        raise ValueError("the blocks and midpoints are laid out for a distance of 2")
    masks = _block_masks(distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.t", "s.k")
    # Tables on both sides of a join let adaptive execution split a hot key.
    counts = write_table(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    shared = write_table(keyed.join(counts, ["t", "k"]), "simhash-shared")
    few, hot = shared.filter(F.col("n") <= PAIRED), shared.filter(F.col("n") > PAIRED)
    left, right = few.select("t", "k", F.col("fp").alias("a")), few.select("t", "k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["t", "k"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    ones = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64) if not m >> i & 1]) for m in masks])
    sent = hot.select("fp", "t", F.explode(ones[F.col("t").cast("int")]).alias("bit"))
    sent = sent.select("fp", "t", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    least = sent.groupBy("t", "mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = sent.join(least, ["t", "mid"]).filter("a < fp").select("a", F.col("fp").alias("b"))
    found = write_table(pairs.union(stars).distinct(), "simhash-links")
    drop_table(counts, shared)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is its component's least node.

    Large-star and small-star rounds on joins and minima, until every component
    is a star around its least node; each round is written to the shared
    folder, so lineage stays short and nothing is collected.
    """

    def settled(e: DataFrame) -> bool:
        """No node has two parents, or a parent and a child."""
        ends = e.select(F.col("b").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("a", F.lit(0), F.lit(1)))
        per = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return per.filter("up > 1 or up = 1 and down = 1").isEmpty()

    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = write_table(edges, "components")
    while not settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        # Tables on both sides of a join let adaptive execution split a hot key.
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = write_table(large.filter("a < b").distinct(), "components")
        drop_table(low, edges)
        low = write_table(large.groupBy("b").agg(F.min("a").alias("m")), "components")
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = write_table(small.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "components")
        drop_table(low, large)
    tree = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    tree = write_table(tree.union(edges.select("a", "a")).distinct(), "components")
    drop_table(edges)
    return tree


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2
) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    component_id is the least id reachable over links of fingerprints that
    differ in at most `distance` bits, the row's own included.  Rows without
    words (null, empty, blanks) have fingerprint 0 and link like any other;
    equal rows are all kept; a null id is never a component's least id unless
    all are null; an empty table gives an empty result; further columns are
    ignored.
    """
    rows = write_table(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = write_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = links(distinct.select("fp"), distance)
    tree = components(edges)
    linked = write_table(tree.join(distinct, tree.node == distinct.fp).select("fp", "root", "first"), "simhash-tree")
    least = write_table(linked.groupBy("root").agg(F.min("first").alias("least")), "simhash-tree")
    reached = linked.join(least, "root").select("fp", "least")
    found = distinct.join(reached, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    found = write_table(found, "simhash-found")
    drop_table(edges, tree, linked, least, distinct)
    return rows.join(found, "fp").select("id", "fp", "component_id")


def _shingles(text: bytes | None, width: int) -> tuple[bytes, np.ndarray]:
    """128-bit digest of the folded words and the sorted set of 64-bit hashes of their shingles."""
    words = text.translate(_FOLD).split() if text else []
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return digest, np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):  # order counts: the sum so far is mixed before each word
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return digest, np.unique(out ^ (out >> np.uint64(31)))


def _band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minimal hashes of a shingle set; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        part = np.multiply.outer(short[at : at + 2048], _TIMES)
        part += _PLUS
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def _fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; 0 for an empty set."""
    parts = [shingles[at : at + _AT_ONCE] for at in range(0, len(shingles), _AT_ONCE)]
    return _majority(sum(map(_votes, parts), np.zeros(64, np.int64)), len(shingles))


def _signatures(rows: DataFrame) -> DataFrame:
    """(id, hash, node, size, fp, keys) of rows (id, hash, text): digest of the words, shingles, SimHash, band keys."""
    kind = rows.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(node, len(sh), _fingerprint(sh), _band_keys(sh)) for node, sh in (_shingles(x.as_py(), WIDTH) for x in b.column(2))]
            nodes, sizes, fps, keys = zip(*found, strict=True) if found else ((), (), (), ())
            more = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *more], ["id", "hash", "node", "size", "fp", "keys"])

    return rows.mapInArrow(signed, f"id {kind}, hash long, node binary, size long, fp long, keys array<long>")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of nodes (n, size, fp) by the links of their fingerprints, n and size of either.

    The least node of a fingerprint stands for it in the links and is paired
    with the others that have the same one.
    """
    some = nodes.filter("size > 0").select("n", "size", "fp")  # no words: one node
    firsts = write_table(some.groupBy("fp").agg(F.min(F.struct("n", "size")).alias("first")), "simhash-firsts")
    edges = links(firsts.select("fp"))
    equal = some.join(firsts, "fp").filter("n != first.n").select("first", F.struct("n", "size").alias("second"))
    one, two = (firsts.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "first"), ("b", "second")))
    near = edges.join(one, "a").join(two, "b").select("first", "second")
    pairs = equal.union(near).select(F.least("first", "second").alias("x"), F.greatest("first", "second").alias("y"))
    pairs = write_table(pairs.select(F.col("x.n").alias("a"), F.col("x.size").alias("na"), F.col("y.n").alias("b"), F.col("y.size").alias("nb")), "simhash-pairs")
    drop_table(edges, firsts)
    return pairs


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of SIMILAR or more."""
    right = pairs.join(texts.select(F.col("n").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("n").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x = x.as_py()
                if x != last:  # rows come sorted by a, or in runs of it
                    last, one = x, _shingles(x, WIDTH)[1]
                two = _shingles(y.as_py(), WIDTH)[1]
                n = len(np.intersect1d(one, two, assume_unique=True))
                good.append(n >= SIMILAR * (len(one) + len(two) - n))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return write_table(both.mapInArrow(compared, "a long, b long"), "jaccard-links")


def _sizes_allow(small: str, large: str) -> Column:
    return F.col(small) >= F.col(large) * SIMILAR - 1e-9


def _parities(shingles: np.ndarray) -> list[int]:
    """For each of 64 * SKETCH classes of hashes, whether a set has an odd number of it, as bits of signed integers."""
    odd = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _prefix_links(sets: DataFrame, tree: DataFrame) -> DataFrame:
    """`tree` with the links between sets (n, size, sh, odd) of its components: an exact prefix-filter join.

    Shingles are ordered from rare to frequent.  Of two sets with a similarity
    of SIMILAR or more the smaller has a common shingle among its first
    size - 2s/(1+s) size + 1, the larger among its first size - s size + 1.  A
    passage that many texts hold comes last in that order, so it makes
    candidates only of texts that consist of little else.  Shingles of one text
    alone make none and only take places.  Sets that differ in d shingles differ
    in at most d parities, so the join drops pairs that differ in too many.

    A pair is needed at its first common key only.  There all common shingles
    are still to come, which bounds their number by the places left in either
    set; and no key before it is common, so a pair whose EARLIER last keys meet
    was found before.  Both tests hold at the first common key of every link.
    """
    each = sets.select("n", F.explode("sh").alias("sh"))
    df = write_table(each.groupBy("sh").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "prefix-df")
    some = each.join(df, "sh").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("some"))  # one text's
    some = some.join(sets.select("n", "size", "odd"), "n")
    places = F.col("size") - F.size("some")  # taken by shingles that no other set has
    long = F.col("size") - F.ceil(F.col("size") * SIMILAR - 1e-9) + 1 - places
    short = F.col("size") - F.ceil(F.col("size") * (2 * SIMILAR / (1 + SIMILAR)) - 1e-9) + 1 - places
    first = F.slice("some", 1, F.greatest(long, F.lit(0)).cast("int"))
    some = some.filter(long > 0).select("n", "size", "odd", short.alias("short"), places.alias("places"), F.transform(first, lambda x: x.sh).alias("some"))

    def key(k: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), k.alias("k"), F.array(*[F.get("some", at - i) for i in range(1, EARLIER + 1)]).alias("before"))

    keys = some.select("n", "size", "odd", "short", "places", F.inline(F.transform("some", key)))
    keys = keys.select("k", "n", "size", "odd", (F.col("at") < F.col("short")).alias("short"), (F.col("size") - F.col("places") - F.col("at")).alias("rest"), "before")
    keys = write_table(keys, "prefix-keys")
    drop_table(df)
    starred, last = False, False
    while not last:
        rooted = keys.join(tree, keys.n == tree.node, "left").select("k", "n", "size", "odd", "short", "rest", "before", F.coalesce("root", "n").alias("root"))
        rooted = write_table(rooted, "prefix-rooted")
        per = rooted.groupBy("k", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "size")).alias("c"))
        main = per.groupBy("k").agg(F.max(F.struct("m", "root", "c")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("m").alias("m"))
        main = write_table(main.filter("roots > 1").select("k", "main", "m"), "prefix-main")
        product, rows = main.agg(F.sum(F.expr("(m - main.m) * m")), F.sum("m")).first()
        if not product:
            drop_table(rooted, main)
            break
        mixed = rooted.join(main.select("k", "main"), "k")
        # Where that is much work, one of the largest component is compared with all others first, once: linear.
        last = starred or product <= DENSE * rows
        if not last:
            found = mixed.filter("root != main.root").select(F.col("main.c.n").alias("a"), F.col("main.c.size").alias("na"), F.col("n").alias("b"), F.col("size").alias("nb"))
            found = found.filter(_sizes_allow("na", "nb") & _sizes_allow("nb", "na"))
        else:
            mixed = write_table(mixed.withColumn("main", F.col("main.root")), "prefix-mixed")

            def side(t: DataFrame, x: str, *more: str) -> DataFrame:
                return t.select("k", *more, *[F.col(c).alias(f"{c}_{x}") for c in ("n", "size", "root", "odd", "rest", "before")])

            small, large = side(mixed.filter("short"), "a", "main"), side(mixed, "b")
            other = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(SKETCH)), F.lit(0))
            both = F.col("size_a") + F.col("size_b")
            near = other <= both * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-9
            near = near & (F.col("size_a") <= F.col("size_b")) & _sizes_allow("size_a", "size_b")
            near = near & (F.least("rest_a", "rest_b") >= both * (SIMILAR / (1 + SIMILAR)) - 1e-9)
            near = near & ~F.coalesce(F.arrays_overlap("before_a", "before_b"), F.lit(False))

            def joined(one: DataFrame, two: DataFrame, near: Column = near) -> DataFrame:
                pairs = one.join(two, (one.k == two.k) & (F.col("root_a") != F.col("root_b")) & near)
                return pairs.select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))

            found = joined(small.filter("root_a != main"), large).union(joined(small.filter("root_a = main"), side(mixed.filter("root != main"), "b")))
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = write_table(found, "prefix-pairs")
        one, two = sets.select(F.col("n").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("n").alias("b"), F.col("sh").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        alike = both >= SIMILAR * (F.size("sa") + F.size("sb") - both)
        more = write_table(found.join(two, "b").join(one, "a").filter(alike).select("a", "b"), "prefix-links")
        starred = True
        stars = tree.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        new = components(stars.union(more))
        drop_table(rooted, main, mixed, found, more, tree)
        tree = new
    drop_table(keys)
    return tree


def jaccard_components(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) for the nodes that a link of Jaccard similarity SIMILAR or more reaches.

    `nodes` has one row per distinct text: n, size (of its shingle set), fp (its
    SimHash) and keys (of its bands).  `texts_of` gives (n, text) for rows with a
    column n.  Texts whose fingerprints are linked, or that share a band key, are
    candidates and every link is verified.  First the links of fingerprints are
    taken and all members of a key are compared with its least one.  Then the
    members of keys that hold more than one component go through an exact
    prefix-filter join between components.  No candidate link of a key is lost,
    and neither a group of near copies nor a passage that many texts hold costs
    its square.
    """
    hashed = _simhash_pairs(nodes)
    keyed = nodes.select("n", "size", F.explode("keys").alias("k"))
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "size")).alias("first")).filter("m > 1")
    counts = write_table(counts.select("k", "first"), "minhash-keys")
    shared = write_table(keyed.join(counts, "k"), "minhash-shared")
    drop_table(counts)
    pairs = shared.filter("n != first.n").select(F.col("first.n").alias("a"), F.col("n").alias("b"), F.col("first.size").alias("na"), F.col("size").alias("nb"))
    pairs = pairs.union(hashed.select(pairs.columns)).filter(_sizes_allow("na", "nb") & _sizes_allow("nb", "na"))
    pairs = write_table(pairs.select("a", "b").distinct(), "minhash-pairs")
    drop_table(hashed)
    texts = write_table(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()), "minhash-texts")
    edges = _similar(pairs, texts)
    drop_table(pairs, texts)
    tree = components(edges)
    drop_table(edges)
    rooted = shared.select("k", "n").join(tree, shared.n == tree.node, "left").select("k", "n", F.coalesce("root", "n").alias("root"))
    mixed = rooted.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("k")
    left = write_table(shared.join(write_table(mixed, "minhash-mixed"), "k").select("n").distinct(), "minhash-left")
    drop_table(shared)
    if left.isEmpty():
        return tree

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(x.as_py(), WIDTH)[1].view(np.int64) for x in b.column(1)]
            odd = [_parities(x.view(np.uint64)) for x in sets]
            columns = [b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "size", "sh", "odd"])

    sets = write_table(texts_of(left).mapInArrow(cut, "n long, size long, sh array<long>, odd array<long>"), "prefix-sets")
    tree = _prefix_links(sets, tree)
    drop_table(sets, left)
    return tree


def _marked(rows: DataFrame, cols: list[str], keys: DataFrame, mark: str) -> DataFrame:
    """`rows` with a column `mark`: false only where no row of `keys` has the values in `cols`.

    The first columns of `keys` are those of `cols`, of the same types.  A bitmap
    of their hashes, 16 bits or more a key up to MAP words, is broadcast; beyond
    that more rows are marked than need be.  So what is marked takes an exact
    join, and what is not is spared its shuffle.
    """
    words, n = 1, keys.count()
    while words < MAP and 4 * words < n:
        words *= 2
    slot, bits = fresh(rows, "_slot", "_bits")

    def place(h: Column) -> Column:
        return h.bitwiseAND(F.lit(words - 1))

    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))

    key = F.xxhash64(*[F.col(f"`{c}`") for c in keys.columns[: len(cols)]])
    bitmap = keys.select(place(key).alias(slot), bit(key).alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    own = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    there = F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False))
    joined = rows.join(F.broadcast(bitmap), place(own) == F.col(slot), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], there.alias(mark))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each component of near duplicates: the one of the least id, a null id coming last.

    Two rows are near duplicates if their A-Z-folded words are the same, or if
    the sets of their WIDTH-word shingles (the whole text, if shorter) have a
    Jaccard similarity of SIMILAR or more.  Candidates are, as in op10, texts
    whose SimHash fingerprints (of those shingles) lie within 2 bits.  At that
    similarity they lie up to 11 bits and more apart, so the rest comes from
    MinHash bands: a pair of similarity 0.8 shares one with probability 0.99993,
    a closer pair more surely.

    Rows are judged by (id, text): different texts under one id stay apart, of
    rows equal in both one stays (the one of the least hash of all columns).
    Rows without words are copies of each other.  An empty table gives an empty
    result; all columns stay as they are.
    """
    key, mark = fresh(docs, "_hash", "_mark")
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), hashed.alias("hash"), text.alias("text"))
    signed = write_table(_signatures(rows), "minhash")
    order = F.struct(F.col("id").isNull().alias("unknown"), "id", "hash")
    nodes = signed.groupBy("node").agg(F.min(order).alias("first"), F.max("size").alias("size"), F.max("fp").alias("fp"), F.max("keys").alias("keys"))
    nodes = write_table(nodes.withColumn("n", F.monotonically_increasing_id()), "minhash-nodes")
    again = signed.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id", "hash")
    again = write_table(again, "minhash-again")
    repeats = not again.isEmpty()

    def texts_of(wanted: DataFrame) -> DataFrame:
        named = nodes.join(wanted, "n").select(F.col("first.id").alias("i"), F.col("first.hash").alias("h"), "n")
        named = write_table(named, "minhash-wanted")
        some = _marked(rows, ["id", "hash"], named, "_mark").filter("_mark")
        found = some.join(named, some.id.eqNullSafe(named.i) & (some.hash == named.h)).select("n", "text")
        return found.dropDuplicates(["n"]) if repeats else found  # equal (id, text): any of them

    tree = jaccard_components(nodes.select("n", "size", "fp", "keys"), texts_of)
    rooted = nodes.join(tree, nodes.n == tree.node, "left").select(nodes.node, "first", F.coalesce("root", "n").alias("root"))
    rooted = write_table(rooted, "minhash-rooted")
    kept = write_table(rooted.groupBy("root").agg(F.min("first").alias("kept")), "minhash-kept")
    judged = write_table(rooted.join(kept, "root").select("node", "kept"), "minhash-judged")
    other = ~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("hash") == F.col("kept.hash")))
    gone = write_table(signed.join(judged, "node").filter(other).select("id", "hash").distinct(), "minhash-gone")
    drop_table(tree, rooted, kept, judged, nodes, signed)
    docs_keyed = _marked(docs.withColumn(key, hashed), [id_col, key], gone.union(again) if repeats else gone, mark)
    alone, judged = docs_keyed.filter(~F.col(mark)).drop(mark), docs_keyed.filter(F.col(mark)).drop(mark)

    def on(t: DataFrame) -> Column:
        return judged[id_col].eqNullSafe(t.id) & (judged[key] == t.hash)

    left = judged.join(gone, on(gone), "left_anti")
    if repeats:
        once = left.join(again, on(again), "left_anti")
        more = judged.join(again, on(again), "left_semi").join(gone, on(gone), "left_anti")
        whole = F.struct(*[F.col(f"`{c}`") for c in judged.columns])
        more = more.groupBy(id_col, key).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_r")).select("_r.*")
        left = once.unionByName(more)
    return alone.unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
