"""Near-duplicates by BagMinHash (operator 3): weighted Jaccard of the multisets of five-word shingles, 0.8 or more.

Signature. The weight of a shingle, its count, is cut into dyadic level intervals (0,1], (1,2], (2,4], (4,8], ... Each
(shingle, interval) runs a Poisson process of points (time, position, level) whose rate is the interval's length; a point
counts if its level is at most the weight, and each of the ``BANDS * ROWS`` positions keeps its earliest point. Two
multisets agree at a position with the probability of their weighted Jaccard similarity, without bias. Points are drawn
in rising time, and a process stops once it is later than the latest position: about one draw a shingle in long texts.

Candidates. Equal texts are one node. Nodes that agree in all rows of a band share a bucket: at similarity 0.8 all 32
bands miss with probability 6e-5. A bucket is never expanded into all pairs; links are found in two steps, and in
the second only pairs of different components count:

1. Each member of a bucket is held against the bucket's pivot, its most connected member. A pair counts once over all
   buckets, so that is ``BANDS`` pairs a node at most, and about two where copies share most buckets.
2. What still lies in several components of one bucket is exhausted. Shingles are told apart by how many of these open
   nodes have them: at most ``RARE`` is rare. An overlap is at most the lesser number of common shingles plus the number of
   equal rare ones, and 0.8 asks for 4/9 of both sizes (and 0.8 of the larger). Nodes whose common shingles reach 0.8 of
   their size are joined by bucket under that bound. A node below must share rare shingles, so its rarest ones, one more
   than it can do without, are joined with those of all open nodes: at most ``RARE`` rows each. Both are exact: no pair of
   0.8 or more that shares a bucket is left out, and a large group of texts that aren't alike enough costs rows in
   proportion to its members.

Every pair is verified by its multiset overlap before it links anything. Components come from alternating large-star and
small-star steps on written tables; no link or component is collected.

Words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one shingle. Texts without words are alike only if
equal. Null text: a class of its own. Repeated rows share a class; null doc_ids count last for a class's id, and of ties
the least doc_id, then the least hash of its text, is kept. Very long texts are whole: all shingles count, a text is one
row of an Arrow batch. An empty table gives an empty result. Other columns are ignored or, by ``keep_one``, given back
as they came, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.llm.common import fresh, materialize, plainly, table

SHINGLE = 5
ROWS, BANDS = 6, 32
POSITIONS = ROWS * BANDS
#: Similarity, as a fraction, for exact comparison.
NUMERATOR, DENOMINATOR = 4, 5
#: Open nodes that a rare shingle has at most.
RARE = 128
#: Bits of the filter that keeps texts which no pair names from being shuffled: 4 MB.
FILTER_BITS = 1 << 25
#: Bytes of text taken at once.
SLICE = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_R = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


def _times(x: np.uint64, k: int) -> np.uint64:
    return np.uint64(int(x) * k & 0xFFFFFFFFFFFFFFFF)


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of its text. Prefix sums of a polynomial give all words at once."""
    joined = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    gap = _SEPARATES[joined]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = len(joined) + 1
    power = np.full(n, base)
    power[0] = 1
    back = np.full(n, inverse)
    back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    words = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _P)
    edges = np.cumsum([len(x) + 1 for x in texts])
    return words, np.searchsorted(edges, start, side="left")


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each different shingle, in this order."""
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts))
    s = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        s = _mix((s + words[k : k + len(s)]) * _P + np.uint64(k))
    whole = owner[: len(s)] == owner[SHINGLE - 1 : SHINGLE - 1 + len(s)]
    hashes, owners = [s[whole]], [owner[: len(s)][whole]]
    first = np.cumsum(n) - n
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        h = np.zeros(1, np.uint64)
        for k in range(n[d]):
            h = _mix((h + words[first[d] + k]) * _P + np.uint64(k + 100 * int(n[d])))
        hashes.append(h)
        owners.append(np.array([d]))
    hash_, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hash_, owner))
    hash_, owner = hash_[order], owner[order]
    new = np.ones(len(hash_), bool)
    new[1:] = (hash_[1:] != hash_[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hash_[at], np.diff(np.append(at, len(hash_)))


def signatures(owner: np.ndarray, hash_: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """texts x POSITIONS earliest points, as the bits of their times; all ones where a text has no shingle."""
    best = np.full(texts * POSITIONS, np.inf)
    units = [(owner, hash_, weight, 0)]
    j = 1
    while len(over := np.flatnonzero(weight > (1 << j - 1))):
        units.append((owner[over], hash_[over], weight[over], j))
        j += 1
    doc = np.concatenate([u[0] for u in units])
    seed = np.concatenate([_mix(u[1] + _times(_R, u[3])) for u in units])
    most = np.concatenate([u[2] for u in units])
    low = np.concatenate([np.full(len(u[0]), 0 if u[3] == 0 else 1 << u[3] - 1) for u in units])
    length = np.concatenate([np.full(len(u[0]), 1 if u[3] == 0 else 1 << u[3] - 1) for u in units])
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        r = _mix(seed + _times(_P, step + 1))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        later = best.reshape(texts, POSITIONS).max(1)
        going = time < later[doc]
        if not going.all():
            doc, seed, most, low, length, time, r = (x[going] for x in (doc, seed, most, low, length, time, r))
        r = _mix(r ^ _R)
        level = low + 1 + ((r >> np.uint64(40)).astype(np.int64) % length)
        position = (r & np.uint64(0xFFFFFF)).astype(np.int64) % POSITIONS
        counts = level <= most
        np.minimum.at(best, (doc * POSITIONS + position)[counts], time[counts])
        step += 1
    return best.view(np.uint64).reshape(texts, POSITIONS)


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles and band hashes of each text; those of a text without words mean nothing."""
    owner, hash_, weight = shingles(texts)
    n = np.bincount(owner, weights=weight, minlength=len(texts)).astype(np.int64)
    sig = _mix(signatures(owner, hash_, weight, len(texts)))
    bands = np.tile(np.arange(BANDS, dtype=np.uint64) * _R, (len(texts), 1))  # a hash names its band too
    for k in range(ROWS):
        bands = _mix((bands + sig[:, k::ROWS]) * _P)
    return n, bands.view(np.int64)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(docs: DataFrame) -> DataFrame:
    """node, n, bands of each row with words; a map without a shuffle of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, texts = batch.column("node"), [x.encode() for x in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                n, bands = describe(texts[a:b])
                out = pa.RecordBatch.from_pydict({"node": node.slice(a, b - a), "n": pa.array(n), "bands": pa.array(list(bands), pa.list_(pa.int64()))})
                yield out.filter(pa.array(n > 0))

    return docs.select("node", "text").mapInArrow(run, "node binary, n bigint, bands array<bigint>")


def elements(texts: DataFrame) -> DataFrame:
    """node, h: one row for each shingle and each time it occurs, told apart by a number, so that multisets are sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = batch.column("node"), [x.encode() for x in batch.column("text").to_pylist()]
            for a, b in _slices(own):
                owner, hash_, weight = shingles(own[a:b])
                before = np.cumsum(weight) - weight
                time = np.arange(weight.sum()) - np.repeat(before, weight)
                h = _mix(np.repeat(hash_, weight) + time.astype(np.uint64) * _R)
                yield pa.RecordBatch.from_pydict({"node": node.slice(a, b - a).take(pa.array(np.repeat(owner, weight))), "h": pa.array(h.view(np.int64))})

    return texts.select("node", "text").mapInArrow(run, "node binary, h bigint")


def only_needed(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose node may be in ``need``: through one bit a hash in a filter of ``FILTER_BITS`` bits.

    What is collected and broadcast is the filter, of a fixed size; the more nodes, the less it holds back.
    """
    bit = lambda: F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    words = need.select(bit().alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy().astype(np.int64)
            some = sent.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            yield batch.select(["node", "text"]).filter(pa.array(some.astype(bool)))

    return texts.select("node", "text", bit().alias("bit")).mapInArrow(run, "node binary, text string")


def texts_of(need: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the nodes in ``need`` (node, no repeats). ``texts``: node, text, several rows a node allowed."""
    own = only_needed(texts, need).groupBy("node").agg(F.first("text").alias("text"))
    return materialize(own.join(need, "node", "left_semi"), "texts")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. ``texts``: node, text, several rows a node allowed."""
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "need")
    own = texts_of(need, texts)
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            sides = [x.encode() for p in zip(left, right) for x in p]
            good = np.zeros(batch.num_rows, bool)
            for a, b in _even(sides):
                owner, hash_, weight = shingles(sides[a:b])
                edge = np.searchsorted(owner, np.arange(b - a + 1))
                for k in range(0, b - a, 2):
                    x, y = slice(edge[k], edge[k + 1]), slice(edge[k + 1], edge[k + 2])
                    _, i, j = np.intersect1d(hash_[x], hash_[y], assume_unique=True, return_indices=True)
                    least = np.minimum(weight[x][i], weight[y][j]).sum()
                    good[(a + k) // 2] = DENOMINATOR * least >= NUMERATOR * (weight[x].sum() + weight[y].sum() - least)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a binary, b binary")


def _even(sides: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    for _, b in _slices(sides):
        b += b % 2
        if b > start:
            yield start, b
            start = b


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that ``edges`` (a, b) name; root: the least node of its component."""
    stars = edges.select("a", "b")
    held = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        stars = small.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        stars = materialize(stars, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == held:
            break
        held = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links: only the components that these join are worked on."""
    placed = found
    for side in ("a", "b"):
        at = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        placed = placed.join(at, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    edges = materialize(placed.where("ra <> rb").select(*_pair("ra", "rb")).distinct(), "edges")
    if edges.isEmpty():
        return roots
    joint = materialize(components(edges), "joint")
    moved = roots.join(joint.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.union(joint.join(roots, "node", "left_anti").select("node", "root")), "roots")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """node, hash, root of the members of buckets that lie in several components."""
    placed = shared.where("size > 2").select("node", "hash").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("hash").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("hash")
    return materialize(placed.join(several, "hash"), "open")


def _exhausted(open_: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) across components that may reach 0.8: see step 2 above."""
    known = open_.select("node", "root").distinct().join(nodes.select("node", "n"), "node")
    each = materialize(elements(texts_of(known.select("node"), texts)), "elements")
    rare = materialize(each.join(each.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") <= RARE), "h"), "rare")
    of_node = rare.groupBy("node").agg(F.count("*").alias("r"), F.count_if(F.col("df") > 1).alias("r2"), F.collect_list(F.when(F.col("df") > 1, F.col("h"))).alias("rare"))
    nothing = F.array().cast("array<bigint>")
    held = known.join(of_node, "node", "left").select("node", "root", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("c"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("r2", F.lit(0)).alias("r2"), F.coalesce("rare", nothing).alias("rare"))
    held = materialize(held, "bounds")
    common = DENOMINATOR * F.col("c") >= NUMERATOR * F.col("n")
    both = DENOMINATOR + NUMERATOR
    alike = DENOMINATOR * F.least("x.n", "y.n") >= NUMERATOR * F.greatest("x.n", "y.n")
    apart = F.col("x.root") != F.col("y.root")
    # By bucket: all against the members outside the component that most of a bucket lies in.
    heavy = open_.select("node", "hash").join(held.where(common), "node")
    main = heavy.groupBy("hash", "root").agg(F.count("*").alias("k")).groupBy("hash").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("hash", "main")
    heavy = heavy.join(main, "hash")
    x, y = heavy.where("root <> main").alias("x"), heavy.alias("y")
    within = both * (F.least("x.c", "y.c") + F.size(F.array_intersect("x.rare", "y.rare"))) >= NUMERATOR * (F.col("x.n") + F.col("y.n"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.root") < F.col("y.root"))
    by_bucket = x.join(y, (F.col("x.hash") == F.col("y.hash")) & apart & once & alike & within)
    # By rare shingle: for nodes whose common shingles don't reach 0.8, which must share some.
    light = rare.join(held.where(~common).select("node", "root", "n", "c", "r", "r2"), "node")
    spare = F.col("r") - (F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) - F.col("c"))
    first = light.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))).where((F.col("place") <= spare + 1) & (F.col("df") > 1))
    x, y = first.alias("x"), rare.where("df > 1").join(held.select("node", "root", "n", "c", "r2"), "node").alias("y")
    within = both * (F.least("x.c", "y.c") + F.least("x.r2", "y.r2")) >= NUMERATOR * (F.col("x.n") + F.col("y.n"))
    by_shingle = x.join(y, (F.col("x.h") == F.col("y.h")) & apart & alike & within)
    return by_bucket.select(*_pair("x.node", "y.node")).union(by_shingle.select(*_pair("x.node", "y.node"))).distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts (a, b), enough for all components; and node, root from them.

    ``docs``: node, text without nulls.
    """
    nodes = materialize(features(docs).groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), "features")
    rows = nodes.select("node", F.explode("bands").alias("hash"))
    sizes = rows.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(rows.join(sizes, "hash"), "buckets")
    fame = shared.groupBy("node").agg(F.sum("size").alias("fame"))
    pivots = shared.join(fame, "node").groupBy("hash").agg(F.max_by("node", F.struct("fame", "node")).alias("p"))
    pairs = materialize(shared.join(pivots, "hash").where("node <> p").select(*_pair("node", "p")).distinct(), "pairs")
    found = materialize(verify(pairs, docs), "links")
    roots = materialize(components(found), "roots")
    more = materialize(_exhausted(_open(shared, roots), nodes, docs).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return found, roots
    proved = materialize(verify(more, docs), "links")
    return found.union(proved), merged(roots, proved)


def with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of texts with near-duplicates, and one row for each class: root, class_id, class_size, keeper."""
    keyed = with_node(docs.select("doc_id", "text").where("text IS NOT NULL"))
    _, roots = links(keyed.select("node", "text"))
    counted = keyed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    by_root = counted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # min ignores a struct's null field only by order: nulls go last.
    least = F.min(F.struct(F.col("first").isNull().alias("missing"), "first", "node")).alias("least")
    every = by_root.groupBy("root").agg(least, F.sum("copies").alias("class_size"))
    return roots, every.select("root", F.col("least.first").alias("class_id"), F.col("least.node").alias("keeper"), "class_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept, for each row of ``docs``."""
    roots, every = classes(docs)
    named = roots.join(every, "root").select("node", "class_id", "class_size", "keeper")
    alone = every.join(roots.select("root"), "root", "left_anti").select(F.col("root").alias("node"), "class_id", "class_size", "keeper")
    rows = with_node(docs.select("doc_id", "text")).select("doc_id", "node")
    out = rows.join(named.union(alone), "node", "left")
    kept = F.col("node").isNull() | ((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of ``docs``; rows with null text all stay. Of repeated
    rows whose other columns differ the one stays whose columns, as JSON text, are the least."""
    return plainly(docs, _keepers)


def _keepers(docs: DataFrame) -> DataFrame:
    node, count = fresh(docs, "node"), fresh(docs, "count")
    _, every = classes(docs)
    keepers = materialize(every.select("class_id", "keeper"), "keepers")
    rows = docs.withColumn(node, F.unhex(F.md5(F.col("text").cast("binary"))))
    same = rows.groupBy("doc_id", node).agg(F.count("*").alias(count)).where((F.col(count) > 1) & F.col(node).isNotNull())
    kept = rows.alias("r").join(keepers.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.class_id")) & (F.col(f"r.{node}") == F.col("k.keeper")), "left_semi")
    if not same.isEmpty():  # repeated rows of a keeper
        whole = F.struct(*docs.columns)
        kept = kept.groupBy("doc_id", node).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*", node)
    return kept.drop(node).union(docs.where("text IS NULL"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
ORACLES: dict[str, str] = {}
