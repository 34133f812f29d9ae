"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is its sequence of 5-word shingles, each labelled with how often it has occurred before, so that a
text is a set without losing repeats. For each of ``SKETCHES`` random orders the ``SAMPLED`` smallest
shingles are taken *in the order of the text* and hashed: two texts share the sketch if they share these
shingles and their order. Two texts are linked if an alignment of their shingle sequences matches at least
``threshold`` of all shingles, matched / (all - matched), which no reordering can reach. Classes are the
connected components of the links.

Scale: equal texts are one text from the start. Texts stay where they are; sketches travel, and later the
word hashes of texts that share a sketch with another one. Texts that share a sketch are a bucket. In the first
round all members of a bucket are compared with its most popular one, the one that meets most others over all
buckets, so comparisons grow with the members of a bucket, not with their pairs. Then ``ROUNDS`` rounds follow in
which a few members of each component in a bucket, drawn anew each time, are compared with a few pivots. Pivots
and members drawn come from aggregates with map-side sums, so a bucket with a third of all rows is spread over
all tasks; a round's links are closed over the components of the one before, so links are gone through once. All
that spares the exact join work, no more. Components that then still share a bucket go through that: in a common order of shingles, rare ones first, two similar texts share one among the first few of
each, at places that leave enough to match. So each pair that shares a sketch is in one component or proven
unlike; two texts at the threshold share some 16 sketches, and none with a probability near 1e-10.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.text import forget, stored
from driftframe.operators.linking import components

SHINGLE = 5
SKETCHES = 32
SAMPLED = 3
THRESHOLD = 0.8
#: Rounds after the first; in each, pivots of a bucket, and members of a component in it.
ROUNDS, PIVOTS, DRAWN = 2, 4, 2
#: Members of a component in a bucket among which rounds draw.
HEADS = 8
#: Of a text's shingles at alignment, those that occur oftener than this and its length / COMMON have ready bit rows.
COMMON = 512
SEED = 11
#: The words of so many texts are looked up by broadcast, of more by a shuffle. What is broadcast are their keys, under
#: 100 bytes each, so 20 MB at most.
BROADCAST_TEXTS = 200_000
#: Shingles that a worker hands on at once.
HELD = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd multipliers: each orders 64-bit hashes in its own way.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    """word -> 32-bit hash, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = xxhash.xxh32_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str, hashes: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, WORD.findall(text)), dtype=np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, in order; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n, w = max(1, len(words) - SHINGLE + 1), words.astype(np.uint64)
    h = np.full(n, np.uint64(min(len(words), SHINGLE)))
    for i in range(min(SHINGLE, len(words))):
        h = _mixed(h * _A + w[i : i + n])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of their earlier occurrences worked in, so all are different."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.arange(len(s))
    start = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0)) if len(s) else at
    out = np.empty_like(h)
    out[order] = _mixed(s + (at - start).astype(np.uint64) * _C)
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """One hash for each order: of the smallest labelled shingles, as they follow each other in the text."""
    n, out = min(SAMPLED, len(h)), np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // len(h))
    for k in range(0, SKETCHES, step):
        keys = h[None, :] * ORDERS[k : k + step, None]
        keys ^= keys >> np.uint64(31)
        at = np.sort(np.argpartition(keys, n - 1, axis=1)[:, :n], axis=1) if len(h) > n else np.tile(np.arange(n), (len(keys), 1))
        v = np.arange(k, k + len(keys), dtype=np.uint64)
        for i in range(n):
            v = _mixed(v * _A + h[at[:, i]])
        out[k : k + step] = v
    return out.view(np.int64)


def distance(a: list[int], b: list[int], most: int) -> int | None:
    """Insertions and deletions that turn a into b, if at most ``most``.

    An alignment with so few stays in a band of diagonals. The table of common subsequences is kept as one bit for
    each place of ``a`` (0 where the length grows), and a row of it is one addition of whole numbers; rows go by in
    blocks, each over the places that the band reaches from it.
    """
    n, m = len(a), len(b)
    low, high = (n - m - most) // 2, (n - m + most) // 2  # of place in a less place in b
    if abs(n - m) > most:
        return None
    where: dict[int, list[int]] = {}
    for i, v in enumerate(a):
        where.setdefault(v, []).append(i)
    ready = {v: sum(1 << i for i in at) for v, at in where.items() if len(at) > max(16, n // COMMON)}
    rows, block = (1 << n) - 1, max(64, min(high - low, n))
    for top in range(0, m, block):
        left, right = max(0, top + low), min(n, top + block + high + 1)
        if left >= right:
            continue
        full = (1 << (right - left)) - 1
        own = (rows >> left) & full
        common: dict[int, int] = {}
        for v in b[top : top + block]:
            at = where.get(v)
            if at is None:
                continue
            if v in ready:
                match = common[v] if v in common else common.setdefault(v, (ready[v] >> left) & full)
            else:
                match = 0
                for i in at:
                    if left <= i < right:
                        match |= 1 << (i - left)
            met = own & match
            if met:
                own = ((own + met) | (own - met)) & full
        rows = (rows & ~(full << left)) | (own << left)
    found = n + m - 2 * (n - rows.bit_count())
    return found if found <= most else None


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether aligned shingles make up ``threshold`` of all shingles of two texts given as word hashes."""
    x, y = shingles(a), shingles(b)
    total = len(x) + len(y)
    need = threshold * total / (1 + threshold)
    if min(len(x), len(y)) < need - 1e-9:
        return False
    if len(np.intersect1d(labelled(x), labelled(y), assume_unique=True)) < need - 1e-9:
        return False  # an alignment can't match more than what both have
    most, least = int(total - 2 * need + 1e-9), min(len(x), len(y))
    head = int(np.argmin(np.r_[x[:least] == y[:least], False]))
    x, y = x[head:], y[head:]
    least = min(len(x), len(y))
    tail = int(np.argmin(np.r_[x[::-1][:least] == y[::-1][:least], False]))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    return distance(x.tolist(), y.tolist(), most) is not None


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, sketch`` of every row: a hash of the text, its number of shingles, its sketch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in parts:
            n, out = [], []
            for value in part.column(2):
                h = labelled(shingles(word_hashes(value.as_py() or "", hashes)))
                n.append(len(h))
                out.append(sketch(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(run, "doc_id long, key binary, n int, sketch array<long>")


def words_of(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``tid, words`` (32-bit word hashes as bytes) for ``texts``: ``tid, first_id, key``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([word_hashes(v.as_py(), hashes).astype("<u4").tobytes() for v in part.column(1)], pa.binary())], names=["tid", "words"])

    wanted = texts.select("tid", "first_id", F.col("key").alias("t_key"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    found = own.join(wanted, (F.col("key") == F.col("t_key")) & F.col("id").eqNullSafe(F.col("first_id")))
    return found.select("tid", "text").mapInArrow(run, "tid long, words binary").dropDuplicates(["tid"])


def buckets(texts: DataFrame) -> DataFrame:
    """``bucket, tid, n, popular`` of texts that share a sketch with another."""
    each = texts.select("tid", "n", F.explode("sketch").alias("bucket"))
    sizes = each.groupBy("bucket").count().where(F.col("count") > 1)
    shared = stored(each.join(sizes, "bucket"))
    popular = shared.groupBy("tid").agg(F.sum("count").alias("popular"))
    members = stored(shared.join(popular, "tid").select("bucket", "tid", "n", "popular"))
    forget(shared)
    return members


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose texts are similar."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            same = [similar(*(np.frombuffer(w.as_py(), "<u4") for w in both), threshold) for both in zip(part.column(2), part.column(3), strict=True)]
            yield part.select([0, 1]).filter(pa.array(same, pa.bool_()))

    w = lambda side: words.select(F.col("tid").alias(side), F.col("words").alias(f"w_{side}"))
    return pairs.join(w("a"), "a").join(w("b"), "b").select("a", "b", "w_a", "w_b").mapInArrow(run, "a long, b long")


def closed(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``tid, root``) after ``links`` (``a, b``) have joined their components."""
    of = lambda side: roots.select(F.col("tid").alias(side), F.col("root").alias(f"r_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("r_a <> r_b").select(F.col("r_a").alias("src"), F.col("r_b").alias("dst"))
    new = components(edges).withColumnRenamed("root", "top")
    return stored(roots.join(new, F.col("root") == F.col("node"), "left").select("tid", F.coalesce("top", "root").alias("root")))


def shingled(texts: DataFrame) -> DataFrame:
    """``tid, root, n, shingle``: the labelled shingles of ``texts`` (``tid, root, words``)."""
    schema = pa.schema([("tid", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("shingle", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for tid, root, words in zip(*part.columns, strict=True):
                h = labelled(shingles(np.frombuffer(words.as_py(), "<u4"))).view(np.int64)
                for k in range(0, len(h), HELD):
                    some = h[k : k + HELD]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), v), t) for v, t in ((tid.as_py(), pa.int64()), (root.as_py(), pa.int64()), (len(h), pa.int32()))] + [pa.array(some)], schema=schema)

    return texts.select("tid", "root", "words").mapInArrow(run, "tid long, root long, n int, shingle long")


def rest(members: DataFrame, roots: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The links ``a, b`` between components of which any share a bucket, by a prefix-filter join.

    A text can only match another with ``threshold`` of its own shingles or more, so of two similar texts each has
    the first shingle that both have among its first ``n - ceil(threshold n) + 1``. A shingle's places in the two
    bound what can still match from there. Members of the component that has most texts with a shingle don't meet
    each other, so a group of near copies that is already one component isn't compared with itself.
    """
    held = stored(members.join(roots, "tid").select("bucket", "root").distinct())
    mixed = held.groupBy("bucket").count().where(F.col("count") > 1).select("bucket")
    live = roots.join(held.join(mixed, "bucket", "left_semi").select("root").distinct(), "root", "left_semi")
    of_text = Window.partitionBy("tid")
    each = stored(shingled(live.join(words, "tid")))
    # summed before they are shuffled, so a shingle that very many texts have is a row of each task, and joined back
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("texts > 1")
    each = each.join(common, "shingle")
    # a text's shingles that no other has come first; of the others, only their number is needed
    each = each.withColumn("place", F.col("n") - F.count(F.lit(1)).over(of_text) + F.row_number().over(of_text.orderBy("texts", "shingle")) - 1)
    prefix = stored(each.where((F.col("lo") != F.col("hi")) & (F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9))).select("shingle", "tid", "root", "n", "place"))
    main = prefix.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    prefix = stored(prefix.join(main.where("roots > 1"), "shingle"))
    x = prefix.where(F.col("root") != F.col("main")).select("shingle", F.col("tid").alias("xt"), F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("place").alias("xp"))
    need = threshold * (F.col("n") + F.col("xn")) / (1 + threshold) - 1e-9
    enough = F.least(F.col("n") - F.col("place"), F.col("xn") - F.col("xp")) >= need
    once = (F.col("root") == F.col("main")) | (F.col("tid") > F.col("xt"))
    met = prefix.join(x, "shingle").where((F.col("root") != F.col("xr")) & once & enough)
    pairs = met.select(F.least("tid", "xt").alias("a"), F.greatest("tid", "xt").alias("b")).distinct()
    return stored(verified(stored(pairs), words, threshold))


def some(own: DataFrame, n: int, *salt: Column) -> DataFrame:
    """``bucket, root, tid, n``: up to ``n`` members of each component in a bucket, drawn by a hash."""
    place = F.xxhash64("tid", *salt)
    first = F.min(F.struct(place.alias("place"), F.col("tid"), F.col("n"))).alias("m")
    return own.groupBy("bucket", "root", F.pmod(place, F.lit(n)).alias("draw")).agg(first).select("bucket", "root", "m.tid", "m.n")


def compared(own: DataFrame, pivots: DataFrame, slots: int, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of members (``bucket, root, tid, n``) and pivots (``bucket, p``: a list of them) that are
    neither in one component nor of too different lengths."""
    beside, pairs = own.join(pivots, "bucket"), None
    for k in range(slots):
        p = F.get("p", F.lit(k))
        near = F.least(F.col("n"), p["n"]) >= threshold * F.greatest(F.col("n"), p["n"]) - 1e-9
        one = beside.where((F.col("root") != p["root"]) & near).select(F.least(p["tid"], F.col("tid")).alias("a"), F.greatest(p["tid"], F.col("tid")).alias("b"))
        pairs = one if pairs is None else pairs.union(one)
    return pairs.distinct()


def linked(members: DataFrame, words: DataFrame, threshold: float, pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """``tid, root`` of all ``members`` (``bucket, tid, n, popular``): the component of each."""
    roots = stored(members.select("tid").distinct().select("tid", F.col("tid").alias("root")))
    first = members.groupBy("bucket").agg(F.min(F.struct(-F.col("popular"), "tid", "n", F.col("tid").alias("root"))).alias("p")).select("bucket", F.array("p").alias("p"))
    pairs = stored(compared(members.withColumn("root", F.col("tid")), first, 1, threshold))
    roots = closed(roots, stored(verified(pairs, words, threshold)))
    heads = stored(some(members.join(roots, "tid"), HEADS, F.col("bucket")))
    for no in range(rounds):
        own = stored(some(heads.drop("root").join(roots, "tid"), DRAWN, F.lit(no)))
        slot = F.pmod(F.xxhash64("root", F.lit(no)), F.lit(pivots)).alias("slot")
        best = own.groupBy("bucket", slot).agg(F.min(F.struct(F.xxhash64("tid", F.lit(no)), "tid", "n", "root")).alias("p")).groupBy("bucket").agg(F.collect_list("p").alias("p"))
        pairs = stored(compared(own, best, pivots, threshold))
        roots = closed(roots, stored(verified(pairs, words, threshold)))
    return closed(roots, rest(members, roots, words, threshold))


def classes(docs: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """``doc_id, key, class_id, kept`` for every row of ``docs`` (``doc_id, text``).

    ``class_id`` is the smallest doc_id of the class, null if no row of it has one. ``kept`` marks the rows
    with the class's smallest (doc_id, text hash), null ids last; it marks repeated rows together. A text
    without words (null, empty, blank) is its own class and kept. An empty table gives an empty result.
    """
    rows = stored(sketched(docs))
    worded = rows.where(F.col("n") > 0)
    texts = worded.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()))  # as written, so it doesn't change
    members = buckets(texts.select("tid", "n", "sketch"))
    narrow = texts.select("tid", "key", "first_id")
    some = narrow.join(members.select("tid").distinct(), "tid", "left_semi")
    words = stored(words_of(docs, some))
    roots = linked(members, words, threshold, pivots)
    narrow = narrow.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("key").alias("key"))).alias("first")
    heads = narrow.groupBy("root").agg(first)
    of_text = narrow.join(heads, "root").select(F.col("key").alias("t_key"), F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"))
    found = worded.join(of_text, F.col("key") == F.col("t_key"))
    kept = (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    blank = rows.where(F.col("n") == 0).select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.select("doc_id", "key", "class_id", kept.alias("kept")).unionByName(blank)


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class, all columns; rows without words stay."""
    marks = stored(classes(docs, threshold).where("kept").groupBy(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")).agg(F.count(F.lit(1)).alias("times")))
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(text)).alias("key"), (F.regexp_replace(text, r"[\x20\x09-\x0D]+", "") == "").alias("blank"))
    joined = own.join(marks, F.col("id").eqNullSafe(F.col("k_id")) & F.col("key").eqNullSafe(F.col("k_key")))
    several = (F.col("times") > 1) & ~F.coalesce("blank", F.lit(True))
    once = joined.where(several).dropDuplicates(["id", "key"])
    return joined.where(~several).select("row.*").unionByName(once.select("row.*"))
