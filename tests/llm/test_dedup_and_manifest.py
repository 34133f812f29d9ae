"""Exact deduplication and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from driftframe.llm import exact_dedup, merkle, queries


def plain_groups(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) for (doc_id, text)."""
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_groups(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


def corpus():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", None, "", "Hot", "hot ", "x" * 40_000, f"t{rnd.randint(0, 60)}", f"own {i}"])) for i in range(400)]
    return [*rows, (7, rows[7][1]), (None, "hot"), (None, "only null"), (None, "only null"), (399, rows[399][1])]


def test_groups_against_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, bucket int")
    want = plain_groups(rows)
    assert got_groups(exact_dedup.groups(docs)) == want
    # small buckets, so that the directory doubles to several depths, and keys of few bits, so that most collide
    assert got_groups(exact_dedup.groups(docs, min_bytes=200)) == want
    assert got_groups(exact_dedup.groups(docs, min_bytes=500, bits=3)) == want
    assert got_groups(exact_dedup.groups(docs, bits=0, heavy=2)) == want


def test_directory_splits_what_is_overfull_and_nothing_else(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), F.when(F.xxhash64("id") < 0, 9).otherwise(1).cast("long").alias("bytes"))
    where = exact_dedup.directory(keys, 900)
    assert abs(sum(2.0 ** -r["depth"] for r in where.collect()) - 1) < 1e-12 and where.select("depth").distinct().count() > 1
    sizes = exact_dedup.owned(keys, where).groupBy("bucket").agg(F.sum("bytes").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    assert sizes.where("b > 900").isEmpty()
    # unsigned order: buckets are ranges of keys that don't overlap
    ranges = sorted((r["lo"] % 2**64, r["hi"] % 2**64) for r in sizes.select(F.col("bucket").alias("lo"), "hi").collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_keep_carries_all_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k", True) for i, t in rows], "doc_id long, text string, key string, kept boolean")
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in rows})
    empty = docs.limit(0)
    assert exact_dedup.keep(empty).count() == 0 and exact_dedup.groups(empty).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for each leaf the list of (place, others) upwards."""
    level, of, out = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, j in enumerate(of):
            run = level[j // 3 * 3 : j // 3 * 3 + 3]
            out[i].append((j % 3, run[: j % 3] + run[j % 3 + 1 :]))
            of[i] = j // 3
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], out


def plain_manifest(rows):
    """Sorted results for rows of (doc_id, source, lang, n_chars, text)."""
    counted = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        gone = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        later = r[4].replace("\n", "") if gone and r[4] is not None else r[4]
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(counted, r)), H(*map(counted, (*r[:4], later))), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = plain_tree([x[2] for x in by[s]])
    top, tails = plain_tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for x, path in zip(by[s], trees[s][1], strict=True):
            path, node = [*path, *tails[k]], x[3]
            for at, others in path:
                node = H(*others[:at], node, *others[at:])
            out.append((x[4], x[2], trees[s][0], top, H(*(o for _, others in path for o in others)), node, node == top))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got_manifest(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def test_manifest_against_a_plain_version(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([i, i, i, 5, None, 2**60 + i]), rnd.choice(["a", "a", "a", "", None, "é", "b", f"s{i}"]), rnd.choice(["en", None]), rnd.choice([None, i]), rnd.choice([None, "", "x\ny", "é\n" * 9, "z" * 9000])) for i in range(300)]
    rows += rows[:20]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int")
    want = plain_manifest(rows)
    assert got_manifest(merkle.manifest(docs, tampered())) == want
    assert got_manifest(merkle.manifest(docs, tampered(), height=1)) == want  # paths over many small blocks
    assert got_manifest(merkle.manifest(docs, tampered(), height=2)) == want
    one = docs.limit(1)
    assert [r["root"] == r["leaf"] and r["proof_sha256"] == H() for r in merkle.manifest(one).collect()] == [True]
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_query_against_a_plain_version(spark):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got_manifest(queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")) == plain_manifest(rows)


def test_traversal_holds_few_nodes_and_never_lags():
    for n in (1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100, 728, 729, 730, 2187):
        leaves = [H(str(i)) for i in range(n)]
        root, want = plain_tree(leaves)
        walk = merkle.Traversal(leaves, merkle.levels(n))
        assert list(walk) == want and merkle.root(leaves, merkle.levels(n)) == root
        assert walk.held <= 5 * merkle.levels(n) and walk.late == 0
