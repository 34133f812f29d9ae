"""Mixing, rules, classifier, sharding, hosts: own fixtures with nulls, repeats, clashes and empty tables."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe.llm import host_reputation, mixture, quality_bayes, quality_rules, sharding

ODD = [(1, None, "a", "k"), (None, "", "b", "k"), (None, " a b ", "c", None), (2, "a", "c", None), (2, "a", "c", None), (3, "\n", None, "z"), (3, "x y\r" * 9, None, "z"), (4, "d " * 1000, "d", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, kept string")


def test_mix(spark, odd):
    r = mixture.mix(odd).toPandas()
    assert len(r) == len(ODD) and (r["taken"] <= 3 * r["size"]).all()
    by = r.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by["own"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())
    assert (by["taken"] - by["target"]).abs().max() <= 3 and (by["target"] <= 3 * by["own"]).all()
    again = mixture.mix(odd.repartition(7)).toPandas()
    key = lambda d: sorted(map(str, d.fillna(-1).itertuples(index=False)))
    assert key(r) == key(again)
    assert mixture.mix(odd.limit(0)).count() == 0 and mixture.repeated(odd).columns == odd.columns


def test_mix_of_a_hot_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    by = mixture.mix(docs, slots=1 << 14).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) < 0.01 * r["t"] for r in by)


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, "d": 700, "e": 0}
    got = {r["source"]: r["target"] for r in mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight, want = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}, {}
    rest, total = set(sizes), sum(sizes.values())
    while True:
        left = total - sum(want.values())
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            want |= {s: level * weight[s] for s in rest}
            break
        for s in over:
            want[s] = 3 * sizes[s]
            rest.remove(s)
    assert got == pytest.approx(want)


def brute_rules(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    again = {g for g in grams if grams.count(g) > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if g in again for k in range(3)})


def test_rules(spark, odd):
    texts = [*(r[1] for r in ODD), "a b a b a b a", "x y z x y z\n\nx y z\nx y z", "é ü é ü é\x0bü #* |", "one two", " lead and trail "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.apply_rules(d).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0
    plan = quality_rules.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_keep_clean_documents(spark):
    d = "/root/testdata/sf0.1"
    r = quality_rules.apply_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    by = {(x["quality"], x["kept"]): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) == 0 and by.get((0, True), 0) <= 0.02 * by[(0, False)]


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality_bayes.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    by = {(x["quality"], x["kept"]): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.01 * by[(1, True)] and by.get((0, True), 0) <= 0.05 * by[(0, False)]


def test_classifier_odd_cases(spark, odd):
    labels = spark.createDataFrame([(4, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    r = quality_bayes.classify(odd, labels).collect()
    assert len(r) == len(ODD) and all(0 <= x["score"] <= 1 for x in r)
    assert quality_bayes.classify(odd.limit(0), labels).count() == 0
    kept = quality_bayes.keep(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 5  # those with words


def plain_strength(children):
    """By moments, for (n, good, up) of each child."""
    if not children:
        return 1000.0
    all_, squares = sum(n for n, _, _ in children), sum(n * n for n, _, _ in children)
    each = sum(n * up * (1 - up) for n, _, up in children) / all_
    if not each or all_ * all_ <= squares:
        return 1000.0
    spread = (sum(n * (g / n - up) ** 2 for n, g, up in children) - (len(children) - 1) * each) / (all_ - squares / all_)
    return round(min(max(each / spread - 1, 1.0), 1000.0), 3) if spread > 0 else 1000.0


def test_strength_of_priors_is_that_of_the_scatter(spark):
    rng = np.random.default_rng(2)
    for true in (4.0, 30.0):
        n = rng.integers(20, 60, 4000)
        good = rng.binomial(n, rng.beta(0.4 * true, 0.6 * true, 4000))
        got = quality_bayes.strength(spark.createDataFrame([(int(a), float(b), 0.4) for a, b in zip(n, good, strict=True)], "n long, good double, up double"))
        assert got == pytest.approx(true, rel=0.2) and got == plain_strength([(int(a), int(b), 0.4) for a, b in zip(n, good, strict=True)])
    assert quality_bayes.strength(spark.createDataFrame([(10, 5.0, 0.5)] * 9, "n long, good double, up double")) == 1000.0


def test_shrinkage_of_sparse_sites(spark):
    rows = spark.createDataFrame([("big", i) for i in range(400)] + [("small", 400), ("small", 401)], "source string, doc_id long").withColumn("text", F.lit("same words in all of them"))
    labels = rows.select("doc_id", F.when(F.col("source") == "big", (F.col("doc_id") % 2)).otherwise(0).cast("int").alias("quality"))
    got = quality_bayes.classify(rows, labels).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.min("path_rate").alias("lo"), F.max("path_rate").alias("hi"))
    rates = {r["source"]: (r["lo"], r["hi"]) for r in got.collect()}
    # a document's own outcome is left out: the other one of "small" alone pulls its rate below the global one
    world = 200 / 402
    m = plain_strength([(400, 200, world), (2, 0, world)])
    assert rates["small"] == pytest.approx((m * world / (m + 1),) * 2) and all(abs(x - 0.5) < 0.01 for x in rates["big"])


def plain_features(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return [0.0] * len(quality_bayes.FEATURES)
    stop, chars, lines = set(quality_rules.STOP_WORDS), sum(map(len, w)), t.split("\n")
    count = lambda cs: sum(c in cs for c in t)
    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    return [
        math.log1p(len(w)), chars / len(w), count(quality_rules.SYMBOLS) / len(w), sum(x.lower() in stop for x in w) / len(w), upper / chars, count("!") / len(w), len(set(w)) / len(w),
        len(set(lines)) / len(lines), count("0123456789") / chars, count("|") / len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w),
    ]


def test_classifier_against_brute_force(spark):
    rnd = random.Random(8)
    good, bad = "the house of a river is in the small valley and we walk there".split(), "BUY now !!! $$$ win | win | 99 click #".split()
    docs, quality = [], {}
    for i in range(300):
        site = rnd.choice(["a.com/x/1", "http://A.com/y", "a.com", "b.org/p/q", "c.net", None])
        kind = rnd.random() < (0.2 if site == "a.com/x/1" else 0.7)
        text = rnd.choice([" ", "\n"]).join(rnd.choice(good if rnd.random() < (0.8 if kind else 0.3) else bad) for _ in range(rnd.randint(1, 40)))
        docs.append((i if i % 40 else i - 1, rnd.choice([text, text, text, None, ""]) if i % 11 == 0 else text, site))
        if i % 3 == 0:
            quality[docs[-1][0]] = int(kind)
    docs.append((None, "the river", "b.org/p"))
    got = quality_bayes.classify(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([*quality.items(), (None, 1), (7, None)], "doc_id long, quality int")).collect()

    x = [plain_features(t) for _, t, _ in docs]
    known = [k for k, (i, _, _) in enumerate(docs) if i in quality]
    m = quality_bayes.fit(np.array([x[k] for k in known]), np.array([float(quality[docs[k][0]]) for k in known]))
    z = lambda f: m.weights[0] + sum(w * min(max((v - c) / s, -4), 4) for v, c, s, w in zip(f, m.center, m.scale, m.weights[1:], strict=True))
    sites = []
    for _, _, s in docs:
        s = (s or "").split("://")[-1]
        host = s.split("/")[0].lower()
        sites.append((host, "/".join([host, *s.split("/")[1:2]])))
    evidence = [1 / (1 + math.exp(-z(f))) for f in x]
    out = [quality.get(i, e) for (i, _, _), e in zip(docs, evidence, strict=True)]
    world, logit = sum(out) / len(out), lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    sums = [Counter(), Counter(), Counter(), Counter()]  # documents and outcomes of hosts, then of paths
    for (host, path), o in zip(sites, out, strict=True):
        for n, g, own in ((0, 1, host), (2, 3, path)):
            sums[n][own] += 1
            sums[g][own] += round(o * 1e6) / 1e6
    hs = plain_strength([(n, sums[1][h], world) for h, n in sums[0].items()])
    up = {h: (hs * world + sums[1][h]) / (hs + n) for h, n in sums[0].items()}
    ps = plain_strength([(n, sums[3][p], up[h]) for h, p in sorted(set(sites)) if p != h for n in [sums[2][p]]])
    assert 1 < hs < 1000 and 1 < ps < 1000
    want = Counter()
    for k, (host, path) in enumerate(sites):
        rest = lambda level, own: [out[j] for j in range(len(out)) if j != k and sites[j][level] == own]  # noqa: B023, E731
        rate = (hs * world + sum(rest(0, host))) / (hs + len(rest(0, host)))
        if path != host:
            rate = (ps * rate + sum(rest(1, path))) / (ps + len(rest(1, path)))
        score = 1 / (1 + math.exp(-(logit(evidence[k]) + logit(rate) - logit(world)))) if (docs[k][1] or "").split() else 0.0
        want[docs[k][0], round(evidence[k], 4), round(rate, 4), round(score, 4), score >= 0.5] += 1
    assert Counter((r["doc_id"], round(r["evidence"], 4), round(r["path_rate"], 4), round(r["score"], 4), r["kept"]) for r in got) == want
    assert {p for _, p in sites} >= {"a.com/x", "a.com/y", "b.org/p"} and {r["kept"] for r in got} == {True, False}


def test_packing():
    v = np.random.default_rng(0).integers(1, 100, (2000, 3))
    s = sharding.pack(v, 8)
    sums = np.array([v[s == k].sum(axis=0) for k in range(8)])
    assert (sums.max(axis=0) / sums.min(axis=0) < 1.01).all()
    # by definition: largest first, to the shard with the highest dot product
    need, left, want = v / (v.sum(axis=0) / 8), np.ones((8, 3)), np.zeros(len(v), int)
    for i in sorted(range(len(v)), key=lambda i: (-need[i].max(), i)):
        want[i] = max(range(8), key=lambda k: (left[k] @ need[i], -k))
        left[want[i]] -= need[i]
    assert (s == want).all()


def test_shards(spark, odd, tmp_path):
    r = sharding.assign(odd, 3).toPandas()
    assert len(r) == len(ODD) and (r.groupby("shard")["slot"].max() + 1 == r.groupby("shard")["slot"].count()).all()
    assert sharding.assign(odd.limit(0), 3).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "one text that a third of all rows have").otherwise(F.col("text")).alias("text"))
    a = sharding.assign(docs, 8)
    p = a.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).toPandas()
    assert p["b"].max() / p["b"].min() < 1.1 and p["n"].max() / p["n"].min() < 1.1
    few = docs.where("doc_id % 3 <> 0").join(a.select("doc_id", "shard"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("k"))
    assert few.where("k > 1").count() == 0
    alike = odd.unionByName(spark.createDataFrame([(None, "hot", "x", "k")] * 90 + [(9, "hot", "x", "k")] * 90, odd.schema))
    sharding.write(alike, str(tmp_path / "alike"), 3)
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "alike")).select("doc_id", "text").collect())) == Counter(map(tuple, alike.select("doc_id", "text").collect()))
    assert sharding.assign(alike, 3).where("size = 4").select("shard").distinct().count() == 3
    sharding.write(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_shards_against_packing_of_groups(spark):
    rnd = random.Random(4)
    texts = [None, "", *("w" * rnd.randint(1, 400) + " x" * rnd.randint(0, 20) + str(i) for i in range(60))]
    rows = [(rnd.choice([None, i, i // 2]), rnd.choice(texts), "clash", 7) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.assign(d, 4).collect()
    # every group is small against a shard, so each is one cell but for those that share a hash of the cell
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(t, []).append(i)
    cells = {r["text"]: r["cell"] for r in spark.createDataFrame([(t,) for t in groups], "text string").select("text", F.when(F.col("text").isNull(), 0).otherwise(F.pmod(F.xxhash64("text"), F.lit(sharding.CELLS))).alias("cell")).collect()}
    vectors = {}
    for t, ids in groups.items():
        v = np.array([len((t or "").encode()) + 1, len((t or "").split()), 1]) * len(ids)
        vectors[cells[t]] = vectors.get(cells[t], 0) + v
    order = sorted(vectors)
    shard = dict(zip(order, sharding.pack(np.array([vectors[c] for c in order]), 4).tolist(), strict=True))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard[cells[t]]) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i % 997}" for i in range(200_000))
    rows = [(1, long, "a", 1, 2.0), (2, long + " end", "a", 3, 4.0), (3, "\n".join(["one line that is long enough"] * 50_000), "b", 5, 6.0), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, target int, score double").withColumns({"taken": F.lit("x"), "kept": F.lit(1), "row": F.lit(2), "cell": F.lit(3), "key": F.lit(4)})
    sizes = {1: 200_000, 2: 200_001, 3: 300_000, None: 0}
    assert {r["doc_id"]: r["size"] for r in mixture.mix(d).collect()} == sizes
    again = mixture.repeated(d)
    assert again.columns == d.columns and {r["doc_id"] for r in again.collect()} <= {1, 2, 3}
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.apply_rules(d).collect()} == sizes
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality_bayes.classify(d, labels).count() == 4 and quality_bayes.keep(d, labels).columns == d.columns
    assert {r["doc_id"]: r["tokens"] for r in sharding.assign(d, 2).collect()} == sizes
    from driftframe.llm import line_dedup, order_minhash

    assert {r["doc_id"]: r["class_id"] for r in order_minhash.classes(d).collect()} == {1: 1, 2: 1, 3: 3, None: None}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(d).collect()} == {1: 0, 2: 0, 3: 49_999, None: 0}
    for keep in (order_minhash.keep(d), line_dedup.dedup(d).drop("n_lines", "n_dropped")):
        assert keep.columns == d.columns


def test_hosts(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/1?x", "https://example.com/en/7", "http://notexample.com/en/7", "http://x.net/de/1#f", "http://a.example.net/de/8", "ftp://b.org/es/", "http://u@h.org:80?q", "x://y://z/", "http:///p"]
    d = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_reputation.judge(d).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.com", "/en/1", "com/en/", "block"), 3: ("example.com", "/en/7", "example.com/en/7", "allow"),
        4: ("notexample.com", "/en/7", "com/en/", "block"), 5: ("x.net", "/de/1", "net/de/", "allow"), 6: ("a.example.net", "/de/8", "example.net/de/8", "block"),
        7: ("b.org", "/es/", "org/es/", "block"), 8: ("u@h.org:80", "", None, "allow"), 9: ("y:", "//z/", None, "allow"), 10: ("", "/p", None, "allow"),
    }
    assert host_reputation.judge(d.limit(0)).count() == 0


def test_labelled_outcomes(spark):
    rows = [(i, f"http://{h}.bad.com/a", None) for i, h in enumerate(["a"] * 60 + ["b"] * 3)] + [(100 + i, f"http://{h}.org/", "x!! " * 9) for i, h in enumerate(["x"] * 300 + ["y"] * 9)] + [(None, None, None), (None, "http://a.bad.com/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 409, 2)] + [(4, 0), (6, None), (None, 1)], "page_id long, bad int")
    got = {r["host"]: (r["verdict"], r["reputation"]) for r in host_reputation.judge(pages, labels).collect()}
    assert got["a.bad.com"][0] == "block" and got["x.org"][0] == "allow" and got[""] == ("allow", None) and got["a.bad.com"][1] > 0.9 > got["b.bad.com"][1]
    assert host_reputation.judge(pages, labels.limit(0)).where("verdict = 'block'").count() == 0


def test_reputation_shrinks(spark):
    rows = [("a.bad.com", 1)] * 50 + [("b.bad.com", 1)] * 40 + [("c.bad.com", 1)] + [("x.good.com", 0)] * 300 + [("y.good.com", 0)] * 5 + [("z.good.com", 1)]
    r = {x["host"]: x for x in host_reputation.reputation(spark.createDataFrame(rows, "host string, bad long")).collect()}
    assert r["a.bad.com"]["lower"] > 0.8 and r["c.bad.com"]["mean"] > 0.6 > r["z.good.com"]["mean"] and r["c.bad.com"]["lower"] < r["a.bad.com"]["lower"]
