"""Line dedup, near-dedup, personal data and the pipeline, against brute force."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftframe.llm import line_dedup, order_minhash, pii, queries


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_lines_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 20, 21, 50, 400]))) for _ in range(40)]

    def changed(s):
        s = list(s)
        for _ in range(rnd.randint(0, 2)):
            i, k = rnd.randrange(len(s) + 1), rnd.randint(0, 2)
            if k == 0:
                s.insert(i, rnd.choice("abé "))
            elif i < len(s):
                s[i] = rnd.choice("abé ") if k == 1 else ""
        return "".join(s)

    rows = [(i, None if i % 17 == 0 else "\n".join(changed(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for i in range(150)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=4).collect()}
    seen = []
    for i, t in rows:
        if t is None:
            assert got[i] == (None, 0)
            continue
        keep = []
        for x in t.split("\n"):
            if not x.strip():
                keep.append(x)
                continue
            if not any(x == y or min(len(x), len(y)) >= 4 and one_edit(x, y) for y in seen):
                keep.append(x)
            seen.append(x)
        assert got[i] == ("\n".join(keep), len(t.split("\n")) - len(keep))


def test_lines_odd_cases(spark):
    d = spark.createDataFrame([(1, "same line of text that is long\nx", "k"), (1, "same line of text that is long\nx", "k"), (None, "same line of text that is lonG", "z"), (None, "", None), (None, None, None), (2, "same line of text that is long\nshort", None)], "doc_id long, text string, n_lines string")
    out = line_dedup.dedup(d)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == sorted([("1", "same line of text that is long\nx", 2, 0)] * 2 + [("None", "", 1, 1), ("None", "", 1, 0), ("None", "None", 0, 0), ("2", "short", 2, 1)])
    assert line_dedup.dedup(d.limit(0)).count() == 0
    short = spark.createDataFrame([(i, f"{'yes' if i < 3 else 'yet'}\n\n \n{i}") for i in range(4)], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup(short).orderBy("doc_id").collect()] == ["yes\n\n \n0", "\n \n1", "\n \n2", "yet\n\n \n3"]
    assert {r["n_dropped"] for r in line_dedup.dedup(d, max_edits=0).where("doc_id is null and text <> ''").collect()} == {0}


def test_alignment_against_a_table():
    rnd = random.Random(3)
    for k in range(600):
        a = [rnd.randint(0, 6 if k % 2 else 200) for _ in range(rnd.randint(1, 60))]
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 2)] = [rnd.randint(0, 300)] * rnd.randint(0, 2)
        if not b:
            continue
        A, B = np.array(a, np.uint32), np.array(b, np.uint32)
        x, y = order_minhash.shingles(A).tolist(), order_minhash.shingles(B).tolist()
        row = [0] * (len(y) + 1)
        for p in x:
            new = [0]
            for j, q in enumerate(y):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[-1]))
            row = new
        assert order_minhash.distance(x, y, 10**6) == len(x) + len(y) - 2 * row[-1]
        assert order_minhash.similar(A, B) == (row[-1] >= 0.8 * (len(x) + len(y) - row[-1]) - 1e-9)


def test_sketches_keep_order():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    turned = np.r_[w[200:], w[:200]]
    s = lambda v: order_minhash.sketch(order_minhash.labelled(order_minhash.shingles(v)))
    assert (s(w) == s(w.copy())).all() and (s(w) == s(turned)).mean() < 0.6
    assert not order_minhash.similar(w, turned)


def classes_of(texts, threshold=0.8):
    h = order_minhash._Hashes()
    words = {i: order_minhash.word_hashes(t or "", h) for i, t in texts.items()}
    labels = {i: order_minhash.labelled(order_minhash.shingles(w)) for i, w in words.items()}
    where, both = {}, Counter()
    for i, x in labels.items():
        for v in x.tolist():
            where.setdefault(v, []).append(i)
    for ids in where.values():
        both.update(itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in both.items():
        if n >= threshold * (len(labels[a]) + len(labels[b]) - n) - 1e-9 and order_minhash.similar(words[a], words[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_classes_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 100000).alias("doc_id"), F.regexp_replace("text", "^([^ ]+ ){2}", "changed words ").alias("text"))
    both = docs.select("doc_id", "text").union(extra)
    want = classes_of({r["doc_id"]: r["text"] for r in both.collect()})
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(both).collect()}
    assert got == want and len(set(want.values())) < len(want) - 100


def test_classes_of_a_large_group(spark):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(400):
        t = list(base)
        for _ in range(2):
            t[rnd.randrange(200)] = f"x{rnd.random()}"
        texts[i] = " ".join(t)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes_of(texts)


def crowded(spark, buckets, crowd):
    """Two similar texts, 0 and 1, in buckets among texts that are like no other and all more popular."""
    rnd = np.random.default_rng(3)
    words = {i: rnd.integers(0, 1 << 32, 60, dtype=np.uint32) for i in range(2 + crowd)}
    words[1] = words[0].copy()
    words[1][0] += 1
    rows = [(bucket, i, 56, 1 if i < 2 else 2) for bucket in range(buckets) for i in words]
    return spark.createDataFrame(rows, "bucket long, tid long, n int, popular long"), spark.createDataFrame([(i, bytearray(w.astype("<u4").tobytes())) for i, w in words.items()], "tid long, words binary")


def test_links_that_no_round_draws(spark):
    for buckets, crowd in ((1, 12), (3, 60)):
        members, words = crowded(spark, buckets, crowd)
        roots = dict(map(tuple, order_minhash.linked(members, words, 0.8).collect()))
        assert len(roots) == crowd + 2 and roots.pop(0) == roots.pop(1) and all(k == v for k, v in roots.items())


def test_alignment_of_long_texts_is_quick():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 32, 20_000)
    y = x.copy()
    y[rng.choice(20_000, 400, replace=False)] = 7
    began = time.perf_counter()
    assert order_minhash.similar(x.astype(np.uint32), y.astype(np.uint32))
    assert order_minhash.distance([1, 2] * 10_000, [2, 1] * 10_000, 10) == 2
    assert time.perf_counter() - began < 5


def test_near_dedup_odd_cases(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j", "p"), (1, "a b c d e f g h i j", "p"), (None, "a b c d e  f g h i j", "p"), (2, "", None), (None, None, None), (3, " \n", None), (4, "zz", "q"), (5, "zz ", "q")], "doc_id long, text string, key string")
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in order_minhash.classes(d).collect())
    assert got == {(1, 1, True): 2, (None, 1, False): 1, (2, 2, True): 1, (None, None, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 4, False): 1}
    kept = order_minhash.keep(d)
    assert kept.columns == d.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, None: 1}
    assert order_minhash.classes(d.limit(0)).count() == 0 and order_minhash.keep(d.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_spans_against_the_patterns(spark):
    rnd = random.Random(2)
    parts = ["a", "b@", "@", ".", " ", "1", "23", "4539578763621486", "+1 (487) 555-7209", "-", "x.y", "\n", "é", "1.2.3.4", "256.", "00000001", "%+"]
    for _ in range(8000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert pii.find(t) == base_spans(t)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op7_pii(spark, "/root/testdata/sf0.01").collect():
        b = base_spans(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == j for _, k, _ in b) for j in range(4))
        assert {f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in b} <= set(r["spans"].split(",")) | {""}


def test_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "+1 " * 130_000):
        pii.find(t)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"the zorblatt office of a.b@c.de is here {i}") for i in range(6)] + [(100 + i, f"the office is here and there {i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["term"]: r["degree"] for r in pii.disclosing(d, pii.found(d)).collect()}
    assert set(terms) == {"zorblatt"} and abs(terms["zorblatt"] - 1) < 1e-9
    assert pii.sanitise(d).where("doc_id = 3").first()["text"] == "the  office of [EMAIL] is here 3"
    copies = spark.createDataFrame([(i, "the zorblatt office of a.b@c.de") for i in range(6)] + rows[6:], "doc_id long, text string")
    assert pii.disclosing(copies, pii.found(copies)).count() == 0  # one text, however often


def plain_spans(rows, support=3):
    """Spans of every row by definition: all pairs of entities and terms, counted by document."""
    base = [base_spans(t or "") for _, t in rows]
    who = [{pii.entity(t, s) for s in b} for (_, t), b in zip(rows, base, strict=True)]
    inside = lambda b, a, e: any(x < e and a < y for x, _, y in b)
    words = [[(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if not inside(b, *m.span())] for (_, t), b in zip(rows, base, strict=True)]
    anywhere = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for _, t in rows]
    said = [{w for w, _, _ in ws} for ws in words]
    n, told = len(rows), [{} for _ in rows]
    for e in set().union(*who):
        docs = [k for k in range(n) if e in who[k]]
        if len({rows[k][1] for k in docs}) < support:
            continue
        for term in set().union(*(said[k] for k in docs)):
            both = [k for k in docs if term in said[k]]
            if len({rows[k][1] for k in both}) < support:
                continue
            n_term = max(sum(term in a for a in anywhere), len(both))
            ic = math.log(n / len(docs))
            degree = math.log(n * len(both) / (n_term * len(docs))) / ic if ic else 0.0
            if degree >= pii.GENERALISE - 1e-12:
                for k in docs:
                    told[k][term] = max(told[k].get(term, 0), 5 if degree >= pii.REMOVE else 4)
    return [sorted(b + [(a, t[w], e) for w, a, e in ws if w in t]) for b, ws, t in zip(base, words, told, strict=True)]


def test_method_spans_against_brute_force(spark):
    rnd = random.Random(6)
    people = {f"p{i}.q@mail{i}.example.com": [f"{w}{'abcdefgh'[i]}" for w in ("zorb", "quill", "Marn")] for i in range(6)}
    common, rows = "the office was here and they all went home again".split(), []
    for k in range(240):
        words = [rnd.choice(common) for _ in range(rnd.randint(0, 20))]
        if k % 3 == 0:
            who = rnd.choice(list(people))
            words += [rnd.choice([who, who, who.upper(), "+1 (212) 555-7209"]), *rnd.sample(people[who], rnd.randint(1, 3))]
        if k % 17 == 0:
            words.append(rnd.choice(rnd.choice(list(people.values()))))
        rnd.shuffle(words)
        rows.append((rnd.choice([k, None]), rnd.choice([" ".join(words), " ".join(words), "\n".join(words)]) or None))
    rows += [rows[3], rows[3], (1000, None), (1001, "")]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, tuple(s)) for (i, _), s in zip(rows, plain_spans(rows), strict=True))
    assert Counter((r["doc_id"], tuple(tuple(x) for x in r["spans"])) for r in got) == want
    kinds = Counter(k for _, s in want.elements() for _, k, _ in s)
    assert kinds[4] > 5 and kinds[5] > 5


def test_terms_anywhere_in_a_document(spark):
    rows = [(i, f"zorblatt\n\nmail a.b@c.de\n{'so it is here ' * 9}{i}\nask zorblatt") for i in range(6)] + [(100 + i, f"mail ask here and there {i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text = pii.sanitise(d).where("doc_id = 3").first()["text"]
    assert text == f"\n\nmail [EMAIL]\n{'so it is here ' * 9}3\nask "


def test_pii_odd_cases(spark):
    d = spark.createDataFrame([(1, None, "q"), (1, "x a@b.cd", None), (1, "x a@b.cd", None), (None, "", "r")], "doc_id long, text string, spans string")
    assert pii.sanitise(d).columns == d.columns
    assert Counter(r["text"] for r in pii.sanitise(d).collect()) == {None: 1, "x [EMAIL]": 2, "": 1}
    assert pii.spans(d.limit(0)).count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, " \n\t", None, None, None), (7, " \n\t", None, None, None), (8, "w " * 100_000, "en", "s", 200_000)], base.schema)
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, base.limit(0), odd.withColumns({"row": F.lit(1), "key": F.lit("k"), "kept": F.lit(0), "size": F.lit(2.0), "tokens": F.lit(None).cast("string")})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count() * 3
            assert out.columns == docs.columns if name != "byte_bpe" else set(out.columns) >= {"doc_id", "ids"}


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == names
        if name == "minhash_near_dedup":
            want = classes_of({r["doc_id"]: r["text"] for r in before.collect()})
            worded = {r["doc_id"] for r in before.collect() if (r["text"] or "").split()}
            blank = before.count() - len(worded)
            assert counts[-1] == len({want[i] for i in worded}) + blank
    assert counts[1] < counts[0] and counts[2] == counts[1]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]
