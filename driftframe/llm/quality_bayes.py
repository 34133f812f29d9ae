"""Quality classifier: a document classifier's evidence, tempered by what is known of its site.

1. A logistic model over measures of the text is fitted to labelled documents: at most ``sample`` of them, those
   whose id has a small hash.
2. Every document of the corpus then has an outcome, its label or else the model's probability. Outcomes are
   summed for each path (host and first path segment) and host in one grouped aggregation.
3. The rate of good documents of a host is its mean, shrunk towards the global rate; that of a path is shrunk
   towards its host's. Sparse sites thus stay near their parents. A document's own outcome is left out of the sums
   that it is judged by, so its evidence counts once.
4. A document's log odds are the model's plus those of its path against the global rate.

``source`` is read as a site: what follows an optional scheme, up to the first ``/``, is the host; the next
segment makes the path. The sample is chosen among the labels, so nothing else reaches the driver, and every
text is measured once, when the model is known; of the sampled ones also for the fit. Labels and paths are joined
without hints: Spark broadcasts them if their size allows, else rows are shuffled by id and then by path, where a hot
path is split as a skewed join. No texts go through either; ``keep`` takes the rejected rows out of the documents, by
broadcast or one shuffle of their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.quality_rules import SPACE, STOP_WORDS, SYMBOLS, let, words
from driftframe.llm.text import stored

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 20_000
#: Least and most outcomes that a parent's rate counts for.
STRENGTHS = (1.0, 1000.0)
#: Documents with a score from here on are kept.
THRESHOLD = 0.5
#: Outcomes are summed as whole numbers of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1_000_000
FEATURES = ("log_words", "word_length", "symbols", "stop_words", "upper", "bangs", "distinct", "distinct_lines", "digits", "bars", "echoes")


def features(text: Column) -> Column:
    """The measures as a struct of doubles, all 0 for a text without words, and ``n_words``."""
    flat = F.coalesce(text, F.lit(""))
    length = F.length(flat)
    without = lambda chars: (length - F.length(F.translate(flat, chars, ""))).cast("double")

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.length(F.translate(flat, SPACE, ""))
        letters = F.greatest(chars, F.lit(1)).cast("double")
        lines = F.split(flat, "\n")
        values = (
            F.log1p(F.size(w).cast("double")), chars / n, without(SYMBOLS) / n, F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))) / n,
            (length - F.length(F.regexp_replace(flat, r"\p{Lu}", ""))) / letters, without("!") / n, F.size(F.array_distinct(w)) / n,
            F.size(F.array_distinct(lines)) / F.size(lines).cast("double"), without("0123456789") / letters, without("|") / n,
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) / n,
        )
        return F.struct(F.size(w).alias("n_words"), *(F.when(F.size(w) > 0, v).otherwise(F.lit(0.0)).alias(k) for k, v in zip(FEATURES, values, strict=True)))

    return let(words(text), of)


@dataclass(frozen=True)
class Model:
    """Standardised features, clipped to 4 deviations, times weights."""

    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def probability(self, f: Column) -> Column:
        z = F.lit(self.weights[0])
        for name, c, s, w in zip(FEATURES, self.center, self.scale, self.weights[1:], strict=True):
            z = z + F.lit(w) * F.least(F.greatest((f[name] - c) / s, F.lit(-4.0)), F.lit(4.0))
        return 1 / (1 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    """Ridge logistic regression by Newton steps. Without labels of both kinds the weights are 0 but for
    the intercept, which then says what labels there are."""
    x = np.asarray(x, float).reshape(len(y), len(FEATURES))
    center = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = np.where((s := x.std(axis=0) if len(x) else np.ones(len(FEATURES))) > 1e-9, s, 1.0)
    a = np.hstack([np.ones((len(x), 1)), np.clip((x - center) / scale, -4, 4)])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    if len(set(y)) < 2:
        w[0] = 4.0 if len(y) == 0 or y[0] else -4.0
        steps = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(*(tuple(float(v) for v in t) for t in (center, scale, w)))


def site(source: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null source."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0))
    return host, F.concat(host, F.regexp_extract(bare, r"^[^/?#]*(/[^/?#]*)", 1))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def labelled(labels: DataFrame) -> DataFrame:
    """``l_id, good``: one row for each labelled id, the mean of its labels; null ids and labels are left out."""
    good = F.col("quality").cast("double")
    return labels.where(F.col("doc_id").isNotNull() & good.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.avg(good).alias("good"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = stored(labelled(labels))
    n = known.count()
    if n > sample:  # a threshold that leaves somewhat fewer than ``sample``; the limit below is out of its reach
        known = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 40)) < int((1 << 40) * 0.95 * sample / n))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # at most ``sample`` rows of two numbers
    both = own.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("doc_id", "good", features(F.col("text")).alias("f")).select("doc_id", "good", *(F.col(f"f.{k}") for k in FEATURES))
    got = both.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample).toPandas()
    return fit(got[list(FEATURES)].to_numpy(), (got["good"].to_numpy() >= 0.5).astype(float))


def row_key() -> Column:
    """A hash of what a row's score depends on besides its id."""
    return F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))


def measured(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """``doc_id, key, host, path, worded, evidence, outcome`` of every document, worked out once."""
    host, path = site(F.col("source").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), host.alias("host"), path.alias("path"), features(F.col("text").cast("string")).alias("f"))
    rows = own.withColumn("evidence", model.probability(F.col("f"))).join(stored(labelled(labels)), F.col("doc_id") == F.col("l_id"), "left")
    # whole numbers of 1 / UNIT, so that sums don't depend on their order
    outcome = F.round(F.coalesce("good", "evidence") * UNIT).cast("long")
    return stored(rows.select("doc_id", "key", "host", "path", (F.col("f.n_words") > 0).alias("worded"), "evidence", outcome.alias("outcome")))


def strength(children: DataFrame) -> float:
    """How many outcomes the parent's rate counts for, for ``n, good, up`` (documents, their good outcomes and the parent's
    rate): that of the beta prior under which the children's rates scatter about it as they do, by moments. Children
    that scatter no more than documents of one rate would give the most."""
    n, up = F.col("n").cast("double"), F.col("up")
    s = children.agg(
        F.sum(n).alias("all"), F.sum(n * n).alias("squares"), F.count(F.lit(1)).alias("k"),
        F.sum((F.col("good") - n * up) * (F.col("good") - n * up) / n).alias("scatter"), F.sum(n * up * (1 - up)).alias("binomial"),
    ).first()
    least, most = STRENGTHS
    if not s["k"] or not s["binomial"] or s["all"] * s["all"] <= s["squares"]:
        return most
    each = s["binomial"] / s["all"]
    spread = (s["scatter"] - (s["k"] - 1) * each) / (s["all"] - s["squares"] / s["all"])
    # rounded, since the order of sums is open
    return round(min(max(each / spread - 1, least), most), 3) if spread > 0 else most


def posteriors(rows: DataFrame) -> DataFrame:
    """``s_host, s_path, g, n, hg, hn, world, hs, ps``: outcomes and documents of each path and host, the global rate, and the
    strengths of the priors of hosts and of paths."""
    paths = stored(rows.groupBy("host", "path").agg(F.sum("outcome").alias("g"), F.count(F.lit(1)).alias("n")))
    total = paths.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    world = float(total["g"] / UNIT / total["n"]) if total["n"] else 0.5
    hosts = stored(paths.groupBy(F.col("host").alias("s_host")).agg(F.sum("g").alias("hg"), F.sum("n").alias("hn")))
    hs = strength(hosts.select(F.col("hn").alias("n"), (F.col("hg") / UNIT).alias("good"), F.lit(world).alias("up")))
    both = paths.join(hosts, F.col("host") == F.col("s_host")).withColumn("up", (hs * world + F.col("hg") / UNIT) / (hs + F.col("hn")))
    ps = strength(both.where("path <> host").select("n", (F.col("g") / UNIT).alias("good"), "up"))
    return stored(both.select("s_host", F.col("path").alias("s_path"), "g", "n", "hg", "hn", *(F.lit(float(v)).alias(c) for c, v in (("world", world), ("hs", hs), ("ps", ps)))))


def score(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with ``path_rate``, ``score`` and ``kept``."""
    joined = rows.join(sites, F.col("path") == F.col("s_path"))
    rate = lambda by, parent, g, n: (F.col(by) * parent + (F.col(g) - F.col("outcome")) / UNIT) / (F.col(by) + F.col(n) - 1)
    host_rate = rate("hs", F.col("world"), "hg", "hn")
    joined = joined.withColumn("path_rate", F.when(F.col("path") == F.col("s_host"), host_rate).otherwise(rate("ps", host_rate, "g", "n")))
    z = _logit(F.col("evidence")) + _logit(F.col("path_rate")) - _logit(F.col("world"))
    joined = joined.withColumn("score", F.when(F.col("worded"), 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0)))
    return joined.withColumn("kept", F.col("score") >= THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, evidence, path_rate, score, kept`` for every row of ``docs`` (``doc_id, text, source``).

    A text without words (null, empty, blank) scores 0 and is not kept. Repeated rows count and are judged
    like any others; rows with a null id have no label. Without labels every text with words is kept. An
    empty table gives an empty result.
    """
    rows = measured(docs, labels, train(docs, labels, sample))
    return score(rows, posteriors(rows)).select("doc_id", "evidence", "path_rate", "score", "kept")


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all their columns: those that are not among the rejected ones."""
    rows = measured(docs, labels, train(docs, labels, sample))
    bad = stored(score(rows, posteriors(rows)).where(~F.col("kept")).select(F.col("doc_id").alias("b_id"), F.col("key").alias("b_key")).distinct())
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))
    return own.join(bad, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("key") == F.col("b_key")), "left_anti").select("row.*")
