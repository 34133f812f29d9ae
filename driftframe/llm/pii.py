"""Information-theoretic sanitisation of personal data.

Entities (e-mail, IP, card and phone) are found by linear scans of the whole text. Words of the same document
can give an entity away as well: a term t reveals an entity e to the degree

    pmi(t, e) / ic(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

with document counts over the whole corpus; it is 1 if t never occurs without e. Terms that have been seen with e
in enough different texts and whose degree exceeds a threshold are generalised to the kind of word that they are, a
name or a plain term; those that all but name it are removed, wherever they occur in a document that holds e.

Scale: one pass finds entities and leaves rows without entities without their text. Only entities and terms with
enough texts go on, and a term meets an entity only if it is rare enough beside it to reach the threshold with
all of the entity's documents; pairs are counted by map-side sums. How often a term occurs at all is counted in a second
pass, only for terms whose hash is marked in a bit table of fixed size, with sums per batch before the shuffle;
marks that collide cost a few more rows and are dropped by the join. Nothing that grows with the corpus reaches
the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.text import cut

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Different texts in which a term must have been seen with an entity.
SUPPORT = 3
#: Degrees of disclosure from which terms are generalised and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Size of the bit table of candidate terms.
MARKS = 1 << 20
#: Different terms that a worker counts before it hands its sums on.
HELD = 100_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")

Span = tuple[int, int, int]  # start, number of the kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each ``@``: the local part is the longest run before it, so no start is tried twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, taken four at a time."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in DIALLED.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def find(text: str) -> list[Span]:
    """Base spans in code points, by start and kind."""
    return sorted((a, k, b) for k, f in enumerate((emails, addresses, cards, phones)) for a, b in f(text))


def entity(text: str, span: Span) -> str:
    """What two mentions of the same entity share."""
    said = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{said.lower() if span[1] == 0 else said if span[1] == 1 else re.sub('[^0-9]', '', said)}"


def terms(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside the base spans, which are in order."""
    ends = list(accumulate((s[2] for s in spans), max))
    for m in WORD.finditer(text):
        a, b = m.span()
        before = bisect_left(spans, (b,))  # spans that start before the word ends
        if not before or ends[before - 1] <= a:
            yield m.group().lower(), a, b


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<start int, kind int, end int>>"
FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", SPANS), ("entities", pa.list_(pa.string())), ("held", pa.string())])
FOUND_DDL = f"doc_id long, text_key long, base {SPANS_DDL}, entities array<string>, held string"


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, entities, held`` and ``row`` for every row, worked out once; ``held`` is the text of
    those with an entity."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            base, who, held = [], [], []
            for value in part.column(2):
                text = value.as_py() or ""
                spans = find(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                who.append(sorted({entity(text, s) for s in spans}))
                held.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, SPANS), pa.array(who, pa.list_(pa.string())), pa.array(held, pa.string())], schema=FOUND)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, FOUND_DDL)
    return cut(rows).withColumn("row", F.monotonically_increasing_id())  # of stored rows, so it doesn't change


def _base(value: pa.Scalar) -> list[Span]:
    return [(x["start"], x["kind"], x["end"]) for x in value.as_py()]


def terms_of(rows: DataFrame) -> DataFrame:
    """``row, text_key, term``: the different terms of ``rows``."""
    schema = pa.schema([("row", pa.int64()), ("text_key", pa.int64()), ("term", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, key, base, text in zip(*part.columns, strict=True):
                own = sorted({t for t, _, _ in terms(text.as_py(), _base(base))})
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(own), pa.int64()), pa.array([key.as_py()] * len(own), pa.int64()), pa.array(own, pa.string())], schema=schema)

    return rows.select("row", "text_key", "base", "held").mapInArrow(run, "row long, text_key long, term string")


def marked(rows: DataFrame) -> DataFrame:
    """``h_row, more``: where the terms in ``told`` (term, kind) occur in ``rows``."""
    schema = pa.schema([("h_row", pa.int64()), ("more", SPANS)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            more = []
            for base, text, told in zip(*part.columns[1:], strict=True):
                kinds = {}
                for x in told.as_py():
                    kinds[x["term"]] = max(x["kind"], kinds.get(x["term"], 0))
                more.append([{"start": a, "kind": kinds[t], "end": b} for t, a, b in terms(text.as_py(), _base(base)) if t in kinds])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(more, SPANS)], schema=schema)

    return rows.select("row", "base", "held", "told").mapInArrow(run, f"h_row long, more {SPANS_DDL}")


def frequencies(docs: DataFrame, terms: DataFrame, marks: int = MARKS) -> DataFrame:
    """``term, n_term``: in how many documents each of ``terms`` occurs."""
    spots = terms.select((F.crc32(F.col("term").cast("binary")) % marks).cast("int").alias("spot")).distinct().toArrow()
    table = np.zeros(marks, dtype=bool)
    table[spots.column("spot").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, held = shared.value, Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
        for part in parts:
            for value in part.column(0):
                own = set(WORD.findall((value.as_py() or "").lower()))
                held.update(t for t in own if marked[zlib.crc32(t.encode()) % marks])
            if len(held) > HELD:
                yield give()
                held.clear()
        if held:
            yield give()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms.distinct(), "term")


def mentions(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``row, text_key, entity, n_entity`` of the entities that occur in enough different texts."""
    each = rows.where(F.size("entities") > 0).select("row", "text_key", F.explode("entities").alias("entity"))
    counts = each.groupBy("entity", "text_key").count().groupBy("entity").agg(F.sum("count").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    return each.join(counts.where(F.col("texts") >= support).drop("texts"), "entity")


def disclosing(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``entity, term, degree`` of the pairs whose degree of disclosure is at least ``generalise``."""
    who = cut(mentions(rows, support))
    said = cut(terms_of(rows.join(who.select("row").distinct(), "row")))
    often = said.groupBy("term", "text_key").agg(F.lit(1)).groupBy("term").count().where(F.col("count") >= support).select("term")
    n = rows.count()
    # the degree is at most what it is if all documents of the entity hold the term
    most = F.col("n_entity") * F.pow(n / F.col("n_entity"), F.lit(1 - generalise)) * (1 + 1e-9)
    near = said.join(cut(frequencies(docs, cut(often))), "term").join(who.drop("text_key"), "row").where(F.col("n_term") <= most)
    texts = near.groupBy("entity", "term", "text_key").agg(F.count(F.lit(1)).alias("n"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    pairs = texts.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("texts"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    # a document can hold a term only inside another word form than the counted one; then n_both bounds it
    n_term = F.greatest(F.col("n_term"), F.col("n_both"))
    degree = F.log(n * F.col("n_both") / (n_term * F.col("n_entity"))) / F.nullif(F.log(n / F.col("n_entity")), F.lit(0.0))
    return pairs.where(F.col("texts") >= support).select("entity", "term", F.coalesce(degree, F.lit(0.0)).alias("degree")).where(F.col("degree") >= generalise)


def spans(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``doc_id, text_key, base, spans`` for every row of ``docs`` (``doc_id, text``).

    ``base``: spans of entities; ``spans``: those and the method's, as structs (start, kind, end) with kind
    an index of ``KINDS``, in order. A null or empty text has none. Repeated rows each have their row and
    count as documents, but equal texts support a pair only once. An empty table gives an empty result.
    """
    rows = found(docs)
    pairs = cut(disclosing(docs, rows, support))
    kind = F.when(F.col("degree") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("generalise"))
    told = mentions(rows, support).join(pairs, "entity").groupBy("row").agg(F.collect_set(F.struct("term", kind.cast("int").alias("kind"))).alias("told"))
    more = marked(rows.join(told, "row"))
    joined = rows.join(more, F.col("row") == F.col("h_row"), "left")
    return joined.select("doc_id", "text_key", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPANS_DDL)))).alias("spans"))


def listed(items: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: str, items: list[Span]) -> str:
    """The text with entities replaced by their kind and generalised terms by ``[NAME]`` if they are capitalised, else
    ``[TERM]``; removed terms are left out, overlapping spans merged under the first."""
    out, at = [], 0
    for a, k, b in items:
        if a >= at:
            said = "" if KINDS[k] == "remove" else f"[{KINDS[k].upper()}]" if KINDS[k] != "generalise" else "[NAME]" if text[a].isupper() else "[TERM]"
            out += [text[at:a], said]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the texts redacted; all columns stay. A null text stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([t if not t or x is None or not len(x) else redact(t, [(s["start"], s["kind"], s["end"]) for s in x]) for t, x in zip(texts, items, strict=True)], dtype=object)

    marks = spans(docs, support).where(F.size("spans") > 0).select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "spans").dropDuplicates(["m_id", "m_key"])
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    joined = own.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    new = run(F.col("row.text").cast("string"), F.col("spans"))
    return joined.select(*((new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
