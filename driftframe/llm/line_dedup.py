"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join, in DataFrame operations only.

A line with a word goes if an earlier one, by (doc_id, place in the document), is equal to it or, if both are long
enough, can be turned into it by one edit: a character replaced, inserted or deleted. Two lines are one edit apart just if they share a variant,
the line itself or the line less one character. Variants are joined as hashes and pairs verified by edit
distance. Emitting a variant for each character of each line would multiply the corpus by the length of its
lines, so the neighbourhood is built in three grains, each for lines that found company in the one before:

1. less the first or the last part of the line: an edit leaves a prefix or a suffix of a fixed grid of lengths;
2. less one of a few segments: an edit falls into one segment, the rest of the line is equal;
3. less one character of that segment: the variants proper.

No grain loses a pair that is one edit apart. At the last one, lines that share a variant by replacing the same
character are all one edit from each other, and those that insert into one shorter line are all one edit from
it; so each line needs the earliest of its group only, and no pairs within a group are made. Equal lines are
first reduced to their earliest place by map-side aggregation. What goes is joined back to all places in a stage of
its own, where Spark splits a hot line as a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.quality_rules import SPACE, let
from driftframe.llm.text import stored

#: Shorter lines are compared for equality only: one edit would be more than a twentieth of them.
MIN_CHARS = 20
#: The texts of so many lines with company in the first grain are looked up by broadcast, of more by a shuffle. What is
#: broadcast are the places of the lines, under 100 bytes each, so 20 MB at most.
BROADCAST_LINES = 200_000


def _grid(n: Column) -> Column:
    """A length of at most half of n, the same for most neighbouring n: 2 ** k or 3 * 2 ** (k - 1)."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(n / 2.0 + 1e-9))).cast("int")
    longer = (power * 3 / 2).cast("int")
    return F.when(longer * 2 <= n, longer).otherwise(power)


def _ends(line: Column, n: Column) -> Column:
    """Grain 1: hashes of the prefix and the suffix, of the lengths of both roles a line can have."""
    lengths = F.array_distinct(F.array(_grid(n), _grid(n - 1)))
    return F.flatten(F.transform(lengths, lambda c: F.array(F.xxhash64(F.lit("p"), c, F.left(line, c)), F.xxhash64(F.lit("s"), c, F.right(line, c)))))


def _segments(line: Column, n: Column) -> Column:
    """Grain 2: for the line as the shorter (or equally long) of a pair and as the longer, and each segment of
    the shorter length: the hash of the rest, and the segment."""

    def role(short: Column, longer: int) -> Column:
        def of(count: Column) -> Column:
            cut = lambda j: F.floor(j.cast("double") * short / count).cast("int")
            return F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda j: F.struct(
                    F.xxhash64(short, j, F.left(line, cut(j)), F.right(line, short - cut(j + 1))).alias("rest"),
                    F.substr(line, cut(j) + 1, cut(j + 1) - cut(j) + longer).alias("part"),
                    F.lit(bool(longer)).alias("longer"),
                ),
            )

        return let(F.greatest(F.lit(3), F.ceil(F.cbrt(short.cast("double")) / 2)).cast("int"), of)

    return F.concat(role(n, 0), role(n - 1, 1))


def _variants(rest: Column, part: Column, longer: Column) -> Column:
    """Grain 3: (role, hash): x replaces a character, l deletes one to become the shorter line, s is that line."""

    def of(size: Column) -> Column:
        less = lambda i: F.concat(F.left(part, i), F.right(part, size - i - 1))
        every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        keyed = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("key"))
        replaced = F.transform(every, lambda i: keyed("x", F.xxhash64(rest, F.lit("x"), i, less(i))))
        deleted = F.array_distinct(F.transform(every, lambda i: keyed("l", F.xxhash64(rest, F.lit("i"), less(i)))))
        return F.when(longer, deleted).otherwise(F.concat(replaced, F.array(keyed("s", F.xxhash64(rest, F.lit("i"), part)))))

    return let(F.length(part), of)


def _in_company(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The rows whose ``key`` another ``line`` has too; ``rows`` is read twice."""
    shared = rows.groupBy(key).agg(F.min(line).alias("_a"), F.max(line).alias("_b")).where("_a <> _b").select(key)
    return rows.join(shared, key, "left_semi")


def places(docs: DataFrame, min_chars: int, ends: bool) -> DataFrame:
    """``doc_id, doc_key, no, h1, h2`` of each line that has a word, and the ``ends`` of those that are long enough."""
    text = F.col("text").cast("string")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    lines = lines.withColumn("n", F.length("line")).where(F.btrim("line", F.lit(SPACE)) != "")
    out = lines.withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line")})
    if ends:
        out = out.withColumn("ends", F.when(F.col("n") >= max(min_chars, 4), _ends(F.col("line"), F.col("n"))))
    return out.drop("line", "n")


def _at() -> Column:
    """The order of lines: by doc_id, null last, then a hash of the text, then the place in the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("doc_key").alias("doc_key"), F.col("no").alias("no"))


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``h1, h2, at``) with the text ``line`` that is found there."""
    at = F.col("at")
    spots = wanted.groupBy(at["doc_id"].alias("w_id"), at["doc_key"].alias("w_key")).agg(F.collect_list(F.struct("h1", "h2", "at")).alias("spots"))
    spots = F.broadcast(spots) if wanted.count() <= BROADCAST_LINES else spots
    text = F.col("text").cast("string")
    # of equal rows one is enough
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    lines = own.join(spots, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    found = let(F.split("text", "\n"), lambda a: F.transform("spots", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), F.get(a, x["at"]["no"]).alias("line"))))
    return lines.select(F.explode(found).alias("x")).select("x.*").dropDuplicates(["h1", "h2"])


def near(docs: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """``h1, h2`` of the lines whose earliest place comes after that of a line one edit away.

    ``lines``: ``places`` of the documents; ``found``: ``h1, h2, at`` of each different line.
    """
    ends = lines.select("h1", F.explode("ends").alias("key")).distinct()
    some = _in_company(ends, "key", "h1").select("h1").distinct()
    texts = stored(fetched(docs, stored(found.join(some, "h1", "left_semi"))))

    parts = stored(texts.select("h1", F.explode(let(F.length("line"), lambda n: _segments(F.col("line"), n))).alias("x")).select("h1", "x.*"))
    parts = _in_company(parts, "rest", "h1")
    keys = stored(parts.select("h1", F.explode(_variants(F.col("rest"), F.col("part"), F.col("longer"))).alias("x")).select("h1", "x.*"))
    keys = stored(_in_company(keys, "key", "h1").join(texts.select("h1", "h2", "at"), "h1"))

    own = F.struct("at", "h1", "h2")
    first = lambda role: F.min(F.when(F.col("role") == role, own)).alias(f"first_{role}")
    groups = keys.groupBy("key").agg(first("x"), first("s"), first("l"))
    mate = F.when(F.col("role") == "x", F.col("first_x")).when(F.col("role") == "s", F.col("first_l")).otherwise(F.col("first_s"))
    pairs = keys.join(groups, "key").select("h1", "h2", "at", mate.alias("mate")).where(F.col("mate.at") < F.col("at")).select("h1", "h2", F.col("mate.h1").alias("m1"), F.col("mate.h2").alias("m2")).distinct()
    other = texts.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("line").alias("mate"))
    both = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(other, ["m1", "m2"])
    return both.where(F.levenshtein("line", "mate", 1) == 1).select("h1", "h2").distinct()


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """``d_id, d_key, gone``: the places of the lines that go, for each document that has any."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = stored(places(docs, min_chars, max_edits > 0))
    found = stored(lines.groupBy("h1", "h2").agg(F.min(_at()).alias("at")))
    if max_edits:
        found = stored(found.join(near(docs, lines, found).withColumn("late", F.lit(True)), ["h1", "h2"], "left"))
    else:
        found = found.withColumn("late", F.lit(None).cast("boolean"))
    placed = lines.join(found, ["h1", "h2"]).withColumn("goes", F.coalesce(F.col("late"), F.lit(False)) | (_at() != F.col("at")))
    return placed.where("goes").groupBy(F.col("doc_id").alias("d_id"), F.col("doc_key").alias("d_key")).agg(F.collect_set("no").alias("gone"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text``, and ``n_lines`` and ``n_dropped`` as longs.

    All rows and columns stay (``n_lines`` and ``n_dropped`` replace columns of these names); a document all of
    whose lines go has an empty text. A null text stays null and has no lines. Rows that agree in doc_id and
    text count as one document. Lines without a word stay; lines of fewer than ``min_chars`` characters (4 at least)
    are compared for equality only.
    """
    gone = dropped(docs, min_chars, max_edits)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n")
    stay = lambda all_lines: F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    rest = let(lines, lambda all_lines: F.concat_ws("\n", F.transform(stay(all_lines), lambda i: F.get(all_lines, i))))
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(rest)
    columns = [(new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def sql(min_chars: int = MIN_CHARS) -> str:
    """The same in DuckDB SQL, over ``documents`` with different ids: pairs are found by an equal half and compared."""
    return f"""
with t as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from t),
e as (select doc_id, no, line, length(line) as n from l where translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''),
d as (select line, n, min({{'none': doc_id is null, 'doc_id': doc_id, 'no': no}}) as spot from e group by all),
k as (select line, spot, n, unnest([n, n - 1]) as short from d where n >= {max(min_chars, 4)}),
h as (select line, spot, n, short, 'p' as side, left(line, short // 2) as half from k union all select line, spot, n, short, 's', right(line, short - short // 2) from k),
p as (select distinct b.line, a.line as mate, b.n as n, a.n as m from h a join h b on a.short = b.short and a.side = b.side and a.half = b.half and a.spot < b.spot and a.line <> b.line),
v as (select distinct line from p where case
  when n = m then len(list_filter(range(1, n + 1), lambda i: line[i] <> mate[i])) = 1
  when n = m + 1 then len(list_filter(range(1, n + 1), lambda i: left(line, i - 1) || substr(line, i + 1) = mate)) > 0
  when m = n + 1 then len(list_filter(range(1, m + 1), lambda i: left(mate, i - 1) || substr(mate, i + 1) = line)) > 0 else false end),
g as (select e.doc_id, list(e.no) as gone from e join d using (line) left join v using (line)
  where v.line is not null or {{'none': e.doc_id is null, 'doc_id': e.doc_id, 'no': e.no}} <> d.spot group by e.doc_id)
select t.doc_id, case when gone is null then text else array_to_string(list_transform(list_filter(range(len(ls)), lambda i: not list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) end as text,
  coalesce(len(ls), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_dropped from t left join g on t.doc_id is not distinct from g.doc_id"""
