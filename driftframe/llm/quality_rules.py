"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a Column over the text; ``RULES`` bounds ratios of measures. No shuffle, no user function:
a document's verdict depends on its own text alone, so the plan is a scan and a projection at any size.

Defined results: a null or empty text has no words, all its measures are 0, and it fails the base rules.
Repeated rows and equal ids each get their own row. Input columns that clash with output names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words.
SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the supported languages.
STOP_WORDS = (
    "the of and to in is was that for it with as on be at by this from or an are not have which he his a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat sie nach bei um am sind war "
    "le la les et en du une un que est pour qui dans par plus pas au sur ne se ce il sont avec ou son elle aux de "
    "el los las y en del se por con no una su para es al lo como más o pero sus ha este si un"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``lower * under <= over <= upper * under``."""

    name: str
    over: str
    under: str | None = None
    lower: float | None = None
    upper: float | None = None


#: Production thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", upper=0.1),
    Rule("stop_words", "n_stop_words", "n_words", lower=0.02),
    Rule("lines", "n_dup_lines", "n_lines", upper=0.5),
    Rule("shouting", "n_upper", "word_chars", upper=0.5),
    Rule("exclamation", "n_bangs", "n_words", upper=0.2),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(pairs: Column) -> Column:
    """Of structs sorted by their first field: those whose first field another one shares."""
    return let(
        pairs,
        lambda s: F.filter(
            s,
            lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
        ),
    )


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice. Windows are first matched by a 64-bit hash;
    those that share one are then compared as text, so the count is exact."""

    def hashed(a: Column) -> Column:
        return F.sort_array(
            F.transform(F.slice(a, 3, F.greatest(F.size(a) - 2, F.lit(0))), lambda c, i: F.struct(F.xxhash64(F.get(a, i), F.get(a, i + 1), c).alias("h"), i.alias("i")))
        )

    def exact(a: Column, same: Column) -> Column:
        return F.sort_array(F.transform(same, lambda x: F.struct(F.concat_ws(" ", F.slice(a, x["i"] + 1, 3)).alias("h"), x["i"].alias("i"))))

    def covered(same: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(w, lambda a: covered(_repeated(exact(a, _repeated(hashed(a)))))).cast("long")


def measures(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """Each measure as a long; ``w``: the words of ``text``; ``lines``: its lines that have a word."""
    flat = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(_without(flat, SPACE)).cast("long"),
        "n_symbols": (F.length(flat) - F.length(_without(flat, SYMBOLS))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": n_repeat_words(w),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        "n_upper": (F.length(flat) - F.length(F.regexp_replace(flat, r"\p{Lu}", ""))).cast("long"),
        "n_bangs": (F.length(flat) - F.length(_without(flat, "!"))).cast("long"),
    }


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The table as one predicate over measure columns."""
    kept = F.lit(True)
    for r in rules:
        value = F.col(r.over).cast("double")
        bound = F.col(r.under) if r.under else F.lit(1)
        if r.lower is not None:
            kept = kept & (value >= F.lit(r.lower) * bound)
        if r.upper is not None:
            kept = kept & (value <= F.lit(r.upper) * bound)
    return kept


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every measure, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    body = F.col(text).cast("string")
    parts = let(
        words(body),
        lambda w: let(
            F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: _without(x, SPACE) != ""),
            lambda lines: F.struct(*(c.alias(n) for n, c in measures(body, w, lines).items())),
        ),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper", "n_bangs"]
    taken = {*names, "base_failed", "kept", "_m"}
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in taken), parts.alias("_m"))
    out = own.select(*(F.col(f"`{c}`") for c in own.columns if c != "_m"), *(F.col(f"_m.{n}").alias(n) for n in names))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def sql(rules: Sequence[Rule] = RULES) -> str:
    """The same in DuckDB SQL, over ``documents``."""
    w = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    stop = ", ".join("'" + x + "'" for x in sorted(set(STOP_WORDS)))
    cond = []
    for r in rules:
        bound = r.under or "1"
        cond += [f"{r.over}::double >= {r.lower!r} * {bound}"] * (r.lower is not None) + [f"{r.over}::double <= {r.upper!r} * {bound}"] * (r.upper is not None)
    return f"""
with d as (select doc_id, coalesce(text, '') as t, {w} as w from documents),
l as (select doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: translate(x, {space}, '') <> '') as ls,
      case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end as g from d),
r as (select row_number() over () as r, * from l),
x as (select r, unnest(g) as gram, unnest(range(1, len(g) + 1)) as i from r),
y as (select r, i, count(*) over (partition by r, gram) as n from x),
z as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from y where n > 1) group by r),
m as (select doc_id, len(w)::bigint as n_words, length(translate(t, {space}, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
  (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::bigint as n_upper, (length(t) - length(translate(t, '!', '')))::bigint as n_bangs
  from r left join z using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select *, not base_failed and {" and ".join(cond)} as kept from b"""
