"""Manifest of a table as a Merkle tree, with a proof for every row.

Rows are numbered within their source without any task holding a source, and dealt into aligned blocks of ``3 ** HEIGHT``
leaves. A block's paths are made leaf by leaf by Merkle traversal: each level keeps the run of siblings around the
current leaf, and a treehash stack for each level works out the next run's nodes a few leaves at a time, the
stack whose lowest node is lowest first. So beside the block's own leaves a task holds a number of nodes
that is logarithmic in the block. The roots of blocks are leaves of the next blocks, and so on up to one root for each
source; roots of sources are the leaves of one more tree. What all leaves of a block share, the path
from its root upwards, is appended once for the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.text import stored

#: Children of a node.
RUN = 3
#: Levels of a block.
HEIGHT = 8

#: One level of a path: the place of the own node in its run, and the others.
Level = tuple[int, list[str]]


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(node: str, path: Sequence[Level]) -> str:
    """The root that ``node`` leads to along a path."""
    for at, others in path:
        node = digest([*others[:at], node, *others[at:]])
    return node


class Treehash:
    """Nodes ``first`` to ``last`` (without) of a level, worked out leaf by leaf on one stack."""

    def __init__(self, leaves: Sequence[str], level: int, first: int, last: int):
        self.leaves, self.level = leaves, level
        self.at, self.stop = first * RUN**level, min(last * RUN**level, len(leaves))
        self.stack: list[tuple[int, str]] = []

    @property
    def done(self) -> bool:
        return self.at >= self.stop

    def tail(self) -> int:
        """The lowest level on the stack that isn't finished."""
        return self.stack[-1][0] if self.stack and self.stack[-1][0] < self.level else self.level

    def update(self) -> None:
        """Take one leaf in, and join the runs that it ends."""
        self.stack.append((0, self.leaves[self.at]))
        self.at += 1
        for level in range(self.level):
            if self.at % RUN ** (level + 1) and self.at < len(self.leaves):
                break
            run = []
            while self.stack and self.stack[-1][0] == level:
                run.append(self.stack.pop()[1])
            self.stack.append((level + 1, digest(run[::-1])))

    def nodes(self) -> list[str]:
        """What isn't there yet is worked out now."""
        while not self.done:
            self.update()
        return [node for _, node in self.stack]


class Traversal:
    """Authentication paths of the leaves of one block, in order."""

    def __init__(self, leaves: Sequence[str], height: int):
        self.leaves, self.height = leaves, height
        #: The nodes of the current run of each level but for those to the left, then those.
        self.right: list[list[str]] = []
        self.left: list[list[str]] = [[] for _ in range(height)]
        self.next = [self._after(level, 0) for level in range(height)]
        self.right = [Treehash(leaves, level, 1, RUN).nodes() for level in range(height)]
        #: Most nodes held at once, and leaves taken in out of turn.
        self.held, self.late = 0, 0

    def _after(self, level: int, run: int) -> Treehash:
        """The stack for the nodes to the right of the first one in the run after ``run``."""
        return Treehash(self.leaves, level, RUN * (run + 1) + 1, RUN * (run + 2))

    def __iter__(self) -> Iterator[list[Level]]:
        for i in range(len(self.leaves)):
            self.held = max(self.held, sum(len(x) for x in (*self.left, *self.right, *(t.stack for t in self.next))))
            yield [(len(a), [*a, *b]) for a, b in zip(self.left, self.right, strict=True)]
            if i + 1 < len(self.leaves):
                self._advance(i)

    def _advance(self, i: int) -> None:
        node = self.leaves[i]
        for level in range(self.height):
            if (i + 1) % RUN ** (level + 1):  # the run goes on: this node is now to the left, the next one the own
                self.left[level].append(node)
                self.right[level] = self.right[level][1:]
                break
            node = digest([*self.left[level], node])
            following = self.next[level]
            self.late += max(0, following.stop - following.at)
            self.left[level], self.right[level] = [], following.nodes()
            self.next[level] = self._after(level, (i + 1) // RUN ** (level + 1))
        for _ in range(self.height):  # two thirds of it are needed
            waiting = [t for t in self.next if not t.done]
            if not waiting:
                break
            min(waiting, key=Treehash.tail).update()


def root(leaves: Sequence[str], height: int) -> str:
    return Treehash(leaves, height, 0, 1).nodes()[0]


def levels(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // RUN), out + 1
    return out


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str = "idx") -> DataFrame:
    """``rows`` with ``idx``, their number from 0 in the order of ``order`` within ``group``, and ``n``, the group's
    size. Rows are sorted by range over all groups, so a group may spread over many tasks; only counts for each group and
    range are summed."""
    keys = [group, *order]
    sized = rows.withColumn("_row", F.monotonically_increasing_id())  # tells equal rows apart, so that ranges stay even
    ranged = stored(sized.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").withColumn("_at", F.monotonically_increasing_id()).drop("_row"))
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group)  # one row for each range of the group
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return ranged.withColumn("_part", part).join(starts, [group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


LEVELS = "array<struct<at:int, others:array<string>>>"


def _levels(value: object) -> list[Level]:
    return [] if value is None else [(int(x["at"]), list(x["others"])) for x in value]


def _height(n: int, height: int) -> int:
    """Levels of a block of a tree over ``n`` leaves: all that a block has, or those of the whole tree."""
    return min(height, levels(n))


def tree(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``group, block, root, upper`` for ``group, idx, node, n``: for each aligned block of ``RUN ** height`` nodes the root
    of its group and the path that leads there from the block's own root."""
    block = F.floor(F.col("idx") / RUN**height).cast("long").alias("block")

    def top(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        n = int(part["n"].iloc[0])
        return pd.DataFrame({"group": [part["group"].iloc[0]], "block": [part["block"].iloc[0]], "node": [root(part["node"].tolist(), _height(n, height))], "n": [-(-n // RUN**height)]})

    tops = stored(nodes.select("group", block, "idx", "node", "n").groupBy("group", "block").applyInPandas(top, "group string, block long, node string, n long"))
    alone = tops.where("n = 1").select("group", "block", F.col("node").alias("root"), F.expr(f"cast(array() as {LEVELS})").alias("upper"))
    rest = tops.where("n > 1").select("group", F.col("block").alias("idx"), "node", "n")
    if rest.isEmpty():
        return alone
    return alone.unionByName(paths(rest, height).select("group", F.col("idx").alias("block"), "root", F.col("path").alias("upper")))


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``group, idx, root, path`` of every node for ``group, idx, node, n``."""

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        upper = _levels(above["upper"].iloc[0])
        walk = Traversal(part["node"].tolist(), _height(int(part["n"].iloc[0]), height))
        found = [[{"at": at, "others": others} for at, others in [*path, *upper]] for path in walk]
        return pd.DataFrame({"group": part["group"], "idx": part["idx"], "root": above["root"].iloc[0], "path": found})

    own = nodes.select("group", F.floor(F.col("idx") / RUN**height).cast("long").alias("block"), "idx", "node", "n")
    above = tree(nodes, height)
    return own.groupBy("group", "block").cogroup(above.groupBy("group", "block")).applyInPandas(run, f"group string, idx long, root string, path {LEVELS}")


def _counted(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(_counted, columns)), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    A leaf is the hash of the five columns of ``FIELDS``; leaves of a source ascend by doc_id, null first, and rows that
    share an id by their leaf. ``text`` is what a row's text has become since; ``folded_root`` is where its
    leaf leads along the path of the old one, and ``verified`` whether that is the root. Null sources are a source of their
    own, the first; nulls and empty texts have different leaves. Other columns aren't read. An empty table gives none.
    """
    text = F.col("text") if text is None else text
    own = [F.col(c) for c in FIELDS]
    source = F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("group"),
        leaf(own).alias("node"), leaf([*own[:-1], text]).alias("now"),
    )
    placed = numbered(stored(rows), "group", ["doc_id", "node"])
    blocks = stored(tree(placed, height))
    sources = blocks.groupBy("group").agg(F.first("root").alias("node")).select(F.lit("").alias("one"), F.col("group").alias("source"), "node")
    over = numbered(sources, "one", ["source"]).select(F.col("one").alias("group"), "idx", "node", "n", "source")
    tops = paths(over.drop("source"), height).join(over.select("idx", "source"), "idx").select(F.col("source").alias("group"), F.col("root").alias("top"), F.col("path").alias("tail"))
    above = blocks.join(tops, "group")

    def run(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        upper, final = _levels(above["upper"].iloc[0]) + _levels(above["tail"].iloc[0]), above["top"].iloc[0]
        proofs, folded = [], []
        for path, now in zip(Traversal(part["node"].tolist(), _height(int(part["n"].iloc[0]), height)), part["now"], strict=True):
            path = [*path, *upper]
            proofs.append(digest([x for _, others in path for x in others]))
            folded.append(fold(now, path))
        return pd.DataFrame({
            "doc_id": part["doc_id"], "group": part["group"], "leaf": part["node"], "subroot": above["root"].iloc[0], "root": final, "proof_sha256": proofs, "folded_root": folded,
        })

    schema = "doc_id string, group string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    doc_id = F.col("doc_id").cast("string").alias("doc_id")  # a null would turn the numbers of a block into floating ones
    own = placed.select("group", F.floor(F.col("idx") / RUN**height).cast("long").alias("block"), "idx", doc_id, "node", "now", "n")
    out = own.groupBy("group", "block").cogroup(above.groupBy("group", "block")).applyInPandas(run, schema)
    name = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """DuckDB SQL of the registered query: texts lose their line breaks where 2 divides the CRC of the decimal doc_id."""
    counted = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    hashed = lambda text: "sha256(" + " || ".join(counted(c) for c in (*FIELDS[:-1], text)) + ")"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {step}), 4294967295)"
    up = "select {keys}, lvl + 1, idx // 3, sha256(string_agg(node, '' order by idx)), (n + 2) // 3 from {t} where n > 1 group by {keys}, lvl, idx // 3, n"
    return f"""with recursive r as (select *, coalesce('=' || source, '') as g, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end as later from documents),
h as (select doc_id, g, {hashed("text")} as leaf, {hashed("later")} as now from r),
l as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as n from h),
t(g, lvl, idx, node, n) as (select g, 0::bigint, idx, leaf, n from l union all {up.format(keys="g", t="t")}),
s as (select g, node as subroot, row_number() over (order by g) - 1 as idx, count(*) over () as n from t where n = 1),
u(lvl, idx, node, n) as (select 0::bigint, idx, subroot, n from s union all {up.format(keys="", t="u").replace("select ,", "select").replace("group by ,", "group by")}),
b as (select t.g, lvl, t.idx, node, n, 0 as part from t where n > 1 union all select '', lvl, idx, node, n, 1 from u where n > 1),
p as (select l.g, l.idx as pos, b.part, b.lvl, b.idx as sib, b.node, l.idx // (3 ** b.lvl)::bigint as own from l join b on b.part = 0 and b.g = l.g and b.idx // 3 = l.idx // (3 ** (b.lvl + 1))::bigint
  union all select l.g, l.idx, b.part, b.lvl, b.idx, b.node, s.idx // (3 ** b.lvl)::bigint from l join s using (g) join b on b.part = 1 and b.idx // 3 = s.idx // (3 ** (b.lvl + 1))::bigint),
o as (select g, pos, string_agg(node, '' order by part, lvl, sib) filter (sib <> own) as listed from p group by g, pos),
q as (select *, dense_rank() over (partition by g order by part, lvl) as k from p),
f(g, pos, k, node) as (select g, idx, 0::bigint, now from l union all
  select f.g, f.pos, f.k + 1, sha256(string_agg(case when q.sib = q.own then f.node else q.node end, '' order by q.sib)) from f join q on q.g = f.g and q.pos = f.pos and q.k = f.k + 1 group by f.g, f.pos, f.k),
e as (select g, pos, arg_max(node, k) as folded_root from f group by g, pos), top as (select node as root from u where n = 1)
select doc_id, leaf, subroot, root, sha256(coalesce(listed, '')) as proof_sha256, folded_root, folded_root = root as verified
from l join s using (g) join e on e.g = l.g and e.pos = l.idx left join o on o.g = l.g and o.pos = l.idx, top"""
