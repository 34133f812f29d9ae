"""Nearest neighbours by cosine with cross-polytope hashing.

A vector is turned by a pseudo-random rotation, three rounds of random signs and a fast Hadamard transform,
and hashed to the signed axis nearest to it. ``depth`` such axes make a bucket, and each of ``tables`` groups of
rotations gives every vector one; a query looks into the ``probes`` buckets of each table whose axes are nearest to
it together. Candidates are compared exactly, in double precision on the original vectors, so hashing decides only
which pairs are looked at. A query that finds fewer than ``k`` that way is compared with all vectors, in blocks.

Scale: ``depth`` follows from the number of vectors, so that a bucket holds about ``BLOCK`` of them at most, and each
step in it looks at ``WIDER`` times as many buckets; the share of vectors that a query meets falls with each step.
Index and queries meet by (length, bucket, part); only a bucket of over ``BLOCK`` vectors has several parts, and
queries go to each. A group is one block of vectors and the queries that probe it, compared as matrices. Pairs
never become rows: a query leaves each block with at most ``k`` neighbours. Nothing is broadcast by order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftframe.llm.text import cut

#: Vectors of one bucket that a task holds at once.
BLOCK = 4096
#: Queries of one block that are compared at once.
QUERIES = 512
TABLES, PROBES = 8, 12
#: So many times the probes for each axis of a bucket after the first.
WIDER = 16
DEEPEST = 4


@dataclass(frozen=True)
class CrossPolytope:
    """Rotations for vectors of ``dim`` components, padded with zeros to a power of two."""

    dim: int
    tables: int = TABLES
    depth: int = 1
    seed: int = 20

    @property
    def width(self) -> int:
        return 1 << max(0, self.dim - 1).bit_length()

    def rotated(self, x: np.ndarray, number: int) -> np.ndarray:
        signs = np.random.default_rng([self.seed, number]).integers(0, 2, (3, self.width)) * 2.0 - 1.0
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for s in signs:
            y = hadamard(y * s)
        return y

    def buckets(self, x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The ``probes`` nearest buckets of each row, nearest first: axis i is i, its opposite width + i, and the
        axes of a bucket are the digits of its number."""
        code, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k in range(self.depth):
            y = self.rotated(x, table * self.depth + k)
            near = np.hstack([y, -y])
            if probes == 1:
                code = code * near.shape[1] + near.argmax(axis=1)[:, None]
                continue
            axes = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            far = (total[:, :, None] + np.take_along_axis(near, axes, axis=1)[:, None, :]).reshape(len(x), -1)
            every = (code[:, :, None] * near.shape[1] + axes[:, None, :]).reshape(len(x), -1)
            order = np.argsort(-far, axis=1, kind="stable")[:, :probes]
            code, total = np.take_along_axis(every, order, axis=1), np.take_along_axis(far, order, axis=1)
        return code


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lengths; rows whose squares leave the range of doubles are divided by their largest
    component first, which doesn't change their direction."""
    with np.errstate(over="ignore", under="ignore"):
        square = (x * x).sum(axis=1)
    odd = ~np.isfinite(square) | (square < 1e-280)
    if odd.any():
        x = np.where(odd[:, None], x / np.abs(x).max(axis=1, keepdims=True), x)
        square = (x * x).sum(axis=1)
    return x, np.sqrt(square)


def usable(vector: Column) -> Column:
    """Not null, not zero, and with finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part: a non-null id and a usable vector."""
    v = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    return v.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def depth_for(v: DataFrame, block: int = BLOCK) -> int:
    """Axes of a bucket with which it holds about ``block`` vectors at most."""
    first = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    axes, depth = 2 * CrossPolytope(first["dim"] or 1).width, 1
    while depth < DEEPEST and first["n"] > block * axes**depth:
        depth += 1
    return depth


def _dtype(v: DataFrame) -> np.dtype:
    return np.dtype("<f4" if v.schema["vector"].dataType.elementType == T.FloatType() else "<f8")


def hashed(v: DataFrame, tables: int, depth: int, probes: int) -> DataFrame:
    """``vec_id, dim, bucket, raw`` for each table and probe; bucket numbers differ between tables."""
    dtype = _dtype(v)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dims = np.asarray([len(x) for x in part.column("vector")])
            for dim in np.unique(dims).tolist():
                own = part.take(pa.array(np.flatnonzero(dims == dim)))
                lsh = CrossPolytope(dim, tables, depth)
                x = np.asarray(own.column("vector").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dim)
                ids, raw = own.column("vec_id"), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())
                turned, length = scaled(x)
                unit = turned / length[:, None]
                for t in range(tables):
                    for at in range(0, len(x), QUERIES):
                        b = lsh.buckets(unit[at : at + QUERIES], t, probes) * tables + t
                        rows = pa.array(at + np.repeat(np.arange(len(b)), b.shape[1]))
                        yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.full(len(rows), dim, np.int32)), pa.array(b.ravel()), raw.take(rows)], names=["vec_id", "dim", "bucket", "raw"])

    return v.mapInArrow(run, "vec_id long, dim int, bucket long, raw binary")


def unhashed(v: DataFrame) -> DataFrame:
    """The same with all vectors of a length in one bucket."""
    dtype = _dtype(v)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = [np.asarray(x.as_py(), dtype) for x in part.column("vector")]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([len(x) for x in raw], pa.int32()), pa.array([-1] * len(raw), pa.int64()), pa.array([x.tobytes() for x in raw], pa.binary())], names=["vec_id", "dim", "bucket", "raw"])

    return v.mapInArrow(run, "vec_id long, dim int, bucket long, raw binary")


def compared(index: DataFrame, asked: DataFrame, k: int, dtype: np.dtype, block: int) -> DataFrame:
    """``query_id, part, ids, scores``: the ``k`` nearest of each block of a bucket to each query that asks for it."""

    def compare(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(wanted):
            held = held.drop_duplicates(["vec_id", "raw"])
            ids, q_ids, dim, part = held["vec_id"].to_numpy(), wanted["vec_id"].to_numpy(), int(held["dim"].iloc[0]), int(held["part"].iloc[0])
            (x, xl), (q, ql) = (scaled(np.frombuffer(b"".join(f["raw"]), dtype).astype(float).reshape(-1, dim)) for f in (held, wanted))
            for at in range(0, len(q), QUERIES):
                rough = (q[at : at + QUERIES] / ql[at : at + QUERIES, None]) @ (x / xl[:, None]).T
                for row, score in enumerate(rough, at):
                    score[ids == q_ids[row]] = -np.inf
                    n = min(k, int((score > -np.inf).sum()))
                    if n:
                        # rounding may order equal scores by chance; what could be among the first n is worked out again
                        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n] - 1e-9)
                        exact = np.clip((x[near] * q[row]).sum(axis=1) / (xl[near] * ql[row]), -1.0, 1.0)
                        best = np.lexsort((ids[near], -exact))[:n]
                        out.append((q_ids[row], part, ids[near][best].tolist(), exact[best].tolist()))
        return pd.DataFrame(out, columns=["query_id", "part", "ids", "scores"])

    key = ["dim", "bucket", "part"]
    split = index.groupBy("dim", "bucket").count().where(F.col("count") > block).select("dim", "bucket", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    parted = lambda df: df.join(split, ["dim", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    index = parted(index).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asked = parted(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(compare, "query_id long, part int, ids array<long>, scores array<double>")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """``query_id, best``: the first ``k`` of all blocks, as structs (far, id) with far = -score; first within groups of
    blocks, so that no list grows with the number of blocks."""
    first = lambda all_lists: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(all_lists)))), 1, k)
    each = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("id")))
    some = found.groupBy("query_id", F.floor(F.col("part") / 256).alias("some")).agg(first(each).alias("best"))
    return some.groupBy("query_id").agg(first(F.col("best")).alias("best"))


def search(base: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first, ties by id.

    ``base`` and ``queries`` are ``vec_id, vector`` from ``vectors``. A query is not its own neighbour: no
    row with its id is. Vectors of different lengths have no cosine and are no candidates for each other. Repeated
    rows are found once; of different vectors with one id each may be found, and as queries they answer together.
    Equal vectors have equal scores. A query has ``k`` rows, or one for each candidate if there are fewer; an
    empty base or no queries give an empty result.
    """
    queries = queries.select("vec_id", F.col("vector").cast(base.schema["vector"].dataType).alias("vector"))
    depth, dtype = depth or depth_for(base, block), _dtype(base)
    near = compared(hashed(base, tables, depth, 1), hashed(queries, tables, depth, probes * WIDER ** (depth - 1)), k, dtype, block)
    best = cut(nearest(near, k))
    enough = best.where(F.size("best") >= k)
    short = cut(queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if not short.isEmpty():
        best = enough.unionByName(nearest(compared(unhashed(base), unhashed(short), k, dtype, block), k))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
