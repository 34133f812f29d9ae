"""Alignment of two tokenizers over the same texts: which tokens of one overlap which of the other.

Texts are taken in bundles of bounded size inside each Arrow partition. A bundle's texts are cut into units at
places that no token of either tokenizer can span, so each different unit is tokenised and aligned once. The first and the
last token of B under each token of A are searched in the sorted ends, which gives the overlaps; DuckDB numbers the
groups by an as-of join and running sums of common ends. Each bundle
gives its different pairs of ids with the number of its documents that hold them; Spark adds these up over
all bundles, finds the best count of every A id, and sends each bundle only the totals of its own pairs. Documents
cross the network as numbers of units, never as texts, and no task sees more than a bundle and its pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.text import stored

#: Bytes of text in a bundle; a longer text is a bundle of its own.
BUNDLE_BYTES = 5 << 19
#: Units that are handed to a tokenizer at once.
BATCH = 5_000
#: A unit ends at a space between two such characters: a letter, digit or mark of ASCII before it, a letter or digit after it.
#: Byte-level BPE begins a new piece there, and sentence pieces hold the sign for a space at their beginning only.
ENDS, BEGINS = re.compile(r"[\w!-/:-@\[-`{-~]"), re.compile(r"\w")


@lru_cache(maxsize=1 << 16)
def _ends(character: str) -> bool:
    return ENDS.match(character) is not None


@lru_cache(maxsize=1 << 16)
def _begins(character: str) -> bool:
    return BEGINS.match(character) is not None


SCHEMA = """bundle string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,
    units binary, pairs binary, a array<int>, b array<int>, n array<bigint>"""
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

#: Where tokens of A end with one of B, and the number of such ends before each, that is its group.
GROUPS = """
select coalesce(sum(cut) over (order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as g, coalesce(cut, 0) = 1 as cut
from (select a.ord, (a.stop = b.stop)::int as cut from tok_a a asof left join tok_b b on a.stop >= b.stop)
order by ord
"""


def _byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, read backwards: printable ones stand for
    themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Ids of units one after the other, and how many each unit has.
Tokens = tuple[np.ndarray, np.ndarray]


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, "rb") as f:
            self.a = Tokenizer.from_str(f.read().decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of, vocabulary = _byte_of_char(), self.a.get_vocab()
        special = {t["content"] for t in json.loads(self.a.to_str())["added_tokens"]}
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            bytes_a[i] = piece.encode() if piece in special else bytes(of[c] for c in piece)
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.bytes = (bytes_a, bytes_b)
        self.length = [np.array([len(b) for b in x], dtype=np.int64) for x in self.bytes]

    def _ids(self, side: int, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which B adds itself."""
        if side:
            return self.b.encode([t[1:] for t in texts], num_threads=1)
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, units: list[str], joinable: int = 0) -> tuple[list[Tokens], np.ndarray]:
        """The tokens of each unit on both sides, and which units are given back byte by byte by both. Of the first
        ``joinable`` units many are tokenised as one text; if that text isn't given back, each one on its own."""
        flat: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        whole = []
        for i in [*range(0, joinable, BATCH), *range(joinable, len(units), BATCH)]:
            part = units[i : min(i + BATCH, joinable) if i < joinable else i + BATCH]
            raw = [u.encode("utf-8", "surrogatepass") for u in part]
            got = self._together(part, raw) if i < joinable else None
            fits = np.ones(len(part), dtype=bool)
            if got is None:
                got = []
                for side in (0, 1):
                    ids = self._ids(side, part)
                    fits &= np.array([b"".join(map(self.bytes[side].__getitem__, x)) == r for x, r in zip(ids, raw, strict=True)], dtype=bool)
                    got.append((np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids], dtype=np.int64)))
            for side in (0, 1):
                flat[side].append(got[side][0])
                counts[side].append(got[side][1])
            whole.append(fits)
        joined = lambda x, kind: np.concatenate([*x, np.zeros(0, dtype=kind)])
        return [(joined(flat[k], np.int32), joined(counts[k], np.int64)) for k in (0, 1)], joined(whole, bool)

    def _together(self, units: list[str], raw: list[bytes]) -> list[Tokens] | None:
        """Tokens of units that follow each other in one text, if both sides give it back and end tokens where units end."""
        text, ends = "".join(units), np.cumsum([len(r) for r in raw])
        out = []
        for side in (0, 1):
            ids = np.array(self._ids(side, [text])[0], dtype=np.int32)
            stop = np.cumsum(self.length[side][ids])
            at = np.searchsorted(stop, ends)
            if at.max(initial=0) >= len(stop) or (stop[at] != ends).any() or b"".join(map(self.bytes[side].__getitem__, ids.tolist())) != b"".join(raw):
                return None
            out.append((ids, np.diff(at + 1, prepend=0)))
        return out


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizers(path_a, path_b)


def _intervals(tokens: Tokens, length: np.ndarray) -> pa.Table:
    """Token table of units laid end to end: ``unit, ord, id, start, stop``."""
    ids, counts = tokens
    size = length[ids]
    stop = np.cumsum(size, dtype=np.int64)
    if len(stop) and stop[-1] < 1 << 31:  # as for all but single texts beyond that
        stop = stop.astype(np.int32)
    unit = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return pa.table({"unit": unit, "ord": np.arange(len(ids), dtype=np.int32), "id": ids, "start": stop - size.astype(stop.dtype), "stop": stop})


def _overlaps(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The unit of each overlap of a token of A with one of B, in order, and both ids as one number. Both sides cover the same
    bytes, so those under a token of A are the tokens of B from the last that begins where it does or before to the last
    that begins before its end."""
    starts = b["start"].to_numpy()
    lo = np.searchsorted(starts, a["start"].to_numpy(), "right") - 1
    n = np.maximum(np.searchsorted(starts, a["stop"].to_numpy()) - lo, 0)
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(a["unit"].to_numpy(), n), (np.repeat(a["id"].to_numpy().astype(np.int64), n) << 32) + b["id"].to_numpy()[at]


def _held(documents: list[np.ndarray], copies: np.ndarray, unit: np.ndarray, pair: np.ndarray, n_units: int, n_pairs: int) -> np.ndarray:
    """Documents that hold each pair: ``documents`` are the different units of each, which counts as often as it has
    copies, ``unit`` and ``pair`` the different pairs of each unit, by unit."""
    each = np.bincount(unit, minlength=n_units)
    first = np.cumsum(each) - each
    n, last = np.zeros(n_pairs, dtype=np.int64), np.zeros(n_pairs, dtype=np.int32)
    for units, c in zip(documents, copies, strict=True):
        k = each[units]
        own = pair[np.repeat(first[units] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        i = np.arange(len(own), dtype=np.int32)
        last[own] = i
        n[own[last[own] == i]] += c  # once for each pair of the document
    return n


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, best ascending, as compressed differences."""
    return zlib.compress(np.diff(numbers.astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int64)


def _joined(parts: pa.Array, starts: np.ndarray, mark: str) -> pa.Array:
    """Stretches of ``parts``, which begin at ``starts`` and end at the next, joined by ``mark``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), parts), mark)


def _listed(tokens: list[pa.Table], group: list[np.ndarray], n_units: int) -> tuple[pa.Array, np.ndarray]:
    """Each unit's groups as ``a1,a2|b1;a3|b2``, and their number, for the tokens of A and B and the groups' numbers."""
    n_groups = int(group[0][-1]) + 1 if len(group[0]) else 0
    starts = [np.searchsorted(g, np.arange(n_groups + 1)) for g in group]
    sides = [_joined(t["id"].combine_chunks().cast(pa.string()), i, ",") for t, i in zip(tokens, starts, strict=True)]
    each = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.string()))
    of = np.searchsorted(tokens[0]["unit"].to_numpy()[starts[0][:-1]], np.arange(n_units + 1))
    return _joined(each, of, ";"), np.diff(of)


class Bundle:
    """The documents of a bundle, aligned together."""

    def __init__(self, both: Tokenizers, name: str):
        self.both, self.name = both, name
        self.doc_ids: list[int | None] = []
        self.texts: list[int] = []  # for each document its different text
        self.known: dict[str, int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        """Texts that are equal are kept once; those that are null or empty have number -1."""
        self.doc_ids.append(doc_id)
        if text and text not in self.known:
            self.bytes += len(text)
        self.texts.append(self.known.setdefault(text, len(self.known)) if text else -1)

    def _cut(self) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Each different text as numbers of units, and the units: parts between spaces, those joined again between which
        no unit ends; and which units may follow each other in any order."""
        split = pc.split_pattern(pa.array(list(self.known), pa.string()), pattern=" ")
        coded = split.flatten().dictionary_encode()
        parts, flat, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        index: dict[str, int] = {}
        ends, begins = np.array([_ends(p[-1:]) for p in parts], dtype=bool), np.array([_begins(p[:1]) for p in parts], dtype=bool)
        cut = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            u = flat[i:j]
            bound = ends[u[:-1]] & begins[u[1:]]
            if not bound.all():
                if not index:
                    index = {p: k for k, p in enumerate(parts)}
                where = [0, *(np.flatnonzero(bound) + 1).tolist(), len(u)]
                names = [" ".join([parts[k] for k in u[a:b].tolist()]) for a, b in zip(where, where[1:], strict=False)]
                u = np.array([index.setdefault(n, len(index)) for n in names], dtype=np.int32)
            cut.append(u)
        more = list(index)[len(parts) :]
        free = np.r_[ends & begins, np.array([_ends(p[-1:]) and _begins(p[:1]) for p in more], dtype=bool)]
        return cut, [" " + p for p in (*parts, *more)], free

    def _units(self) -> tuple[list[np.ndarray], list[Tokens]]:
        """Units of each different text, and the tokens of each unit. A text of which a unit isn't whole is one unit of
        its own; if that isn't whole either, the text has no units. Units that no text holds have no tokens."""
        cut, units, free = self._cut()
        used = np.zeros(len(units), dtype=bool)
        used[np.concatenate([*cut, np.zeros(0, dtype=np.int32)])] = True
        safe = used & free & np.fromiter(("▁" not in u for u in units), bool, len(units))
        order = np.r_[np.flatnonzero(safe), np.flatnonzero(used & ~safe)]
        rank = np.full(len(units), -1, dtype=np.int32)
        rank[order] = np.arange(len(order))
        cut, units = [rank[u] for u in cut], [units[i] for i in order.tolist()]
        tokens, whole = self.both.encode(units, int(safe.sum()))
        broken = [i for i, u in enumerate(cut) if not whole[u].all()]
        if broken:
            texts = list(self.known)
            more, fits = self.both.encode([" " + texts[i] for i in broken])
            kept = np.zeros(len(units) + len(broken), dtype=bool)
            for k, i in enumerate(broken):
                cut[i] = np.array([len(units) + k] if fits[k] else [], dtype=np.int32)
            kept[np.concatenate([*cut, np.zeros(0, dtype=np.int32)])] = True
            for side in (0, 1):
                ids, counts = (np.concatenate([x, y]) for x, y in zip(tokens[side], more[side], strict=True))
                tokens[side] = ids[np.repeat(kept, counts)], np.where(kept, counts, 0)
        return cut, tokens

    def rows(self) -> pa.RecordBatch:
        """One row for each document, with its units, and one for the bundle's pairs: there ``units`` and ``pairs`` are the
        unit and the pair of each link, and ``a``, ``b``, ``n`` the ids of each pair and the documents that hold it."""
        cut, found = self._units()
        copies = np.bincount(np.array([t for t in self.texts if t >= 0], dtype=int), minlength=len(cut))
        held = [np.unique(u) for u in cut]
        tokens = [_intervals(x, length) for x, length in zip(found, self.both.length, strict=True)]
        unit, both = _overlaps(*tokens)
        ids, pair = np.unique(both, return_inverse=True)
        once = np.sort(unit * np.int64(max(len(ids), 1)) + pair)
        once = once[np.r_[True, once[1:] != once[:-1]][: len(once)]]  # a unit may have a pair more than once
        n = _held(held, copies, (once // max(len(ids), 1)), (once % max(len(ids), 1)).astype(np.int32), len(found[0][1]), len(ids))
        with duckdb.connect(config={"threads": 1}) as db:
            for name, table in zip(("tok_a", "tok_b"), tokens, strict=True):
                db.register(name, table.select(["ord", "stop"]))
            ends = db.sql(GROUPS).to_arrow_table()
        stops = [t["stop"].to_numpy() for t in tokens]
        group = [ends["g"].to_numpy(), np.searchsorted(stops[0][ends["cut"].to_numpy()], stops[1])]
        n_units = len(found[0][1])
        listed, n_groups = _listed(tokens, group, n_units)
        sums = np.stack([found[0][1], found[1][1], n_groups, np.bincount(unit, minlength=n_units)], axis=1)
        totals = np.array([sums[u].sum(axis=0) for u in cut], dtype=np.int64).reshape(len(cut), 4)
        starts = np.cumsum([0, *map(len, cut)])
        whole = _joined(listed.take(pa.array(np.concatenate([*cut, np.zeros(0, dtype=np.int32)]))), starts, ";")
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() if len(u) else "" for x, u in zip(whole, cut, strict=True)]
        packed, nothing = [_packed(np.sort(u)) for u in cut], _packed(np.zeros(0, dtype=np.int32))
        texts, size = np.array(self.texts, dtype=int), len(self.texts) + 1
        numbers = np.vstack([totals, np.zeros((1, 4), dtype=np.int64)])[np.r_[texts, -1]]  # -1 is the row of zeros
        only = lambda value, kind: pa.array([None] * (size - 1) + [value], kind)
        lists = {c: only(v, pa.list_(t)) for c, v, t in (("a", (ids >> 32).astype(np.int32), pa.int32()), ("b", (ids & 0xFFFFFFFF).astype(np.int32), pa.int32()), ("n", n, pa.int64()))}
        return pa.RecordBatch.from_pydict({
            "bundle": pa.array([self.name] * size), "doc_id": pa.array([*self.doc_ids, None], pa.int64()),
            **{c: pa.array(numbers[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups_sha256": pa.array([*(digest[t] if t >= 0 else "" for t in self.texts), None], pa.string()),
            "units": pa.array([*(packed[t] if t >= 0 else nothing for t in self.texts), _packed(unit)], pa.binary()),
            "pairs": only(_packed(pair), pa.binary()), **lists,
        })


def bundles(docs: DataFrame, path_a: str, path_b: str, size: int = BUNDLE_BYTES) -> DataFrame:
    """The rows of ``Bundle.rows`` for all documents (``doc_id, text``)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, task, n = _tokenizers(path_a, path_b), TaskContext.get().partitionId(), 0
        bundle = Bundle(both, f"{task}-{n}")
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                bundle.add(doc_id, text.as_py())
                if bundle.bytes >= size or len(bundle.doc_ids) >= size >> 6:
                    yield bundle.rows()
                    n += 1
                    bundle = Bundle(both, f"{task}-{n}")
        if bundle.doc_ids:
            yield bundle.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, documents, best``: in how many documents an id of A overlaps one of B, and whether no other id of B
    overlaps that of A in more. ``rows`` are those of ``bundles``."""
    each = rows.where("a is not null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("documents"))
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))
    return counts.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))


def _sums(documents: pa.Table, totals: pa.Table) -> pa.Table:
    """The rows of a bundle with the totals of its pairs summed over the links of each document."""
    own = documents.filter(pc.is_null(documents["pairs"]))
    (link,) = documents.filter(pc.is_valid(documents["pairs"])).to_pylist()
    unit, pair = _unpacked(link["units"]), _unpacked(link["pairs"])
    each = [_unpacked(x.as_py()) for x in own["units"]]
    at = np.argsort(totals["pair"].to_numpy())
    found = []
    for name in ("best", "documents"):
        value = totals[name].to_numpy()[at].astype(np.int64)
        per_unit = np.zeros(int(max(unit.max(initial=-1), *(u.max(initial=-1) for u in each))) + 1, dtype=np.int64)
        np.add.at(per_unit, unit, value[pair])
        found.append(pa.array([int(per_unit[u].sum()) for u in each], pa.int64()))
    kept = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", found[0]).append_column("count_sum", found[1]).append_column("groups_sha256", own["groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, size: int = BUNDLE_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A (a ``tokenizers`` file) encodes a space and the text, B (a ``sentencepiece`` model) the text. Texts that are
    null or empty, or that tokens don't give back byte by byte, have zeros and an empty digest. Rows count as documents
    each, with equal or null ids too; other columns aren't read; an empty table gives none. ``size`` bounds a bundle's
    text and, divided by 64, its rows, and doesn't change the result. The paths must open on every executor.
    """
    rows = stored(bundles(docs, path_a, path_b, size))
    each = rows.where("a is not null").select("bundle", F.posexplode(F.arrays_zip("a", "b")).alias("pair", "p")).select("bundle", "pair", "p.a", "p.b")
    totals = each.join(pair_counts(rows), ["a", "b"]).select(F.col("bundle").alias("of"), "pair", "documents", "best")
    left = rows.select("bundle", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "pairs")
    return left.groupBy("bundle").cogroup(totals.groupBy("of")).applyInArrow(_sums, RESULT)
