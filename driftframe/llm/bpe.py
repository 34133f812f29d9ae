"""Byte-level BPE by prefix dynamic programming.

A byte string has at most one BPE encoding, and every prefix of it has one too. The last token of the
encoding of ``s[:i]`` is therefore a function of ``i``; storing that token for each prefix is enough to
read the encoding of any prefix off backwards. The table for ``s + t`` starts with the table for ``s``,
so appending is exact, and an edit only re-derives the prefixes from the edit up to the place where the
old table holds again.

A token ``t`` ending at ``i`` is the right one when the prefix before it is encodable and its last token
``p`` and ``t`` stay apart under the merges, that is when BPE encodes ``bytes(p) + bytes(t)`` as ``[p, t]``.
Pairwise stability of neighbours is equivalent to the whole sequence being the BPE encoding.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cached encodings of pieces a worker keeps; at the bound the cache starts afresh.
CACHE_PIECES = 400_000
#: Only pieces up to so many bytes are cached.
CACHE_BYTES = 64


class PrefixBPE:
    """Encoder for single pieces (no pre-splitting) over a rank table ``bytes -> id``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        by_tail: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 1:
                by_tail.setdefault(b[-2:], set()).add(len(b))
        #: Lengths that tokens with these last two bytes can have, longest first.
        self._lengths = {k: tuple(sorted(v, reverse=True)) for k, v in by_tail.items()}
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the lowest-ranked neighbours until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        key = (left, right)
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 500_000:
                self._apart.clear()
            got = self._apart[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return got

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Grow ``last`` (the last token of each non-empty prefix of ``data``) up to prefix ``stop``."""
        ranks, lengths, apart = self.ranks, self._lengths, self.apart
        for i in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            found = -1
            for n in lengths.get(data[i - 2 : i], ()) if i > 1 else ():
                if n <= i and (t := ranks.get(data[i - n : i])) is not None and (n == i or apart(last[i - n - 1], t)):
                    found = t
                    break
            if found < 0:
                found = ranks[data[i - 1 : i]]
            last.append(found)
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The tokens of prefix ``end``, followed backwards through the table."""
        out, i = [], len(last) if end is None else end
        while i > 0:
            t = last[i - 1]
            out.append(t)
            i -= len(self.tokens[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, []))


class PrefixTable:
    """A piece with the last token of each of its prefixes: appends are exact, edits re-derive locally."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, bpe.extend(data, [])
        #: Prefixes derived by the latest change.
        self.derived = len(data)

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        self.bpe.extend(self.data, self.last)
        self.derived = len(more)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace ``data[start:end]``. The old table is taken up again once as many prefixes in a row as
        the longest token has bytes have the last tokens they had before."""
        old, shift, after = self.last, len(new) - (end - start), start + len(new)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0
        for i in range(start + 1, len(self.data) + 1):
            self.bpe.extend(self.data, self.last, i)
            same = same + 1 if i > after and self.last[-1] == old[i - 1 - shift] else 0
            if same >= self.bpe.longest:
                self.derived = i - start
                self.last += old[i - shift :]
                return self
        self.derived = len(self.data) - start
        return self

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.read(self.last)


class _Pieces(dict):
    """piece (str) -> its ids as little-endian 32-bit bytes, filled on demand and bounded."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        ids = array("I", self.bpe.encode(raw))
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


class TextCodec:
    """Splits text by a pattern and encodes each match; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = PrefixBPE(ranks)
        self._split = regex.compile(pattern)
        self._pieces = _Pieces(self.bpe)

    def split(self, text: str, start: int = 0) -> Iterator[str]:
        return (m.group() for m in self._split.finditer(text, start))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self._split.findall(text)))

    def encode(self, text: str) -> list[int]:
        ids = array("I", self.encode_bytes(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one ``base64 id`` a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> TextCodec:
    """One codec for each worker process."""
    return TextCodec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array<int>) added, or replaced where the name clashes.

    A null or empty text has an empty array. ``path`` is a rank file each executor can open.
    """
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != ids), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in parts:
            raw = [c.encode_bytes(x.as_py() or "") for x in part.column(part.num_columns - 1)]
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], ids])

    return own.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` with the text that ``ids`` stand for. Null ids give null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in parts:
            yield pd.Series([None if x is None else c.decode(list(x)) for x in s], dtype=object)

    return docs.withColumn(text, run(F.col(ids)))


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, decoded, and both hashed.

    The ids of a text never leave the worker, so a row costs its digests only. A null text counts as
    empty; rows with equal or null doc_id each have their own row; other columns are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in parts:
            n, ids, back = [], [], []
            for value in part.column(1):
                raw = c.encode_bytes(value.as_py() or "")
                numbers = array("I", raw)
                if sys.byteorder == "big":
                    numbers.byteswap()
                n.append(len(numbers))
                ids.append(sha(raw))
                back.append(sha(c.decode_bytes(numbers)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
