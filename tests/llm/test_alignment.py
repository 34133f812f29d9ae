"""Token alignment against a plain version on whole texts, without units, bundles or DuckDB."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftframe.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}

    def tokens(text):
        """(ids, ends) of both sides, or None."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in x]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for r in raw:
                at += len(r)
                out.append(at)
            ends.append(out)
        return (x, ends[0]), (y, ends[1])

    def links(x, ends_x, y, ends_y):
        out, j = [], 0
        for i, end in enumerate(ends_x):
            start = ends_x[i - 1] if i else 0
            while ends_y[j] <= start:
                j += 1
            k = j
            while k < len(y) and (ends_y[k - 1] if k else 0) < end:
                out.append((x[i], y[k]))
                k += 1
        return out

    def run(rows):
        found, held = [], Counter()
        for _, text in rows:
            t = tokens(text)
            if t is None:
                found.append(None)
                continue
            (x, ex), (y, ey) = t
            pairs = links(x, ex, y, ey)
            held.update(set(pairs))
            common, groups, i, j = sorted(set(ex) & set(ey)), [], 0, 0
            for c in common:
                ga, gb = [], []
                while i < len(x) and ex[i] <= c:
                    ga.append(str(x[i]))
                    i += 1
                while j < len(y) and ey[j] <= c:
                    gb.append(str(y[j]))
                    j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
            found.append((len(x), len(y), groups, pairs))
        top = Counter()
        for (i, _), n in held.items():
            top[i] = max(top[i], n)
        out = []
        for (doc_id, _), f in zip(rows, found, strict=True):
            if f is None:
                out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            else:
                n_a, n_b, groups, pairs = f
                best, total = sum(held[p] == top[p[0]] for p in pairs), sum(held[p] for p in pairs)
                out.append((doc_id, n_a, n_b, len(groups), len(pairs), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return out

    return run


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_query_against_the_plain_version(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(queries.op11_token_alignment(spark, "/root/testdata/sf0.001")) == sorted(plain(docs), key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a  b", "a \n b", "a b c", "　x y", "x▁y z", "<|endoftext|> it's <s> </s>", "naïve café 日本語 テキスト 😀 x",
    "é a ﬁ ① Å b", "1 2 3.4 _x_ _ y", "tab\t t\r\n w", "\x00 \x1c b \x1f c", "don't 'S we'll  'll", "a" * 3000, "word " * 5000, " " * 500 + "x", "the cat", "the cat", "über İ ǅ ẞ x",
]


def test_odd_texts_ties_and_repeated_rows(spark, plain):
    rows = [*enumerate(ODD), (None, "the cat sat"), (None, "the cat sat"), (5, "the dog")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bundle string, n_a long")
    want = sorted(plain(rows), key=repr)
    assert rows_of(token_alignment.align(docs, A, B)) == want
    assert rows_of(token_alignment.align(docs, A, B, size=64)) == want  # other bundles, the same result


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(docs, A, B).collect() == []


def test_pieces_hold_a_space_at_their_beginning_only():
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    assert not [p for p in map(b.id_to_piece, range(b.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_overlaps_and_documents_of_pairs_without_a_database():
    """Links and counts come from sorted ends; DuckDB's joins for them took 100 MB of a worker."""
    table = lambda unit, ids, stop: pa.table({"unit": np.array(unit, np.int32), "ord": np.arange(len(ids), dtype=np.int32), "id": np.array(ids, np.int32), "start": np.array([0, *stop][: len(stop)], np.int32), "stop": np.array(stop, np.int32)})
    a, b = table([0, 0, 2], [7, 8, 7], [3, 4, 9]), table([0, 0, 2, 2], [1, 2, 1, 1], [2, 4, 5, 9])
    unit, ids = token_alignment._overlaps(a, b)
    assert unit.tolist() == [0, 0, 0, 2, 2]
    assert [(i >> 32, i & 0xFFFFFFFF) for i in ids.tolist()] == [(7, 1), (7, 2), (8, 2), (7, 1), (7, 1)]
    none = table([], [], [])
    assert [len(x) for x in token_alignment._overlaps(none, none)] == [0, 0]
    documents = [np.array([0, 2]), np.array([2]), np.array([], dtype=int)]
    n = token_alignment._held(documents, np.array([1, 3, 5]), np.array([0, 0, 0, 2]), np.array([0, 1, 2, 0]), 3, 3)
    assert n.tolist() == [4, 1, 1]
