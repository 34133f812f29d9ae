import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from driftframe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return bpe.TextCodec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_encode_as_themselves(both):
    c, _ = both
    for b, i in list(c.bpe.ranks.items())[::37]:
        assert c.bpe.merge(b) == [i] == c.bpe.encode(b)


def test_equals_the_library_and_edits_are_exact(both):
    c, library = both
    rnd = random.Random(1)
    parts = ["a", "e", "th", "  ", " ", "\n", "1", "é", "😀", "'s", "the", "ing", " un", "\x00", "<|endoftext|>"]
    for _ in range(1500):
        s = "".join(rnd.choice([*parts, "x" * rnd.randint(1, 9)]) for _ in range(rnd.randint(0, 60)))
        ids = c.encode(s)
        assert ids == library.encode_ordinary(s) and c.decode(ids) == s
        raw = s.encode()
        i = rnd.randint(0, len(raw))
        j, new = rnd.randint(i, len(raw)), rnd.choice([b"", b"zz", b"the"])
        want = c.bpe.merge(raw[:i] + new + raw[j:])
        assert bpe.PrefixTable(c.bpe, raw).replace(i, j, new).ids() == want
        assert bpe.PrefixTable(c.bpe, raw[:i]).append(raw[i:]).ids() == c.bpe.merge(raw)


def test_edits_are_local(both):
    c, _ = both
    t = bpe.PrefixTable(c.bpe, b"the quick brown fox " * 500)
    t.replace(5000, 5001, b"!")
    assert t.derived < 300 and t.ids() == bpe.PrefixTable(c.bpe, t.data).ids()


def test_long_pieces(both):
    c, library = both
    for s in ("a" * 20000, " " * 20000, "ab" * 8000):
        assert c.encode(s) == library.encode_ordinary(s)


def test_query_against_the_library(spark, both):
    _, library = both
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_columns_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "the the", "z")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((r["text"] or "", list(r["ids"]), r["decoded"]) for r in out.collect()) == [("", [], ""), ("", [], ""), ("the the", [1169, 262], "the the")]
    assert bpe.encode(d.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.digests(d, PATH, public_tokenizers.PATTERN).count() == 3
