import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arrowlens.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.vocabulary_path()), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_equals_the_public_library_and_comes_back(public, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    e = tokens.encoder(tokens.vocabulary_path())
    ids = e.encode(text)
    assert ids == public.encode_ordinary(text)
    assert b"".join(e.vocabulary[i] for i in ids).decode() == text


def test_long_pieces_and_special_strings(public):
    e = tokens.encoder(tokens.vocabulary_path())
    rng = random.Random(2)
    for text in ("a" * 30_000, "".join(rng.choice("abc") for _ in range(60_000)), " " * 20_000, "<|endoftext|> x <|startoftext|>", "\r\n\t  é́ 漢字"):
        assert e.encode(text) == public.encode_ordinary(text)


def test_merging_equals_repeated_scanning():
    ranks = tokens.read_ranks(tokens.vocabulary_path())

    def slow(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)), default=(10**9, 0))
            if best[0] == 10**9:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert tokens.merge_piece(piece, ranks) == slow(piece)


def test_columns_with_null_and_empty(spark, public):
    rows = [(1, None), (2, ""), (3, "  "), (4, "Hello <|endoftext|> world"), (4, "Hello <|endoftext|> world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode_documents(df)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, public.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.tokens) for r in tokens.document_sizes(df).collect()) == sorted((i, len(public.encode_ordinary(t or ""))) for i, t in rows)
    back = got.select("doc_id", tokens.token_text(F.col("ids")).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in rows}
    assert tokens.encode_documents(df.limit(0)).collect() == []
