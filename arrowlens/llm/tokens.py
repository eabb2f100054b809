"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

Text is cut by the vocabulary's pattern; the bytes of each piece form a doubly linked list of symbols, and a priority
queue of (merge rank, position) merges the lowest rank first, leftmost first on ties. Entries whose symbols have been
merged away since are stale and skipped. A piece of n bytes takes O(n log n) steps, so that a piece of 100,000
characters without a break is no problem. Ids of frequent pieces are kept in a bounded table of each worker.

Defined results: an empty and a null text both give an empty list; strings that look like special tokens are ordinary
text. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from arrowlens.llm.spread import dealt

#: Folder of the vocabulary files; every worker needs it.
TOKENIZERS = os.environ.get("ARROWLENS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that the public vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a worker remembers, and their greatest length in characters.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # symbol i covers piece[i:end[i]]; 0 marks a symbol that is gone
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            queue.append((r, i, i + 1, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, j, stop = heapq.heappop(queue)
        if end[i] != j or j >= n or end[j] != stop:
            continue  # stale: one of the two symbols has changed since
        end[i], end[j] = stop, 0
        nxt = right[j]
        right[i] = nxt
        if nxt < n:
            left[nxt] = i
            r = ranks.get(piece[i : end[nxt]])
            if r is not None:
                heapq.heappush(queue, (r, i, nxt, end[nxt]))
        before = left[i]
        if before >= 0:
            r = ranks.get(piece[before:stop])
            if r is not None:
                heapq.heappush(queue, (r, before, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = right[i]
    return ids


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self._strings: dict[int, bytes] | None = None

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for piece in self.find(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8", "replace"), ranks)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    @property
    def vocabulary(self) -> dict[int, bytes]:
        if self._strings is None:
            self._strings = {i: b for b, i in self.ranks.items()}
        return self._strings


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    return Encoder(path)


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int>: the ids of each text."""
    at = path or vocabulary_path()

    @F.arrow_udf("array<int>")
    def encode(texts):
        import pyarrow as pa

        from arrowlens.llm.tokens import encoder

        e = encoder(at)
        return pa.array([e.encode(t) for t in texts.to_pylist()], type=pa.list_(pa.int32()))

    return encode(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """bigint: the number of ids of each text; the ids themselves never leave the worker."""
    at = path or vocabulary_path()

    @F.arrow_udf("bigint")
    def count(texts):
        import pyarrow as pa

        from arrowlens.llm.tokens import encoder

        e = encoder(at)
        return pa.array([len(e.encode(t)) for t in texts.to_pylist()], type=pa.int64())

    return count(text)


def token_text(ids: Column, path: str | None = None) -> Column:
    """Text of ids: vocabulary strings laid end to end; a null list gives null, bytes that are no UTF-8 the replacement mark."""
    at = path or vocabulary_path()

    @F.arrow_udf("string")
    def decode(lists):
        import pyarrow as pa

        from arrowlens.llm.tokens import encoder

        v = encoder(at).vocabulary
        return pa.array([None if x is None else b"".join(v[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()], type=pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids)."""
    return dealt(docs.select("doc_id", "text")).select("doc_id", token_ids(F.col("text"), path).alias("ids"))


def document_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens)."""
    return dealt(docs.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), path).alias("tokens"))
