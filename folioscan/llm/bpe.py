"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is an entry as a whole; any other is
merged from its bytes, which form a linked list while a heap gives the pair of lowest rank, leftmost first. A worker
remembers the pre-tokens it has met, as many as MEMO.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan.llm.common import table, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Remembered pre-tokens (and pairs) of a worker, and the longest one.
MEMO, MEMO_CHARS = 300_000, 48
KEYS_A_BUCKET = 4


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: as many slots as keys.

    A key's bucket holds a displacement d that sends the bucket's keys to free slots, (a + d b) modulo n; a bucket of one
    key holds -slot - 1 instead. `ids` has the key's number at its slot."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // KEYS_A_BUCKET)
        held: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            bucket, a, b = self._hash(key)
            held[bucket].append((a, b, i))
        self.shift, self.ids, free = [0] * self.buckets, [-1] * self.n, [True] * self.n
        alone = []
        for bucket in sorted(range(self.buckets), key=lambda x: -len(held[x])):
            members = held[bucket]
            if len(members) < 2:
                alone += [bucket] * len(members)
                continue
            for d in itertools.count(1):
                slots = [(a + d * b) % self.n for a, b, _ in members]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
            self.shift[bucket] = d
            for s, (_, _, i) in zip(slots, members, strict=True):
                free[s], self.ids[s] = False, i
        rest = (s for s in range(self.n) if free[s])
        for bucket, s in zip(alone, rest, strict=True):
            self.shift[bucket], self.ids[s] = -s - 1, held[bucket][0][2]

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFF, (h >> 64 & 0xFFFFFFFF) | 1

    def __getitem__(self, key: bytes) -> int:
        """The number of the only key that this one can be."""
        bucket, a, b = self._hash(key)
        d = self.shift[bucket]
        return self.ids[-d - 1 if d < 0 else (a + d * b) % self.n]


class _Memo(dict):
    """What a function gave, for short keys. When it is half full, what hasn't been asked for since the last time goes."""

    def __init__(self, of):
        super().__init__()
        self.of, self.older = of, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= MEMO_CHARS:
            self[key] = found
        return found

    def age(self) -> None:
        if 2 * len(self) > MEMO:
            self.older = dict(self)
            self.clear()


class Bpe:
    """Encoder and decoder. It is built on the driver and sent to the workers once; its size is the vocabulary's."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.hash = tokens, pattern, PerfectHash(tokens)

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError(f"the ranks in {path} are not 0, 1, 2, ...")
        return cls(tokens, pattern)

    @cached_property
    def _cut(self):
        # \s of this library also takes \x1c to \x1f, which are not white space to Unicode
        white = r"\t-\r \x85\xa0  -     　"
        return regex.compile(self.pattern.replace(r"[^\s", f"[^{white}").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")).findall

    @cached_property
    def _ids(self) -> _Memo:
        """Ids of pre-tokens, as bytes of int32."""
        encode = self.encode_piece
        return _Memo(lambda piece: array("i", encode(piece.encode())).tobytes())

    @cached_property
    def _ranks(self) -> _Memo:
        """Ranks of byte strings, -1 for none; a memo over the perfect hash."""
        tokens, hashed = self.tokens, self.hash

        def rank(key: bytes) -> int:
            i = hashed[key]
            return i if tokens[i] == key else -1

        return _Memo(rank)

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash}

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self._ranks[piece]
        if whole >= 0:
            return [whole]
        ranks, n = self._ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks[piece[i : i + 2]]) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop or end[i] != j:
                continue  # one of the two has been merged since
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks[piece[i : end[after[i]]]]) >= 0:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks[piece[before[i] : stop]]) >= 0:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as bytes of int32."""
        memo = self._ids
        out = b"".join(map(memo.__getitem__, self._cut(text)))
        memo.age()
        self._ranks.age()
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @cached_property
    def _token_array(self) -> pa.Array:
        return pa.array(self.tokens, pa.large_binary())

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each list of ids; list i is ids[ends[i]:ends[i + 1]]. Tokens are looked up at once and lie one after the other."""
        found = self._token_array.take(pa.array(ids))
        at = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].tobytes()), found.buffers()[2]])
        return whole.cast(pa.binary())


def encode(docs: DataFrame, bpe: Bpe, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with a column of token ids. Null counts as empty, and an empty text has no tokens. Rows that repeat are each
    encoded; all rows and other columns stay, but for one of the name out_col. An empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)  # bounded by the vocabulary

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: np.frombuffer(sent.value.encode_bytes(x or ""), dtype=np.int32))

    return docs.withColumn(out_col, run(F.col(text_col)))


def decode(rows: DataFrame, bpe: Bpe, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids stand for; null ids give no bytes. Rows that repeat are each decoded; all rows and
    other columns stay, but for one of the name out_col. An empty table stays empty."""
    sent = rows.sparkSession.sparkContext.broadcast(bpe)

    @F.pandas_udf("binary")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in lists:
            yield ids.map(lambda x: b"" if x is None else sent.value.decode(x.tolist()))

    return rows.withColumn(out_col, run(F.col(ids_col)))


def encode_batches(docs: DataFrame, bpe: Bpe, id_col: str, text_col: str) -> DataFrame:
    """id, token_ids array<int>, decoded binary: encoding and decoding in one pass, by Arrow batches.

    Null counts as empty, and an empty text has no tokens. Rows that repeat, or share an id, are each encoded. Other
    columns are left out; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)  # bounded by the vocabulary
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        for batch in batches:
            start = 0
            for texts in texts_of(batch.column(1)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                ids = [bpe.encode_bytes(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), flat), bpe.decode_lists(flat, ends)], names=[id_col, "token_ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def default_bpe(path: str | None = None, pattern: str | None = None) -> Bpe:
    import public_tokenizers

    return Bpe.load(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of every document."""
    out = encode_batches(table(spark, sf_dir, "documents"), default_bpe(), "doc_id", "text")
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
