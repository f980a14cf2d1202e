"""Encoding of whole texts with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens inside the JVM and travel to Python as Arrow lists; each batch is dictionary-encoded, so
that Python looks at every different pre-token once. Tier one is a minimal perfect hash over the vocabulary, probed
for all of them at once with array operations; it resolves whole pre-tokens that are tokens. Tier two encodes the
misses with a heap of merges over a linked list of bytes; they are first cut where two bytes meet that no token has
side by side, which no merge can span, and the parts are remembered. Ids are put back together with array operations.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the vocabulary that splits text before its merges; \s is Unicode white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
MEMO = 400_000  # parts of misses that a worker remembers; beyond, it forgets all and starts anew


class PerfectHash:
    """Minimal perfect hash of byte strings: hash and displace. slot = mix(h, d[bucket]) mod n; a stored 64-bit print tells strangers."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h = self.hashes(keys)
        bucket = self._bucket(h)
        size = np.bincount(bucket, minlength=self.buckets)
        self.d = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key = np.full(n, -1, dtype=np.int64)
        # larger buckets first; all buckets of a size try one displacement after the other together
        for k in range(int(size.max(initial=0)), 1, -1):
            key = np.nonzero(size[bucket] == k)[0]
            key = key[np.argsort(bucket[key], kind="stable")].reshape(-1, k)
            d = 0
            while len(key):
                at = self._slot(h[key], d)
                ordered = np.sort(at, axis=1)
                fits = (self.slot_key[at] < 0).all(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
                owner = np.full(n, -1, dtype=np.int64)
                rows = np.nonzero(fits)[0]
                owner[at[rows[::-1]]] = rows[::-1, None]  # the first bucket to want a slot gets it
                won = rows[(owner[at[rows]] == rows[:, None]).all(1)]
                self.slot_key[at[won]] = key[won]
                self.d[bucket[key[won, 0]]] = d
                key, d = np.delete(key, won, axis=0), d + 1
        single = np.nonzero(size[bucket] == 1)[0]  # the slots left are given directly
        left = np.nonzero(self.slot_key < 0)[0]
        self.d[bucket[single]] = -left - 1
        self.slot_key[left] = single
        self.prints = h[self.slot_key] if n else np.array([], dtype=np.uint64)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        x = (h ^ (np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key among the keys hashed, or -1 for a stranger."""
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        h = self.hashes(keys)
        d = self.d[self._bucket(h)]
        slot = np.where(d < 0, -d - 1, self._slot(h, np.maximum(d, 0)))
        return np.where(self.prints[slot] == h, self.slot_key[slot], -1)


class Vocabulary:
    def __init__(self, path: str) -> None:
        pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        ids = np.array([int(b) for _, b in pairs], dtype=np.int64)
        self.whole = PerfectHash(self.tokens)
        self.ids = ids
        self.rank = dict(zip(self.tokens, ids.tolist(), strict=True))
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        # merges: two tokens side by side that together are a token; found over all cuts of each token
        rank, self.merge = self.rank, {}
        for token, new in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    self.merge[a << 20 | b] = new
        # two bytes that stand side by side inside no token: no merge ever spans them
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.tokens:
            t = np.frombuffer(token, dtype=np.uint8)
            inside[t[:-1], t[1:]] = True
        self.inside = inside
        self.memo: dict[bytes, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merges of one pre-token in order of rank, the leftmost first, by a heap over linked bytes."""
        byte, merge = self.byte, self.merge
        ids: list[int] = [byte[b] for b in piece]
        n = len(ids)
        heap = []
        get = merge.get
        for i in range(n - 1):
            new = get(ids[i] << 20 | ids[i + 1])
            if new is not None:
                heap.append(new << 32 | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, new = top & 0xFFFFFFFF, top >> 32
            left = ids[i]
            if left < 0:
                continue
            j = after[i]
            if j >= n or get(left << 20 | ids[j]) != new:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = get(new << 20 | ids[k])
                if got is not None:
                    push(heap, got << 32 | i)
            h = before[i]
            if h >= 0:
                got = get(ids[h] << 20 | new)
                if got is not None:
                    push(heap, got << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in one array, number of ids of each)."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found = self.whole.find(raw)
        missed = np.nonzero(found < 0)[0].tolist()
        counts = np.ones(len(pieces), dtype=np.int64)
        memo, encoded = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        stream = np.frombuffer(b"".join([raw[i] for i in missed]), dtype=np.uint8)
        cuts = (np.nonzero(~self.inside[stream[:-1], stream[1:]])[0] + 1).tolist()
        cuts.append(len(stream) + 1)
        at, k = 0, 0
        for i in missed:
            piece, ids, begin = raw[i], [], 0
            end = at + len(piece)
            while cuts[k] <= at:
                k += 1
            while True:
                stop = min(cuts[k], end) - at
                part = piece[begin:stop]
                got = memo.get(part)
                if got is None:
                    got = memo[part] = self.encode_piece(part)
                ids += got
                begin = stop
                if cuts[k] >= end:
                    break
                k += 1
            at = end
            counts[i] = len(ids)
            encoded.append(ids)
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(starts[-1], dtype=np.int32)
        hit = found >= 0
        flat[starts[:-1][hit]] = self.ids[found[hit]]
        for i, ids in zip(missed, encoded, strict=True):
            flat[starts[i] : starts[i + 1]] = ids
        return flat, counts


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Built on the driver and broadcast; its size is that of the vocabulary file, whatever the texts."""
    return Vocabulary(path)


def _spread(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions in the flat ids of the pieces ``codes``, one after the other."""
    n = counts[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def encode(documents: DataFrame, id_col: str, text_col: str, *, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>): the token ids of each text, without special tokens; what looks like one is plain text.

    A null text has ids null, an empty text an empty list. Every row gives one row, repeated rows too; whole texts are
    encoded, however long. Other columns are ignored.
    """
    return _encoded(documents, id_col, text_col, vocabulary_path, "ids")


def count_tokens(documents: DataFrame, key: str | Column, text_col: str, *, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens bigint): the number of ids ``encode`` gives; 0 for null and empty texts. ``key`` may be a struct of columns to keep."""
    keyed = documents.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.col(text_col).alias("text"))
    out = _encoded(keyed, "key", "text", vocabulary_path, "n_tokens")
    return out.withColumnRenamed("key", key) if isinstance(key, str) else out


def _encoded(documents: DataFrame, id_col: str, text_col: str, vocabulary_path: str, want: str) -> DataFrame:
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(PRE_TOKENS), F.lit(0))
    rows = documents.select(F.col(id_col).alias("id"), pieces.alias("pieces"))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, counts = v.encode_all(flat.dictionary.to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts[codes])])
            offsets = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)]
            if want == "n_tokens":
                out = pa.array(np.diff(offsets), pa.int64())
            else:
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[_spread(codes, starts, counts)], pa.int32()), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", want])

    return rows.mapInArrow(run, f"id {id_type}, {want} {'bigint' if want == 'n_tokens' else 'array<int>'}").withColumnRenamed("id", id_col)
