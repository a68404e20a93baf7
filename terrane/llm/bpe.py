"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the transition-function scan of ``pretoken``. A piece
that occurred before comes from a bounded cache; new pieces of one length are merged
side by side: in each round every piece joins its leftmost pair of lowest rank, until
no pair has a rank. Pieces over ``WIDE`` bytes are merged one by one with a heap. Token
offsets are kept, so that decoding can go back to any span of bytes.

Edge cases: null and empty texts have no ids; repeated rows come out once each; an
empty table gives an empty result; a text of any length is one unit of work, and a
task's memory follows its longest text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.hashtable import HashTable
from terrane.llm.pretoken import pieces
from terrane.llm.runtime import small_batches
from terrane.llm.textops import first_bytes, span_hash, text_buffer

WIDE, NO = 64, 1 << 30
#: Pieces and their bytes that a cache holds at most, before it starts anew.
CACHE_PIECES, CACHE_BYTES = 1_000_000, 16_000_000
#: Bytes of text that are cut at once, unless one text has more.
SLAB = 1 << 20


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[at : at + size], end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - (ends - size), size) + np.arange(total)]


class PieceCache:
    """Ids of pieces, looked up by a 64-bit hash, many at a time; subclasses encode new ones.

    A hit must also agree in size and in its first eight bytes."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.table = HashTable()
        self.bytes, self.used = 0, 0
        self.flat, self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.length, self.head = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint64)

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's are and how many."""
        raise NotImplementedError

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, head: np.ndarray) -> None:
        ids, at, size = self.encode_new(data, starts, ends)
        first, n = self.table.count, len(starts)
        while first + n > len(self.at):
            for name in ("at", "size", "length", "head"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        own = slice(first, first + n)
        self.at[own], self.size[own], self.length[own], self.head[own] = self.used + at, size, ends - starts, head
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.bytes += int((ends - starts).sum())
        self.table.add(key)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and how many each has."""
        if self.table.count > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.reset()
        key, head = span_hash(data, starts, ends), first_bytes(data, starts, ends)
        slot = self.table.find(key)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, one = np.unique(key[miss], return_index=True)
            one = miss[one]
            self.learn(data, starts[one], ends[one], key[one], head[one])
            slot[miss] = self.table.find(key[miss])
        clash = (self.length[slot] != ends - starts) | (self.head[slot] != head)
        if clash.any():  # two pieces with one hash: encode these anew, outside the cache
            return self._apart(data, starts, ends, slot, np.flatnonzero(clash))
        size = self.size[slot].astype(np.int64)
        return gather(self.flat, self.at[slot], size), size

    def _apart(self, data, starts, ends, slot, clash) -> tuple[np.ndarray, np.ndarray]:
        ids, at, size = self.encode_new(data, starts[clash], ends[clash])
        flat, where, many = np.r_[self.flat[: self.used], ids], self.at[slot], self.size[slot].astype(np.int64)
        where[clash], many[clash] = self.used + at, size
        return gather(flat, where, many), many


class Bpe(PieceCache):
    """A vocabulary of ranks: token bytes and ids, with its merges and its cache."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = HashTable(len(pairs))
        self.pairs.add(np.fromiter(pairs, np.uint64, len(pairs)))
        self.pair_rank = np.r_[np.fromiter(pairs.values(), np.int64, len(pairs)), NO]  # the last one is for pairs without a rank
        self.first = self.rank_of(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        known = np.flatnonzero(self.token_size)
        self.known = HashTable(len(known))
        self.known.add(span_hash(self.token_flat, self.token_at[known], self.token_at[known] + self.token_size[known]))
        self.known_id = known
        super().__init__()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO for pairs without one."""
        return self.pair_rank[self.pairs.find((a << 32 | b).astype(np.uint64))]

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, length = len(starts), ends - starts
        at, size = np.zeros(n, np.int64), np.ones(n, np.int64)
        whole = self.known.find(span_hash(data, starts, ends))
        hit = np.flatnonzero(whole >= 0)
        hit = hit[self.token_size[self.known_id[whole[hit]]] == length[hit]]
        at[hit] = np.arange(len(hit))
        blocks, used = [self.known_id[whole[hit]]], len(hit)
        rest = np.ones(n, bool)
        rest[hit] = False
        rest = np.flatnonzero(rest)
        for i in rest[length[rest] > WIDE].tolist():
            ids = self.merge_long(data[starts[i] : ends[i]].tobytes())
            at[i], size[i] = used, len(ids)
            blocks.append(ids)
            used += len(ids)
        rest = rest[length[rest] <= WIDE]
        rest = rest[np.argsort(length[rest], kind="stable")]
        for which in np.split(rest, np.flatnonzero(np.diff(length[rest])) + 1) if len(rest) else []:
            for own, ids in self._merge_equal(data[starts[which][:, None] + np.arange(length[which[0]])], which):
                at[own] = used + np.arange(len(own)) * ids.shape[1]
                size[own] = ids.shape[1]
                blocks.append(ids.ravel())
                used += ids.size
        return np.concatenate(blocks).astype(np.int32), at, size

    def _merge_equal(self, raw: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges pieces of one length; yields those that are done with their ids, as many for each."""
        ids, rank = self.byte_id[raw], self.first[raw[:, :-1], raw[:, 1:]]
        while len(ids):
            pos = rank.argmin(1)
            best = rank[np.arange(len(ids)), pos]
            over = best == NO
            if over.any():
                yield which[over], ids[over]
                live = ~over
                ids, rank, pos, best, which = ids[live], rank[live], pos[live], best[live], which[live]
            if not len(ids):
                return
            width = ids.shape[1] - 1
            if width == 1:
                yield which, best[:, None]
                return
            row, col = np.arange(len(ids)), np.arange(width)
            ids = np.where(col > pos[:, None], ids[:, 1:], ids[:, :-1])
            ids[row, pos] = best
            col = col[:-1]
            rank = np.where(col >= pos[:, None], rank[:, 1:], rank[:, :-1])
            left, right = np.flatnonzero(pos > 0), np.flatnonzero(pos < width - 1)
            rank[left, pos[left] - 1] = self.rank_of(ids[left, pos[left] - 1], ids[left, pos[left]])
            rank[right, pos[right]] = self.rank_of(ids[right, pos[right]], ids[right, pos[right] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece by a heap of pairs; stale entries are passed over."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j], after[i] = None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, size + len(part[after[i]])))
            if (k := before[i]) >= 0 and (r := get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (r, k, len(part[k]) + size))
        return np.array([self.ranks[p] for p in part if p is not None], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_flat, self.token_at[ids], self.token_size[ids]).tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts among the decoded bytes."""
        size = self.token_size[ids]
        return np.cumsum(size) - size


def slabs(offs: np.ndarray, most: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most so many bytes, or one text."""
    k, n = 0, len(offs) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(offs, offs[k] + most, side="right")) - 1)
        yield k, j
        k = j


def encode_texts(cache: PieceCache, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the number of each."""
    starts = pieces(data, offs)
    ids, size = cache.encode(data, starts, np.r_[starts[1:], len(data)])
    owner = np.searchsorted(offs, starts, side="right") - 1
    return ids, np.bincount(owner, weights=size, minlength=len(offs) - 1).astype(np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All other columns of docs and either ids, token_offsets and n_tokens or, for digests, hashes."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.col(text).cast("string").alias("_text"))
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, token_offsets array<int>"
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [added])
    names = [*others, *[c.split()[0] for c in added.split(", ")]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            data, offs = text_buffer(batch.column(batch.num_columns - 1))
            for k, j in slabs(offs):
                ids, n = encode_texts(bpe, data[offs[k] : offs[j]], offs[k : j + 1] - offs[k])
                ends = np.cumsum(n)
                own = batch.slice(k, j - k)
                if digests:
                    u = ids.astype("<u4")
                    back = bpe.decode(ids)
                    to = np.r_[0, np.cumsum(bpe.token_size[ids])][ends].tolist()
                    of = lambda b, cut: [hashlib.sha256(b[s:e]).hexdigest() for s, e in zip([0, *cut[:-1]], cut)]
                    more = [pa.array(of(u.tobytes(), (ends * 4).tolist()), pa.string()), pa.array(of(back, to), pa.string())]
                else:
                    at = bpe.offsets(ids)
                    at -= np.repeat(np.r_[0, at][np.minimum(ends - n, len(at))] if not len(at) else at[np.minimum(ends - n, len(at) - 1)], n)
                    lists = pa.array(np.r_[0, ends].astype(np.int32), pa.int32())
                    more = [pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(at.astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(n, pa.int64()), *more], names=names)

    return rows.mapInArrow(kernel, schema)


def op2(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs.select("doc_id", "text"), path, digests=True)
