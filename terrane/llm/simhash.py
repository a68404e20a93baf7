"""SimHash near-duplicate detection by deletion-variant signatures.

A fingerprint has 64 bits; two link at ``MAX_BITS`` = 4 or fewer differing bits.
Cut into three segments (21, 21 and 22 bits), at least one segment of a linked
pair differs in at most one bit, for 2 + 2 + 2 > 4. Each segment is therefore
indexed under its one-wildcard variants: for every bit of it a key with that bit
deleted, 64 keys a fingerprint. Equal segments share all their keys, segments one
bit apart share exactly one, so an equality join on keys meets every candidate. The join
deals fingerprints by key, sorts, verifies the whole distance of those that meet under
their first common key, and returns the links of a spanning forest of each key: never
all pairs of a group. A key that many fingerprints share is split again, exactly, by
pieces of their other bits, so that one key is never one task's work.

Equal fingerprints collapse to one row before the join, so copies never multiply.

Edge cases: null and wordless texts have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle of all their words; repeated
rows come out once each; an empty table gives an empty result; null doc_ids come
out as rows but are never a component's id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.components import connected
from terrane.llm.runtime import small_batches, written
from terrane.llm.textops import joined_words, lower_ascii, mix64, text_buffer, word_spans

WIDTH, SEED, MAX_BITS = 4, 42, 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Shingles whose bits are counted at once.
CHUNK = 100_000
#: Rows of keys that are compared at once, unless one key has more.
HELD = 100_000
#: A key with more fingerprints is split by PIECES sub-keys.
HOT, PIECES = 4096, MAX_BITS + 1


def fingerprints(column: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprints of the texts of an Arrow column, as unsigned 64-bit integers."""
    data, offs = text_buffer(column)
    data, n = lower_ascii(data), len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    text, at, to = joined_words(data, starts, ends)
    words = np.bincount(doc, minlength=n)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(n), shingles)
    head = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + (np.cumsum(words) - words)[owner]
    last = head + np.minimum(width, words[owner]) - 1
    total = np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(owner), CHUNK):
        cut = slice(k, k + CHUNK)
        h = np.array([digest(text[s:e], seed) for s, e in zip(at[head[cut]].tolist(), to[last[cut]].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[cut]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long; a kept column may not be named so."""
    if taken := {"fp", "_text", "_least", "component_id", "label"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} clash with those of the result: rename them or don't keep them")
    small_batches(docs.sparkSession)
    out = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes[:-1]) + ", fp long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprints(b.column(b.num_columns - 1)).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])

    return out.mapInArrow(kernel, schema)


def wildcard_keys() -> Column:
    """The 64 keys of column fp: the deleted bit's place in the high half, the rest of its segment below."""
    keys = []
    for lo, size in SEGMENTS:
        part = f"(shiftrightunsigned(fp, {lo}) & {(1 << size) - 1}L)"
        keys += [f"({lo + b}L << 32) | ({part} & {((1 << size) - 1) & ~(1 << b)}L)" for b in range(size)]
    return F.expr(f"array({', '.join(keys)})")


def first_common_bit(x: np.ndarray) -> np.ndarray:
    """Of fingerprints with difference x: the deleted bit of the first key that they share, -1 for none."""
    out = np.full(len(x), -1, np.int64)
    for lo, size in reversed(SEGMENTS):
        part = (x >> np.uint64(lo)) & np.uint64((1 << size) - 1)
        ones = np.bitwise_count(part)
        at = np.bitwise_count(np.maximum(part, 1) - np.uint64(1))  # the lowest bit's place, where one bit is set
        out = np.where(ones == 0, lo, np.where(ones == 1, lo + at, out))
    return out


def local_forest(key: np.ndarray, fp: np.ndarray, first_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: (fingerprint, least fingerprint of its component within the key), linked ones only.

    first_only: a pair counts under its first common key alone. Rows of one key meet at growing
    distance, all keys at once, so no list of pairs outlives a step."""
    n = len(key)
    label = np.arange(n)
    bit = key >> 32
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    left = np.repeat(np.r_[run[1:], n], np.diff(np.r_[run, n])) - np.arange(n)  # rows of the key from here on
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merge() -> None:
        a, b = (np.concatenate(c) for c in zip(*pairs))
        while True:  # least labels over the links, then over labels of labels
            before = label.copy()
            least = np.minimum(label[a], label[b])
            for side in (a, b, before[a], before[b]):
                np.minimum.at(label, side, least)
            label[:] = label[label]
            if (label == before).all():
                return

    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        x = fp[at] ^ fp[at + step]
        near = np.flatnonzero(np.bitwise_count(x) <= MAX_BITS)
        if first_only:
            near = near[first_common_bit(x[near]) == bit[at[near]]]
        if len(near):
            pairs.append((at[near], at[near] + step))
            held += len(near)
            if held > 4 * n + 1_000_000:
                merge()
                linked = np.flatnonzero(label != np.arange(n))
                pairs, held = [(linked, label[linked])], len(linked)
        step += 1
        at = at[left[at] > step]
    if pairs:
        merge()
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def sub_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PIECES keys for every fingerprint of a crowded key, and the fingerprints beside them.

    Fingerprints of one key agree in a segment but for a bit at most, so what tells them apart lies in the other
    two: cut into PIECES = MAX_BITS + 1, two within MAX_BITS of each other agree in a piece. Keys that fall
    together by chance cost comparisons and nothing else."""
    keys = []
    own = np.searchsorted([lo + size for lo, size in SEGMENTS], key >> 32, side="right")
    for lo, size in SEGMENTS:  # the others' bits side by side
        mine = np.flatnonzero(own == SEGMENTS.index((lo, size)))
        x = fp[mine]
        rest = (x & np.uint64((1 << lo) - 1)) | ((x >> np.uint64(lo + size)) << np.uint64(lo))
        edges = np.linspace(0, 64 - size, PIECES + 1).astype(int).tolist()
        for k, (s, e) in enumerate(zip(edges, edges[1:])):
            piece = (rest >> np.uint64(s)) & np.uint64((1 << (e - s)) - 1)
            keys.append((mine, mix64(key[mine].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(piece + np.uint64(k << 32)))))
    at = np.concatenate([m for m, _ in keys])
    return np.concatenate([k for _, k in keys]).view(np.int64), fp[at]


MET = "a long, b long, sub long"


def _met(a: np.ndarray, b: np.ndarray | None = None, sub: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if sub is None else pa.array(sub)], names=["a", "b", "sub"])


def _meeting(keys: DataFrame, crowded: bool) -> DataFrame:
    """MET for rows (fp, key) in the order of their keys: links a, b; with crowded also rows
    a, sub of keys with more than HOT fingerprints, which are not compared here."""

    def work(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if crowded and len(key):
            run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[run, len(key)])
            hot = np.repeat(size > HOT, size)
            if hot.any():
                yield from deferred(key[hot], fp[hot])
                key, fp = key[~hot], fp[~hot]
        yield _met(*local_forest(key, fp, crowded))

    def deferred(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(key), HELD):
            sub, own = sub_keys(key[k : k + HELD], fp[k : k + HELD])
            yield _met(own, None, sub)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key = np.r_[key, batch.column(1).to_numpy()]
            fp = np.r_[fp, batch.column(0).to_numpy().view(np.uint64)]
            if crowded and hot is not None:  # the rest of a key that was too large to hold
                n = int(np.searchsorted(key, hot, side="right"))
                yield from deferred(key[:n], fp[:n])
                hot = hot if n == len(key) else None
                key, fp = key[n:], fp[n:]
            if len(key) < HELD:
                continue
            if key[0] == key[-1]:
                if crowded:
                    hot = int(key[0])
                    yield from deferred(key, fp)
                    key, fp = key[:0], fp[:0]
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield from work(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
        yield from work(key, fp)

    return keys.mapInArrow(kernel, MET)


def links(fps: DataFrame) -> DataFrame:
    """Links a, b that join the same components as all pairs of fingerprints at MAX_BITS or fewer differing bits.

    fps: distinct fingerprints, column fp. A key with k fingerprints gives k - 1 links at most. A key with more than
    HOT of them is dealt anew by sub-keys, over many tasks; of a sub-key the fingerprints are held in one, 8 bytes each."""
    keys = fps.select("fp", F.explode(wildcard_keys()).alias("key")).repartition("key").sortWithinPartitions("key")
    met = written(_meeting(keys, True), "met")
    again = met.where("sub IS NOT NULL").select(F.col("a").alias("fp"), F.col("sub").alias("key")).repartition("key").sortWithinPartitions("key")
    return met.where("sub IS NULL").select("a", "b").union(_meeting(again, False).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: the id, kept columns, ``fp``, ``component_id``, the smallest id reachable, and the component's ``label``."""
    fps = written(with_fingerprints(docs, text, tuple(dict.fromkeys((id_col, *keep)))), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    labels = connected(links(distinct.select("fp")))
    named = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    named = written(named.select("fp", "label").join(least, "label").select("fp", "component_id", "label"), "components")
    return fps.join(named, "fp")


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
