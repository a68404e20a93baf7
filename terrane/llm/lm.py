"""Language-model scores by a weighted backoff automaton.

Model. N-grams of words up to order three over all training texts, in lower case; a text
starts in a state of its own and closes with one end token. With c counts and h' the
context h without its first word:

    P(w) = (c(w) - D) / N, for an unknown word D V / N           (absolute discounting)
    P(w | h) = L(h) c(h, w) / c(h) + (1 - L(h)) P(w | h')
    1 - L(h) = (1 + K) / (c(h) + K), at most 1

A context seen once says nothing of what follows it twice, so its L is 0. K is solved for
each order so that the mass that backs off, the sum of c(h) (1 - L(h)), equals the number
of n-grams seen once (Good-Turing). The distribution sums to one over the vocabulary and
the unknown word. No n-gram is left out: every word, pair and triple seen in training is
in the model, which grows with the input.

Automaton. States are the empty context and every word and pair seen in training. A seen
n-gram is an arc from its context, with log10 P; without one the failure arc leads to the
next shorter context at log10(1 - L). One walk from left to right carries the state and
adds up the logarithms. After two tokens the state depends on these alone, so long texts
are cut into pieces of ``STEPS`` tokens that enter in the state of the two tokens before,
and all pieces of a chunk walk in step.

Distribution. Counts never meet in one place. Texts are packed in chunks of about ``unit``
bytes, each a file in the shared folder: sorted hashes of its distinct words, and the texts
as numbers into them. A chunk asks for the counts of its distinct n-grams: it adds up its
own, cuts the sorted hashes by range, and the task of that range adds up all chunks'
and answers in the same order. So a frequent n-gram costs one entry a chunk, not one an
occurrence, and no task depends on it. The answered chunk builds the part of the automaton
that its texts can reach, and walks. Only histograms of counts and names
of files reach the driver.

A task takes several chunks or ranges, one after the other, and Python writes the answers:
for each file that Spark writes, Hadoop's local file system starts some processes (chmod),
and each of these holds as much memory as the executor, shared with it, until its own
program runs.

There are (bytes / unit)^2 slices; unit grows with the root of the input beyond 58 GB of
text, so that a slice keeps about 4 KB and the number of slices grows with the input.

Edge cases: null, empty and wordless texts consist of the end token; repeated rows come
out once each; without training texts every score is 0; an empty table gives an empty
result; a null id counts as the empty text for the fold. N-grams are told apart by 56-bit
hashes: of 10^9 different ones each is mistaken for another with odds of 10^-8. A document of any length is part of one chunk.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.runtime import new_path, small_batches, written
from terrane.llm.textops import lower_ascii, mix64, span_hash, text_buffer, word_spans
from terrane.llm.tokenfile import opened

UNIT, PER_UNIT = 12 << 20, 2700  # least bytes of text in a chunk and a range; unit^2 / bytes of text
TOGETHER, TASKS = 3, 6  # chunks and ranges of UNIT bytes that a task takes; tasks at least, if there are as many groups
STEPS, FOLDS, HELD = 512, 5, 1
_END, _START, _PAIR, _TRIPLE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x165667B19E3779F9))
#: Kinds of n-grams: words, pairs, pairs with the end token, triples.
WORD, PAIR, LAST, TRIPLE = range(4)
BITS = 56  # of an n-gram's key
_SPARE = np.uint64(64 - BITS)
_EXACT = 256  # counts below have a bucket each, others four for each power of two
BUCKETS = _EXACT + 4 * 56  # up to 2^64


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed: those that vary little cost little."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return bytes([planes.shape[0]]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, kind: type = np.uint64) -> np.ndarray:
    """As integers of a kind that is wide enough."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs (by sorting: np.unique hashes, which takes several times as long here)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Of each key its number among the distinct ones, sorted."""
    order = np.argsort(keys)
    keys = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.r_[False, keys[1:] != keys[:-1]][: len(keys)], dtype=np.int32)
    return out


def held_out(doc_id: int | None) -> bool:
    """Is crc32 of the id as text, modulo FOLDS, the held-out fold? (a null id: of the empty text)"""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


MANIFEST = "chunk long, file string, texts long"


def chunked(docs: DataFrame, unit: int, folder: str) -> DataFrame:
    """Writes the chunks' files; one row a chunk, with the number of its training texts."""
    small_batches(docs.sparkSession)

    def save(number: int, doc_ids: list[int | None], hashes: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
        words, ids = np.unique(hashes, return_inverse=True)
        held = np.array([held_out(i) for i in doc_ids], bool)
        parts = [
            np.array([i or 0 for i in doc_ids], np.int64).tobytes(), np.array([i is not None for i in doc_ids], bool).tobytes(), held.tobytes(),
            lens.astype(np.int64).tobytes(), _pack(ids.astype(np.uint32)), _pack_sorted(words),
        ]
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        file = f"{number}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(f"{root}/{file}") as sink:
            sink.write(struct.pack("<6q", *map(len, parts)) + b"".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([file]), pa.array([int((~held).sum())], pa.int64())], names=["chunk", "file", "texts"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        doc_ids, parts, lens, size = [], [], [], 0
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            data = lower_ascii(data)
            starts, ends, doc = word_spans(data, offs)
            count = np.bincount(doc, minlength=batch.num_rows)
            tokens = np.full(len(starts) + batch.num_rows, _END, np.uint64)
            tokens[np.arange(len(starts)) + doc] = span_hash(data, starts, ends)
            doc_ids += batch.column(0).to_pylist()
            parts.append(tokens)
            lens.append(count + 1)
            size += len(data)
            if size >= unit:
                yield save(base + made, doc_ids, np.concatenate(parts), np.concatenate(lens))
                doc_ids, parts, lens, size, made = [], [], [], 0, made + 1
        if doc_ids:
            yield save(base + made, doc_ids, np.concatenate(parts), np.concatenate(lens))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, MANIFEST)


class Chunk:
    """A chunk's texts as words, and the keys of its pairs and triples, which are made when asked for."""

    def __init__(self, folder: str, file: str) -> None:
        store, root = opened(folder)
        with store.open_input_file(f"{root}/{file}") as source:
            raw = source.read()
        sizes = struct.unpack_from("<6q", raw)
        at = np.cumsum((48, *sizes)).tolist()
        ids, known, held, lens, tokens, words = (raw[s:e] for s, e in zip(at, at[1:]))
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(known, bool).tolist())]
        self.held, self.lens = np.frombuffer(held, bool), np.frombuffer(lens, np.int64)
        self.words, self.ids = _unpack_sorted(words), _unpack(tokens, np.int32)
        self.first = np.cumsum(self.lens) - self.lens
        self.last = self.first + self.lens - 1
        self.inner = np.ones(len(self.ids), bool)
        self.inner[self.first] = False
        self.ends = np.zeros(len(self.ids), bool)
        self.ends[self.last] = True

    def pairs(self) -> np.ndarray:
        """Of each token the key of the word before, or a text's start, with it."""
        left = np.empty(len(self.ids), np.uint64)
        left[1:] = (self.words * _PAIR)[self.ids[:-1]]
        left[self.first] = np.array([_START]) * _PAIR
        left += mix64(self.words)[self.ids]
        return mix64(left) >> _SPARE

    def triples(self, pairs: np.ndarray) -> np.ndarray:
        """Of each token the key of the pair before with it; none at a text's first token."""
        out = np.zeros(len(self.ids), np.uint64)
        out[1:] = mix64(pairs[:-1] * _TRIPLE + mix64(self.words ^ _TRIPLE)[self.ids[1:]]) >> _SPARE
        return out

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each kind its distinct keys, sorted, and their training counts."""
        train = ~np.repeat(self.held, self.lens)
        yield WORD, self.words >> _SPARE, np.bincount(self.ids[train], minlength=len(self.words))
        pairs = self.pairs()
        for kind, which in ((PAIR, ~self.ends), (LAST, self.ends), (TRIPLE, self.inner)):
            keys = self.triples(pairs) if kind == TRIPLE else pairs
            every, _ = _runs(keys[which])
            own, times = _runs(keys[which & train])
            counts = np.zeros(len(every), np.int64)
            counts[np.searchsorted(every, own)] = times
            yield kind, every, counts


def _slices(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range starts among sorted keys, and their end."""
    edges = np.array([(r << BITS) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


ASK = "part int, chunk long, file string, keys binary, counts binary"
ANSWER = "part int, chunk long, file string, counts binary"
DONE = "kind int, bucket int, types long, tokens long, name string"


def asked(manifest: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Slices of every chunk's keys and counts; part is kind * ranges + range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, keys, counts in Chunk(folder, file).asked():
                    cut = _slices(keys, ranges)
                    rows = [(kind * ranges + r, number, file, _pack_sorted(keys[s:e]), _pack(counts[s:e].astype(np.uint32))) for r, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
                    for k in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()])], names=[c.split()[0] for c in ASK.split(", ")])

    return manifest.mapInArrow(kernel, ASK)


def buckets(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < _EXACT, counts, _EXACT + np.floor(4 * np.log2(np.maximum(counts, 1) / _EXACT)).astype(np.int64))


def added_up(slices: DataFrame, folder: str, ranges: int) -> DataFrame:
    """Answers every slice with the total of each of its keys, in its order; slices come by part. A task's answers (ANSWER)
    are a file in the folder. Returns the files' names, and of each task and kind a histogram of the totals."""
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(ANSWER.split(", "), kinds)])

    def total(part: int, table: pa.Table, types: np.ndarray, tokens: np.ndarray) -> pa.Table:
        keys = [_unpack_sorted(b.as_py()) for b in table.column("keys")]
        counts = np.concatenate([_unpack(b.as_py()) for b in table.column("counts")])
        size = np.cumsum([len(k) for k in keys])
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=counts, minlength=len(every)).astype(np.int64)
        seen = sums[sums > 0]
        own = buckets(seen)
        types += np.bincount(own, minlength=len(types))
        tokens += np.bincount(own, weights=seen, minlength=len(tokens)).astype(np.int64)
        answers = [_pack(sums[back[e - len(k) : e]].astype(np.uint64)) for k, e in zip(keys, size)]
        return pa.table([pa.array([part] * len(keys), pa.int32()), table.column("chunk"), table.column("file"), pa.array(answers, pa.binary())], schema=schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        part, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)]).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(own)]):
                if held and own[s] != part:
                    yield part, pa.Table.from_batches(held)
                    held = []
                part = int(own[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield part, pa.Table.from_batches(held)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, tokens = np.zeros((2, 4, BUCKETS), np.int64)
        store, root = opened(folder)
        name, sink = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.parquet", None
        for part, table in parts(batches):
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = pq.ParquetWriter(f"{root}/{name}", schema, filesystem=store, compression="zstd", use_dictionary=False, write_statistics=False)
            sink.write_table(total(part, table, types[part // ranges], tokens[part // ranges]))
        if sink is not None:
            sink.close()
            rows = [(int(k), int(b), int(types[k, b]), int(tokens[k, b]), None) for k, b in zip(*np.nonzero(types))] + [(None, None, None, None, name)]
            out = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out)], names=[c.split()[0] for c in DONE.split(", ")])

    return slices.sortWithinPartitions("part").mapInArrow(kernel, DONE)


Histogram = dict[int, tuple[int, int]]


def solved(contexts: Histogram, once: int) -> float:
    """K: the mass that backs off equals the number of n-grams seen once."""
    if not contexts:
        return 1.0
    types, tokens = (np.array(x, float) for x in zip(*contexts.values()))
    mean = tokens / types
    low, high = np.log(0.1), np.log(1e12)  # of 1 + K
    for _ in range(100):
        k = np.exp((low + high) / 2) - 1
        more = (tokens * np.minimum(1, (1 + k) / (mean + k))).sum() > once
        low, high = (low, (low + high) / 2) if more else ((low + high) / 2, high)
    return float(np.exp(low) - 1)


class Smoothing:
    """What follows from the histograms of the training counts, by kind."""

    def __init__(self, totals: dict[int, Histogram], texts: int) -> None:
        words = totals.get(WORD, {})
        of = lambda kind, n: totals.get(kind, {}).get(n, (0, 0))[0]
        self.types, self.tokens, self.texts = sum(t for t, _ in words.values()), sum(n for _, n in words.values()), texts
        one, two = of(WORD, 1), of(WORD, 2)
        self.discount = one / (one + 2 * two) if one else 0.5
        self.unknown = self.discount * self.types / self.tokens if self.tokens else 1.0
        # as a context the start of texts stands in for their end: both occur once a text
        self.k2 = solved(words, of(PAIR, 1) + of(LAST, 1))
        self.k3 = solved(totals.get(PAIR, {}), of(TRIPLE, 1))

    def prob(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - self.discount) / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    @staticmethod
    def backoff(context: np.ndarray, k: float) -> np.ndarray:
        """1 - L of contexts with such counts."""
        return np.minimum(1.0, (1 + k) / (np.maximum(context, 1) + k))


class Automaton:
    """States, arcs and failure arcs that a chunk's texts can reach.

    Arcs are numbered by their distinct n-grams; word, pair and triple say for each token
    which n-gram ends with it. Weights are log10, and arcs that training hasn't seen are nan."""

    def __init__(self, chunk: Chunk, answers: list[np.ndarray], model: Smoothing) -> None:
        count, pair_count, last_count, triple_count = answers
        pairs, ends, inner = chunk.pairs(), chunk.ends, np.flatnonzero(chunk.inner)
        self.word, self.pair = chunk.ids, np.empty(len(chunk.ids), np.int32)
        self.pair[~ends] = _numbered(pairs[~ends])
        self.pair[ends] = _numbered(pairs[ends]) + np.int32(len(pair_count))
        triples = chunk.triples(pairs)[inner]
        del pairs
        # a text's first token has the number after all triples, whose arc is never there
        self.triple = np.full(len(chunk.ids), len(triple_count), np.int32)
        self.triple[inner] = _numbered(triples)
        del triples
        pair_count = np.r_[pair_count, last_count]
        # one token that each n-gram ends with tells its words
        at2, at3 = np.empty(len(pair_count), np.int32), np.empty(len(triple_count), np.int32)
        at2[self.pair] = np.arange(len(self.pair), dtype=np.int32)
        at3[self.triple[inner]] = inner
        del inner
        p = model.prob(count)
        context = np.where(chunk.inner[at2], count[self.word[at2 - 1]], model.texts)
        fail = model.backoff(context, model.k2)
        p2 = (1 - fail) * pair_count / np.maximum(context, 1) + fail * p[self.word[at2]]
        context = pair_count[self.pair[at3 - 1]]
        fail = model.backoff(context, model.k3)
        p3 = (1 - fail) * triple_count / np.maximum(context, 1) + fail * p2[self.pair[at3]]
        self.arc1, self.known = np.log10(p), count > 0
        self.arc2 = np.where(pair_count > 0, np.log10(p2), np.nan)
        self.arc3 = np.r_[np.where(triple_count > 0, np.log10(p3), np.nan), np.nan]
        self.fail1, self.fail2 = np.log10(model.backoff(count, model.k2)), np.log10(model.backoff(pair_count, model.k3))
        self.fail_start = float(np.log10(model.backoff(np.array(model.texts), model.k2)))
        self.inner, self.first, self.lens = chunk.inner, chunk.first, chunk.lens

    def walk(self) -> np.ndarray:
        """log10 P of every token: from left to right, all pieces of STEPS tokens in step."""
        cuts = -(-self.lens // STEPS)
        text = np.repeat(np.arange(len(self.lens)), cuts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = self.first[text] + nth * STEPS
        size = np.minimum(STEPS, self.lens[text] - nth * STEPS)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        out = np.empty(len(self.word))
        # the state's order and the log10 weights of its failure arcs: from pair to word, from word to none
        inner, word, pair = self.inner[begin], self.word[begin - 1], self.pair[begin - 1]
        state = np.where(inner, np.where(np.isnan(self.arc2[pair]), self.known[word].astype(int), 2), 1)
        down2, down1 = np.where(inner, self.fail2[pair], 0.0), np.where(inner, self.fail1[word], self.fail_start)
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # pieces longer than each step
        for step, n in enumerate(live.tolist()):
            at = begin[:n] + step
            state, down1, down2 = state[:n], down1[:n], down2[:n]
            word, pair = self.word[at], self.pair[at]
            a2, a3 = self.arc2[pair], self.arc3[self.triple[at]]
            seen2 = a2 == a2
            take3 = (state == 2) & (a3 == a3)
            take2 = ~take3 & (state >= 1) & seen2
            fell2 = (state == 2) & ~take3
            fell1 = (state >= 1) & ~take3 & ~take2
            out[at] = np.where(take3, a3, np.where(take2, a2, self.arc1[word])) + np.where(fell2, down2, 0.0) + np.where(fell1, down1, 0.0)
            state = np.where(seen2, 2, self.known[word].astype(int))
            down1, down2 = self.fail1[word], self.fail2[pair]
        return out


def tasks(groups: int, each: int) -> int:
    """For so many groups, of which a task takes ``each``."""
    return min(groups, max(TASKS, ceil(groups / each)))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """SCORES of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = max(UNIT, int(sqrt(size * PER_UNIT)))
    ranges, folder = max(2, ceil(size / unit)), new_path(spark, "chunks")
    together = max(1, TOGETHER * UNIT // unit)
    # dealt by number: a task that runs again names other files, and its chunks must go where they went
    manifest = written(chunked(docs, unit, folder).repartition(ceil(ranges / 4096), "chunk"), "manifest")
    sums = manifest.agg(F.count("*"), F.sum("texts")).first()
    n_chunks, texts = max(1, sums[0]), sums[1] or 0
    slices = asked(manifest.select("chunk", "file").repartitionByRange(n_chunks, "chunk"), folder, ranges)
    answered = new_path(spark, "answers")
    done = added_up(slices.repartition(tasks(4 * ranges, 4 * together), "part"), answered, ranges)
    totals: dict[int, Histogram] = {}
    # a bucket of counts each, so a few hundred rows a kind, and one row with a name a task
    by_bucket = done.groupBy("kind", "bucket").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.collect_list("name").alias("names"))
    for r in written(by_bucket.repartition(1), "totals").collect():
        if r["kind"] is None:
            answers = spark.read.schema(ANSWER).parquet(*(f"{answered}/{name}" for name in r["names"]))
        else:
            totals.setdefault(r["kind"], {})[r["bucket"]] = (r["types"], r["tokens"])
    if not sums[0]:
        return spark.createDataFrame([], SCORES)
    # the slices are answered, and Spark deletes their files when the driver has collected their plan
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    model = Smoothing(totals, texts)

    def score(table: pa.Table) -> pa.Table:
        c = Chunk(folder, table.column("file")[0].as_py())
        parts = table.column("part").to_numpy()
        rows = [np.flatnonzero(parts // ranges == kind) for kind in range(4)]
        counts = [np.concatenate([np.zeros(0, np.int64), *(_unpack(table.column("counts")[i].as_py()).astype(np.int64) for i in own[np.argsort(parts[own])].tolist())]) for own in rows]
        automaton = Automaton(c, counts, model)
        count = counts[WORD]
        del counts
        logs = automaton.walk()
        add = lambda x: np.add.reduceat(x, c.first)
        known = (count > 0).astype(np.int64)
        cols = [c.doc_ids, c.held, c.lens, add(known[c.ids]), np.full(len(c.lens), model.tokens), add(model.base(count)[c.ids]), add(logs)]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds)], names=[f.split()[0] for f in SCORES.split(", ")])

    rows = answers.repartitionByRange(tasks(n_chunks, together), "chunk")
    return rows.groupBy("chunk").applyInArrow(score, SCORES)


def op4(docs: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"))
