"""Toxicity: a subsequence string-kernel SVM on Nystroem landmarks.

Units are words (white space apart, outer punctuation off), in lower case, folded to
``SYMBOLS`` symbols: look-alike digits and signs stand for their letters, other signs
only take up room; three or more one-letter words in a row make one unit. Long units are
read in overlapping windows. The kernel sums over common subsequences of three symbols,
with ``DECAY`` for every place they span, so that gaps and inserted characters weaken a
match and don't break it; it is normalised by both units' own values. A document's score
is a logistic curve, fitted on labelled documents, of the values of its two most toxic
units that don't overlap: what also turns up alone in clean texts needs a second one.

Training needs no word list. Of a bounded sample of labelled documents (``TOXIC`` with
label 1 and ``CLEAN`` with 0, by a hash of their id, held-out rows never) each passes its
label to its sentences, and a sentence is represented by its most toxic unit, its witness.
Witnesses to start from are units that occur in several toxic documents that aren't copies
of each other and that, over the whole training part, toxic documents have at least ``RATIO``
times as often as clean ones, by the lower end of an interval of ``Z`` standard errors. A
support vector machine with squared hinge is solved by Newton steps on the Nystroem features
K(x, L) K(L, L)^-1/2 of the witnesses of toxic sentences against units of clean ones, and
then chooses the witnesses anew, and the hardest clean units, in ``ROUNDS`` rounds. A toxic
document's sentence without a unit above zero is left out: its label is due to others.
A unit on both sides is a row on both, the clean one weighted by the ratio of its rates.

Its decision is linear in the subsequence weights, so the landmarks collapse to one table
of SYMBOLS^3 weights, and a unit costs one look-up for each of its triples: the same
value, to rounding, as the sum over landmarks.

Edge cases: null and empty texts score as a text without units, near 0; repeated rows
come out once each; without labels of both kinds every score is 0; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.bpe import slabs
from terrane.llm.hashtable import HashTable
from terrane.llm.runtime import small_batches
from terrane.llm.textops import lower_ascii, mix64, span_hash, text_buffer, word_spans

SYMBOLS, DECAY, LONG = 64, np.float32(0.5), 20
TOXIC, CLEAN = 1200, 2400
LANDMARKS, NEGATIVES, ROUNDS = 200, 3000, 3
#: Share of the toxic documents of the sample, copies aside, that a positive unit occurs in at least,
#: and from which on it needs no document of its own to explain.
SHARE, OFTEN = 0.002, 0.05
#: Least ratio of a positive unit's rate in toxic documents to that in clean ones, and the standard errors below its estimate.
RATIO, Z = 3.0, 2.3
CACHE = 1 << 20
FOLDS, HELD = 3, 1


def _fold() -> np.ndarray:
    """Symbol of each byte, 0 for signs that only take up room: letters 1-26, bytes of other characters after them."""
    of = np.zeros(256, np.uint8)
    of[97:123] = of[65:91] = np.arange(1, 27)
    of[128:] = 27 + np.arange(128) % 37
    for sign, letter in zip(b"0134579@$!", b"oieastgasi"):
        of[sign] = letter - 96
    return of


FOLD = _fold()
_INSIDE = FOLD > 0
_INSIDE[[ord(c) for c in "!@$"]] = False  # not trimmed to, at a word's ends


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text number) of all units."""
    starts, ends, doc = word_spans(data, offs)
    # outer signs off: from the first to the last letter of each word
    letters = np.flatnonzero(_INSIDE[data])
    first, last = np.searchsorted(letters, starts), np.searchsorted(letters, ends) - 1
    some = first <= last
    starts, ends, doc = letters[first[some]], letters[last[some]] + 1, doc[some]
    single = (ends - starts == 1) & (data[np.minimum(starts, max(len(data) - 1, 0))] < 128) if len(starts) else np.zeros(0, bool)
    start_run = single & np.r_[True, ~single[:-1] | (doc[1:] != doc[:-1])][: len(single)]
    run = np.cumsum(start_run) * single
    size = np.bincount(run)[run] * single if len(run) else run
    joined = np.flatnonzero(size >= 3)
    extra = data[starts[joined]]
    if len(joined):
        heads = np.flatnonzero(np.r_[True, run[joined][1:] != run[joined][:-1]])
        at = len(data) + heads
        data = np.r_[data, extra]
        starts, ends, doc = np.r_[starts, at], np.r_[ends, np.r_[at[1:], len(data)]], np.r_[doc, doc[joined[heads]]]
    keep = ends - starts >= 3
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):  # windows of LONG with half of it in common
        n = -(-(ends[long] - starts[long] - LONG) // (LONG // 2)) + 1
        which = np.repeat(long, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = np.minimum(starts[which] + k * (LONG // 2), ends[which] - LONG)
        rest = np.ones(len(starts), bool)
        rest[long] = False
        starts, ends, doc = np.r_[starts[rest], at], np.r_[ends[rest], at + LONG], np.r_[doc[rest], doc[which]]
    return data, starts, ends, doc


def _recursion(same: np.ndarray) -> np.ndarray:
    """Kernels from same[i, j, ...], 1 where symbol i of one unit is symbol j of the other: the
    textbook recursion over prefixes, for all pairs of units along the last axes at once."""
    n, m, d = same.shape[0], same.shape[1], DECAY
    pairs = same.shape[2:]
    lower = np.ones((n + 1, m + 1, *pairs), np.float32)
    for _ in range(2):
        up = np.zeros_like(lower)
        for i in range(1, n + 1):
            along = np.zeros(pairs, np.float32)
            for j in range(1, m + 1):
                along = d * along + d * d * same[i - 1, j - 1] * lower[i - 1, j - 1]
                up[i, j] = d * up[i - 1, j] + along
        lower = up
    return (same * lower[:n, :m]).sum((0, 1)) * d * d


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of all pairs of rows of symbols (0: only takes up room)."""
    x, y = a.T[:, None, :, None], b.T[None, :, None, :]
    return _recursion(((x == y) & (x > 0)).astype(np.float32))


def own_kernel(x: np.ndarray) -> np.ndarray:
    """kernel(x, x) of each row."""
    a = x.T
    return _recursion(((a[:, None] == a[None]) & (a > 0)[:, None]).astype(np.float32))


def rows_of(words: list[bytes]) -> np.ndarray:
    """Symbols of units, a row each."""
    width = max([3, *map(len, words)])
    return FOLD[np.frombuffer(b"".join(w.ljust(width, b"\x00") for w in words), np.uint8).reshape(-1, width)] if words else np.zeros((0, 3), np.uint8)


def normalised(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised kernel; rows are padded at their ends, which doesn't count."""
    out = np.zeros((len(a), len(b)), np.float32)
    size = np.where(a > 0, np.arange(1, a.shape[1] + 1), 0).max(1, initial=1)
    wide = int(np.where(b > 0, np.arange(1, b.shape[1] + 1), 0).max(initial=1))
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        for k in range(0, len(own), 128):
            out[own[k : k + 128]] = kernel(a[own[k : k + 128], :n], b[:, :wide])
    return out / np.sqrt(np.maximum(own_kernel(a), 1e-12))[:, None] / np.sqrt(np.maximum(own_kernel(b), 1e-12))[None, :]


class Scorer:
    """Weights of triples, offset and logistic curve; and a cache of units' values."""

    def __init__(self, weights: np.ndarray, offset: float, slope: tuple[float, float] = (1.0, 0.0), shift: float = 0.0) -> None:
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift
        self._reset()

    def _reset(self) -> None:
        self.table, self.values = HashTable(), np.zeros(1 << 16, np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "values")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The machine's values of rows of symbols of one length."""
        n, v = x.shape[1], np.zeros(len(x), np.float32)
        wide = x.astype(np.int32)
        for i in range(n - 2):
            for k in range(i + 2, n):
                far = DECAY ** (k - i + 1)
                ends = wide[:, i] * SYMBOLS * SYMBOLS + wide[:, k]
                for j in range(i + 1, k):
                    v += far * self.weights[ends + wide[:, j] * SYMBOLS]
        return v / np.sqrt(np.maximum(own_kernel(x), 1e-12)) + self.offset

    def values_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.table.count > CACHE:
            self._reset()
        key = span_hash(data, starts, ends)
        slot = self.table.find(key)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, one = np.unique(key[miss], return_index=True)
            one = miss[one]
            one = one[np.argsort((ends - starts)[one], kind="stable")]
            size, new = (ends - starts)[one], np.zeros(len(one), np.float32)
            for part in np.split(np.arange(len(one)), np.flatnonzero(np.diff(size)) + 1):
                for k in range(0, len(part), 20_000):
                    p = part[k : k + 20_000]
                    new[p] = self.decide(FOLD[data[starts[one[p]][:, None] + np.arange(size[p[0]])]])
            first = self.table.count
            while first + len(one) > len(self.values):
                self.values = np.concatenate([self.values, self.values])
            self.values[first : first + len(one)] = new
            self.table.add(key[one])
            slot[miss] = self.table.find(key[miss])
        return self.values[slot]

    def most(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The greatest value among each text's units and the greatest of those that don't overlap it, within -1 and 1; -1 without any."""
        data, starts, ends, doc = units(data, offs)
        out = np.full((len(offs) - 1, 2), -1.0)
        if len(doc):
            value = np.clip(self.values_of(data, starts, ends), -1, 1)
            order = np.lexsort((starts, -value, doc))
            first = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
            out[doc[first], 0] = value[first]
            top = np.zeros(len(offs) - 1, np.int64)
            top[doc[first]] = first
            apart = (ends <= starts[top[doc]]) | (starts >= ends[top[doc]])
            np.maximum.at(out[:, 1], doc[apart], value[apart])
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.most(lower_ascii(data), offs) @ np.array(self.slope) + self.shift, -40, 40)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the squared-hinge machine, by Newton steps on the rows within the margin."""
    z = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        own = (1 - y * (z @ w)) > 0
        zc = z[own] * cost[own, None]
        new = np.linalg.solve(zc.T @ z[own] + np.diag(np.r_[np.full(x.shape[1], 0.01), 1e-6]), zc.T @ y[own])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def fit(positive: list[bytes], toxic: list[list[list[bytes]]], clean: list[list[list[bytes]]]) -> Scorer:
    """The machine from documents as sentences of units, toxic and clean; positive: the witnesses to start from."""
    rng = np.random.default_rng(5)
    docs_with = [Counter(u for doc in docs for u in {u for s in doc for u in s}) for docs in (toxic, clean)]
    vocabulary, pool = sorted(docs_with[0]), sorted(docs_with[1])
    number = {u: k for k, u in enumerate(vocabulary)}
    sentences = [s for doc in toxic for s in doc if s]
    flat = np.array([number[u] for s in sentences for u in s], np.int64)
    heads = np.cumsum([0, *map(len, sentences)])[:-1]
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    value = np.full(len(vocabulary), -1.0)
    for k, u in enumerate(positive):
        value[number[u]] = 1 / (1 + k)
    chosen = set(rng.choice(len(pool), min(NEGATIVES, len(pool)), replace=False).tolist())
    scorer = None
    for _ in range(ROUNDS):
        best = np.maximum.reduceat(value[flat], heads)
        at = np.flatnonzero((value[flat] == best[of]) & (best[of] > 0))
        at = at[np.r_[True, of[at][1:] != of[at][:-1]]] if len(at) else at
        count = np.bincount(flat[at], minlength=len(vocabulary))  # sentences that a unit is the witness of
        own = np.flatnonzero(count)
        own = own[np.argsort(-count[own], kind="stable")]
        witness = [vocabulary[k] for k in own]
        negative = sorted({pool[i] for i in chosen} | (set(witness) & set(pool)))
        both = set(witness)
        hard = [u for u in negative if u not in both]
        if scorer is not None:
            hard = [hard[i] for i in np.argsort(-_values(scorer, hard), kind="stable")]
        half = witness[: LANDMARKS * 2 // 3]
        marks = rows_of(half + hard[: LANDMARKS - len(half)])
        gram = normalised(marks, marks).astype(np.float64)
        w, vector = np.linalg.eigh(gram)
        root = vector / np.sqrt(np.maximum(w, 1e-6)) * (w > 1e-6) @ np.eye(len(w))
        x = normalised(rows_of(witness + negative), marks) @ root
        y = np.r_[np.ones(len(witness)), -np.ones(len(negative))]
        p = 1 + np.log(count[own])
        p *= len(y) / 2 / p.sum()
        mass = dict(zip(witness, p))
        rate = lambda u: docs_with[1][u] / len(clean) / (docs_with[0][u] / len(toxic))
        n = np.array([mass[u] * min(1.0, rate(u)) if u in both else len(y) / 2 / max(1, len(hard)) for u in negative])
        w, offset = svm(x, y, np.r_[p, n])
        scorer = Scorer(collapsed(marks, root @ w), offset)
        chosen |= set(np.argsort(-_values(scorer, pool), kind="stable")[: NEGATIVES // 2].tolist())
        value = _values(scorer, vocabulary)
    return scorer


def _values(scorer: Scorer, words: list[bytes]) -> np.ndarray:
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    return scorer.values_of(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)


def collapsed(marks: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weights of triples that give sum beta_j K(x, mark_j) for any x."""
    out = np.zeros(SYMBOLS**3)
    norm = np.sqrt(np.maximum(own_kernel(marks), 1e-12))
    for i, j, k in combinations(range(marks.shape[1]), 3):
        own = np.flatnonzero((marks[:, i] > 0) & (marks[:, j] > 0) & (marks[:, k] > 0))
        m = marks[own].astype(np.int64)
        np.add.at(out, (m[:, i] * SYMBOLS + m[:, j]) * SYMBOLS + m[:, k], beta[own] / norm[own] * float(DECAY) ** (k - i + 1))
    return out.astype(np.float32)


def sentences_of(text: str | None) -> list[list[bytes]]:
    """Units of each sentence: up to a line's end or a stop before white space."""
    raw = lower_ascii(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
    stop, space = np.isin(raw, np.frombuffer(b".!?", np.uint8)), np.isin(raw, np.frombuffer(b" \t\r\n", np.uint8))
    cuts = np.flatnonzero((raw == 10) | (stop & np.r_[space[1:], False][: len(raw)])) + 1
    data, starts, ends, doc = units(raw, np.unique(np.r_[0, cuts, len(raw)]) if len(raw) else np.zeros(2, np.int64))
    out: dict[int, dict[bytes, None]] = defaultdict(dict)
    b = data.tobytes()
    for k, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist()):
        out[k][b[s:e]] = None
    return [list(out[k]) for k in sorted(out)]


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def trained(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer from labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    flat = Scorer(np.zeros(SYMBOLS**3, np.float32), 0.0, (0.0, 0.0), -40.0)
    # ids first and then the texts of a bounded number of them, so that no text is shuffled
    label = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    chosen = {r[0]: y for y, most in ((1, TOXIC), (0, CLEAN)) for r in label.where(F.col("toxic") == y).orderBy(*by_hash).limit(most).select("doc_id").collect()}
    texts = sorted(tuple(r) for r in docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.coalesce("text", F.lit(""))).collect())
    toxic, clean = ([t for i, t in texts if chosen[i] == y] for y in (1, 0))
    if not toxic or not clean:
        return flat
    toxic_sentences, clean_sentences = [sentences_of(t) for t in toxic], [sentences_of(t) for t in clean]
    toxic_units, clean_units = ([list(dict.fromkeys(u for s in doc for u in s)) for doc in docs_] for docs_ in (toxic_sentences, clean_sentences))
    # copies of one document count once: they share the least of a few hashes of their units
    group: dict[tuple[int, int], int] = {}
    owner = []
    for k, own in enumerate(toxic_units):
        h = np.array([zlib.crc32(u) for u in own] or [k], np.uint64)
        least = [(s, int(mix64(h + np.uint64(s << 40)).min())) for s in range(4)]
        g = next((group[x] for x in least if x in group), k)
        group.update({x: g for x in least})
        owner.append(g)
    seen: dict[bytes, set[int]] = defaultdict(set)
    for g, own in zip(owner, toxic_units):
        for u in own:
            seen[u].add(g)
    n_clean = Counter(u for own in clean_units for u in own)
    least = max(2, round(SHARE * len(set(owner))))
    candidates = sorted((u for u, g in seen.items() if len(g) >= least and least_ratio(len(g), len(set(owner)), n_clean[u], len(clean), 0.0) >= RATIO), key=lambda u: (-len(seen[u]), u))
    # the sample proposes, all documents of the training part decide
    total = {r["toxic"]: r["n"] for r in label.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = _occurrences(docs.where(~held_out()), label, candidates)
    candidates = [u for u in candidates if least_ratio(n[u, 1], total[1], n[u, 0], total[0]) >= RATIO]
    often = [u for u in candidates if len(seen[u]) >= max(3, OFTEN * len(set(owner)))]
    positive = list(dict.fromkeys(explaining(candidates, toxic_units) + often))
    if not positive:
        return flat
    scorer = fit(positive, toxic_sentences, clean_sentences)
    buffers = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in toxic + clean]
    value = np.concatenate([scorer.most(lower_ascii(b), np.array([0, len(b)])) for b in buffers])
    *slope, scorer.shift = logistic(value, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    scorer.slope = tuple(slope)
    return scorer


def explaining(candidates: list[bytes], documents: list[list[bytes]]) -> list[bytes]:
    """Units that explain why documents are toxic: each in turn the one that occurs in most
    documents not yet explained, as long as there are two. What only goes along with another
    toxic unit, as all other words of a copied document do, explains nothing."""
    held = dict.fromkeys(candidates, 0)
    for k, own in enumerate(documents):
        for u in own:
            if u in held:
                held[u] |= 1 << k
    open_, chosen = (1 << len(documents)) - 1, []
    while held:
        best = max(candidates, key=lambda u: (held[u] & open_).bit_count())
        if (held[best] & open_).bit_count() < 2:
            break
        chosen.append(best)
        open_ &= ~held[best]
    return chosen


def least_ratio(toxic: int, of_toxic: int, clean: int, of_clean: int, z: float = Z) -> float:
    """Lower end of the interval of the ratio of two rates, each with half a document added."""
    a, b = toxic + 0.5, clean + 0.5
    spread = max(0.0, 1 / a - 1 / (of_toxic + 0.5) + 1 / b - 1 / (of_clean + 0.5)) ** 0.5
    return a / (of_toxic + 0.5) / (b / (of_clean + 0.5)) * float(np.exp(-z * spread))


def _occurrences(docs: DataFrame, labels: DataFrame, candidates: list[bytes]) -> Counter:
    """In how many documents of each label each candidate occurs.

    Documents give their ids and the numbers of the candidates in them, if any; only those are joined."""
    if not candidates:
        return Counter()
    size = np.array([len(c) for c in candidates])
    ends = np.cumsum(size)
    keys = span_hash(np.frombuffer(b"".join(candidates), np.uint8), ends - size, ends)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(len(keys))
        table.add(keys)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for k, j in slabs(offs):
                own, starts, ends, doc = units(lower_ascii(data[offs[k] : offs[j]]), offs[k : j + 1] - offs[k])
                at = table.find(span_hash(own, starts, ends))
                hit = np.flatnonzero(at >= 0)
                pair = np.unique(doc[hit] * len(keys) + at[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, j - k).take(pa.array(pair // len(keys))), pa.array(pair % len(keys))], names=["doc_id", "unit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(look, "doc_id long, unit long")
    n = rows.join(labels.select("doc_id", "toxic"), "doc_id").groupBy("unit", "toxic").agg(F.countDistinct("doc_id").alias("n"))
    return Counter({(candidates[r["unit"]], r["toxic"]): r["n"] for r in n.collect()})


def logistic(value: np.ndarray, y: np.ndarray) -> list[float]:
    """Slope of each column and shift of P(y = 1), by Newton steps with a weak prior."""
    z, w = np.c_[value, np.ones(len(value))], np.zeros(value.shape[1] + 1)
    cost = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y == 0).sum())) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w)), z.T @ (cost * (p - y)) + 0.05 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", score: str = "score") -> DataFrame:
    """All columns but the text, and the score."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.col(text).cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(batch.num_columns - 1))
            for k, j in slabs(offs):
                s = scorer.scores(data[offs[k] : offs[j]], offs[k : j + 1] - offs[k])
                yield pa.RecordBatch.from_arrays([*batch.slice(k, j - k).columns[:-1], pa.array(s)], names=[*others, score])

    return rows.mapInArrow(work, ", ".join([f"`{c}` {t}" for c, t in rows.dtypes[:-1]] + [f"`{score}` double"]))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
