"""The ten training-data operators against brute force, and their edge cases."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import bpe, components, lm, media, mixing, pii, quality, runtime, simhash, tokenfile, toxicity, urls
from terrane.llm.textops import text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string"
LONG = " ".join(f"word{i % 97} part" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "one", "A b c D", "a b c d", "naïve café's don't  two   spaces\n\nend ", "x" * 5000, "7" * 3000, LONG,
    "mail me at bob.smith@mail.example.com or +1 (552) 555-3899, ip 10.20.30.40 card 4111 1111 1111 1111.", "same text here today again", "same text here today again",
    "line one is here\nline one is here\nother " * 3, "漢字 かな 😀 emoji", "  nbsp sep", "### $$$ | <b>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 0.5, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[4]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_bpe_equals_the_library(docs, empty):
    path, enc = P.path("byte_bpe_50k.tiktoken"), vocabulary()
    got = by_id(bpe.op2(docs, path), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i if i != 3 else None] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.op2(docs, path).count() == len(TEXTS) + 1 and bpe.op2(empty, path).count() == 0
    row = bpe.encoded(docs.where("doc_id = 14").select("doc_id", "text"), path).first()
    back = vocabulary().decode_bytes(row.ids)
    assert [back[a:] for a in row.token_offsets][0] == TEXTS[14].encode() and row.n_tokens == len(row.ids)


def test_bpe_on_random_strings():
    rng = np.random.default_rng(0)
    letters = list("ab'strevmldLL  \n\t é9².,!漢　\u0085ñ😀") + ["'s", "'re", " '", "\r\n"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)]
    enc, v = vocabulary(), bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    ids, n = bpe.encode_texts(v, *text_buffer(pa.array(texts)))
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert all(p.tolist() == enc.encode_ordinary(t) for p, t in zip(parts, texts))


def test_token_files_round_trip(docs, empty):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    folder, manifest = tokenfile.write_tokens(docs, path)
    got = tokenfile.read_tokens(folder, manifest).orderBy("start").collect()
    at = 0
    ids_of = {i: t for i, t in enumerate(TEXTS)}
    ids_of[None] = TEXTS[3]
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: -1 if i is None else i) and len(got) == len(TEXTS) + 1
    for r in got:
        ids = tok.encode(ids_of[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in tokenfile.read_tokens(folder, manifest, (10,)).collect()] == [10]
    assert tokenfile.op5(empty, path).count() == 0


def test_damaged_frame_is_found(tmp_path):
    from pyarrow import fs

    at = tmp_path / "f"
    with open(at, "wb") as f:
        w = tokenfile.FrameWriter(f)
        w.add(1, b"abcd" * 50)
        w.add(None, b"")
        w.close()
    store = fs.LocalFileSystem()
    r = tokenfile.FrameReader(store.open_input_file(str(at)))
    assert r.ids == [1, None] and r.read(0) == b"abcd" * 50 and r.read(1) == b""
    raw = bytearray(at.read_bytes())
    raw[10] ^= 255
    at.write_bytes(bytes(raw))
    with pytest.raises(Exception):
        tokenfile.FrameReader(store.open_input_file(str(at))).read(0)


def test_media_stores_everything(docs, empty):
    got = by_id(media.op3(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert got[i if i != 3 else None] == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.op3(empty).count() == 0
    with pytest.raises(ValueError):
        media.parse(b"no image")


def bits_of(codes):
    s = "".join(codes)
    s += "1" * (-len(s) % 8)
    b = bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))
    return b.replace(b"\xff", b"\xff\x00")


def test_media_reads_other_baseline_files():
    """Two components with other tables, sampling 2x1, no restarts: codes of several lengths, runs and ends of blocks."""
    dc = bytes([0, 3] + [0] * 14) + bytes([0, 2, 3])  # 00: 0, 01: class 2, 10: class 3
    ac = bytes([0, 2, 1] + [0] * 13) + bytes([0x00, 0x12, 0xF0])  # 00: end, 01: run 1 class 2, 100: 16 zeros
    blocks = [(["01", "11", "01", "10", "00"], {0: 3, 2: 2}), (["00", "100", "01", "00", "00"], {0: 3, 18: -3}), (["10", "000", "00"], {0: -7})]
    body = bits_of(c for codes, _ in blocks for c in codes)
    seg = media._segment
    f = b"\xff\xd8" + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0])) + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + body + b"\xff\xd9"
    ((image, planes),) = media.decode([f])
    assert (image.width, image.height) == (16, 8) and planes[0].shape == (1, 2, 64) and planes[1].shape == (1, 1, 64)
    for got, (_, want) in zip([planes[0][0, 0], planes[0][0, 1], planes[1][0, 0]], blocks):
        assert {k: int(v) for k, v in enumerate(got) if v} == want
    assert media.thumbnail(image, planes).tolist() == [[129, 129]]


def test_fingerprints_and_components(docs, empty):
    def brute(t):
        w = WORD.findall((t or "").translate(LOWER))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = by_id(simhash.op9(docs), "fingerprint", "component_id")
    want = {i if i != 3 else None: brute(t) for i, t in enumerate(TEXTS)}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    near = lambda a, b: bin(want[a] ^ want[b]).count("1") <= 4
    least = {i: i for i in want}
    for _ in want:
        for a in want:
            least[a] = min((x for x in (least[b] for b in want if near(a, b)) if x is not None), default=None)
    assert {i: c for i, (_, c) in got.items()} == least
    assert simhash.op9(empty).count() == 0


@pytest.mark.parametrize("hot, held, hub", [(4096, 100_000, 1000), (2, 30, 2), (3, 5, 3)])
def test_links_by_variants_are_complete(spark, monkeypatch, hot, held, hub):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(12)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.node, r.label) for r in simhash.connected(simhash.links(df)).collect()}
    u = np.array(sorted(fps), np.int64)
    near = np.bitwise_count((u[:, None] ^ u[None]).view(np.uint64)) <= 4
    label = np.arange(len(u))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    want = [{int(u[i]) for i in np.flatnonzero(label == k)} for k in np.unique(label) if (label == k).sum() > 1]
    parts = collections.defaultdict(set)
    for n, lab in got:
        parts[lab].add(n)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want))
    if hot < 4096:  # some keys were split
        keys = df.select("fp", F.explode(simhash.wildcard_keys()).alias("key")).groupBy("key").count()
        assert keys.where(F.col("count") > hot).count() > 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200 - k, 201 - k) for k in range(10)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 191 for i in range(191, 202)}


class Backoff:
    """The language model in plain dictionaries."""

    def __init__(self, texts):
        self.c = collections.Counter()
        for w in texts:
            t = ["<s>", *w]
            for i in range(1, len(t)):
                for k in (1, 2, 3):
                    if i + 1 - k >= 0:
                        self.c[tuple(t[i + 1 - k : i + 1])] += 1
        self.texts = len(texts)
        self.words = {g[0]: n for g, n in self.c.items() if len(g) == 1}
        self.n = sum(self.words.values())
        one, two = (sum(n == k for n in self.words.values()) for k in (1, 2))
        self.d = one / (one + 2 * two) if one else 0.5
        self.k = [self.solve(1, 2), self.solve(2, 3)]

    def context(self, h):
        return self.texts if h == ("<s>",) else self.c[h]

    def solve(self, order, above):
        own = [self.texts] if order == 1 else []
        own += [n for g, n in self.c.items() if len(g) == order and g[-1] is not None]
        once = sum(n == 1 for g, n in self.c.items() if len(g) == above)
        low, high = math.log(0.1), math.log(1e12)
        for _ in range(100):
            k = math.exp((low + high) / 2) - 1
            low, high = (low, (low + high) / 2) if sum(n * min(1, (1 + k) / (n + k)) for n in own) > once else ((low + high) / 2, high)
        return math.exp(low) - 1

    def p(self, w, h):
        if not h:
            return (self.words[w] - self.d) / self.n if w in self.words else self.d * len(self.words) / self.n
        n, k, lower = self.context(h), self.k[len(h) - 1], self.p(w, h[1:])
        if not n:
            return lower
        fail = min(1, (1 + k) / (n + k))
        return (1 - fail) * self.c[(*h, w)] / n + fail * lower

    def score(self, w):
        t = ["<s>", *w]
        return sum(math.log10(self.p(t[i], tuple(t[max(0, i - 2) : i]))) for i in range(1, len(t)))


def test_language_model(docs, empty):
    tokens = {i if i != 3 else None: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in enumerate(TEXTS)}
    train = [w for i, w in [*tokens.items(), (4, tokens[4])] if not lm.held_out(i)]
    c = collections.Counter(x for w in train for x in w)
    model = Backoff(train)
    n, v = sum(c.values()), len(c)
    got = by_id(lm.op4(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert got[i][:4] == (lm.held_out(i), len(w), sum(c[x] > 0 for x in w), n) and got[i][4] == pytest.approx(base, rel=1e-9)
        assert got[i][5] == pytest.approx(model.score(w), rel=1e-6)
    assert lm.op4(empty).count() == 0


def test_language_model_equals_a_plain_one_and_sums_to_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    texts = {i: rng.choice(words, int(rng.integers(0, 60)), p=np.arange(30, 0, -1) / 465).tolist() for i in range(120)}
    twice = [f"z{k}" for k in rng.integers(0, 9, 40)]
    free = [i for i in range(200, 400) if not lm.held_out(i)]
    texts |= {free[0]: twice, free[1]: twice, free[2]: [f"y{k}" for k in rng.integers(0, 9, 40)]}
    train = [[*w, None] for i, w in texts.items() if not lm.held_out(i)]
    model = Backoff(train)
    monkeypatch.setattr(lm, "STEPS", 7)  # many pieces a text
    monkeypatch.setattr(lm, "UNIT", 2000)  # many chunks and ranges
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.scored(rows).collect()}
    assert len(got) == len(texts)
    for i, w in texts.items():
        assert got[i] == pytest.approx(model.score([*w, None]), rel=1e-6)
    for h in [("w0", "w1"), ("w5", "unseen"), ("unseen", "w2"), ("<s>",), ("<s>", "w0"), (twice[0], twice[1]), ()]:
        assert sum(model.p(w, h) for w in [*model.words, "unseen"]) == pytest.approx(1, abs=1e-9)
    assert got[free[0]] > got[free[2]] + 10  # what occurs twice is told from what occurs once


def test_language_model_writes_few_files(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = {i: [f"w{k}" for k in rng.zipf(1.5, 60) % 5000] for i in range(240)}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(40, "doc_id").cache()
    whole = {r.doc_id: r.score for r in lm.scored(rows).collect()}
    tables = {}
    monkeypatch.setattr(lm, "written", lambda df, name: tables.setdefault(name, runtime.written(df, name)))
    monkeypatch.setattr(lm, "UNIT", 1000)
    monkeypatch.setattr(lm, "PER_UNIT", 1)  # as many ranges as chunks, though the input is small
    out = lm.scored(rows)
    chunks = tables["manifest"].count()
    answers = out.inputFiles()
    parts = spark.read.parquet(*answers).select("part").distinct().count()
    assert chunks > 30 and parts > 150
    assert len(tables["manifest"].inputFiles()) == 1
    assert len(answers) <= max(16, math.ceil(parts / 10))
    assert out.rdd.getNumPartitions() <= 16
    got = {r.doc_id: r.score for r in out.collect()}
    assert got == pytest.approx(whole, rel=1e-9) and len(got) == len(texts)


def test_language_model_takes_little_memory_a_token(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 1500) % 50000)) for i in range(200)], "doc_id long, text string").coalesce(1)
    folder = runtime.new_path(spark, "chunks")
    file = lm.chunked(rows, 64 << 20, folder).first()["file"]
    answers = [counts for _, _, counts in lm.Chunk(folder, file).asked()]
    totals = {kind: {int(b): (int((lm.buckets(c) == b).sum()), int(c[lm.buckets(c) == b].sum())) for b in np.unique(lm.buckets(c[c > 0]))} for kind, c in enumerate(answers)}
    tracemalloc.start()
    try:
        logs = lm.Automaton(lm.Chunk(folder, file), answers, lm.Smoothing(totals, 160)).walk()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(logs) == 200 * 1501 and np.isfinite(logs).all()
    assert peak < 80 * len(logs)  # it took 100 with all of a token's weights and 64-bit numbers at once


def test_language_model_prefers_seen_words(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words, 6, p=np.r_[0.4, 0.3, np.full(10, 0.03)])) for _ in range(60)]
    train = [i for i in range(200) if not lm.held_out(i)][:60]
    test = [i for i in range(200, 600) if lm.held_out(i)][: 2 * len({w for t in texts for w in t.split()}) + 3]
    known = sorted({w for t in texts for w in t.split()})
    probe = [f"w0 {w}" for w in known] + ["w0 unseen", "w0"]
    rows = list(zip(train, texts)) + list(zip(test, probe + known + ["unseen"]))
    got = {r.doc_id: r.score for r in lm.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = dict(zip(probe + known + ["unseen"], [got[i] for i in test]))
    assert all(math.isfinite(x) and x < 0 for x in s.values())
    assert s["w0 w0"] > s["w0 unseen"] and s["w0 w1"] > s["w0 unseen"]


CONTRACT = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.trained(docs.select("doc_id", "text"))


def test_personal_data(docs, empty, tagger):
    text = TEXTS[10]
    assert pii.say(pii.base_spans(text)) == "email:11:37,phone:41:58,ip:63:74,card:80:99"
    assert list(pii.emails("a@b.c_d@e.f x@y")) == [(0, 5), (5, 11)] and pii.base_spans("999.1.1.1 1.2.3.4.5") == [(10, 1, 17)]
    got = by_id(pii.found(docs, tagger), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
    assert got[10][:4] == (1, 1, 1, 1) and got[0][:4] == (0, 0, 0, 0) and got[0][5] == "" and got[10][6] >= 4
    for i, t in enumerate(TEXTS):
        base = pii.say(pii.base_spans(t or ""))
        assert got[i if i != 3 else None][4] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i if i != 3 else None][5].split(","))
    assert pii.masked([text, None, ""], tagger) == ["mail me at <EMAIL> or <PHONE>, ip <IP> card <CARD>.", None, ""]
    assert pii.redacted(docs, tagger).columns == docs.columns and pii.redacted(docs, tagger).count() == docs.count()
    assert pii.redacted(empty, tagger).count() == 0


def test_base_spans_equal_the_stated_patterns():
    rng = np.random.default_rng(6)
    checks = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15]
    for signs in ("a@.-b 1", "0123456789. ", "12- 4", "+1(2). -3", "a1@.%+é\n"):
        for _ in range(600):
            t = "".join(rng.choice(list(signs), 60))
            want = sorted((m.start(), k, m.end()) for k, p in enumerate(CONTRACT) for m in re.finditer(p, t) if checks[k](m.group()))
            assert pii.base_spans(t) == want, t


def test_tagger_gradients():
    rng = np.random.default_rng(7)
    t = pii.Tagger()
    ids, tags = pii.training_windows(pii.made_up(100, rng), rng)
    small, y = ids[:3], tags[:3]
    _, g = t.gradients(small, y)
    for name, grad in g.items():
        at = tuple(np.array(grad.shape) // 2)
        old = t.p[name][at]
        t.p[name][at] = old + 1e-5
        up, _ = t.gradients(small, y)
        t.p[name][at] = old - 1e-5
        down, _ = t.gradients(small, y)
        t.p[name][at] = old
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)
    e, _ = t.emissions(ids[:20])
    assert np.abs(t.read(ids[:20]) - e.transpose(0, 2, 1)).max() < 1e-4


def test_tagger_finds_what_the_patterns_miss(tagger):
    """Items and sentences drawn anew; the network has seen neither."""
    rng = np.random.default_rng(1234)
    texts, want = zip(*(pii.with_item(t, rng) for t in pii.made_up(600, rng)))
    hit = total = right = said = 0
    for spans, (base, every) in zip(want, tagger.all_spans(list(texts))):
        missed = [s for s in spans if s not in base]
        total += len(missed)
        hit += sum(any(e[1] == s[1] and min(e[2], s[2]) - max(e[0], s[0]) >= 0.8 * (s[2] - s[0]) for e in every) for s in missed)
        more = [e for e in every if e not in base]
        said += len(more)
        right += sum(any(min(e[2], s[2]) > max(e[0], s[0]) for s in spans) for e in more)
    assert total > 150 and hit >= 0.9 * total and right >= 0.95 * said


def test_tagger_reads_every_window(tagger):
    rng = np.random.default_rng(2)
    plain = " ".join(pii.made_up(60, rng))
    item = "bob.smith (at) example (dot) com"
    for place in (0, 100, 190, 200, 208, 230, 250, 256, 400, 1500):
        text = plain[:place] + " " + item + " " + plain[place:]
        spans = tagger.spans([plain, text, "", item])[1]
        assert any(k == pii.EMAIL and s <= place + 1 and e >= place + 1 + len(item) - 2 for s, k, e in spans), place
        assert tagger.spans([text])[0] == spans


def test_quality_measures(docs, empty):
    def brute(t):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    got = by_id(quality.op7(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i if i != 3 else None: brute(t or "") for i, t in enumerate(TEXTS)}
    assert quality.op7(empty).count() == 0 and quality.kept_documents(docs).columns == docs.columns


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def test_quality_judges_by_the_documents_own_language(spark):
    """Texts under the wrong language go, quotations stay, and every one of 18 languages has its own model and band."""
    rng = np.random.default_rng(5)
    alphabets = [["".join(rng.choice(list("abcdefghij"), 3)) for _ in range(8)] for _ in range(18)]
    rows = [(100 * k + i, prose(rng, alphabets[k], 120), f"l{k:02}" if k else None) for k in range(18) for i in range(30)]
    wrong = [(10_000 + k, prose(rng, alphabets[(k + 4) % 18], 120), f"l{k:02}" if k else None) for k in range(18)]
    mixed = [(20_000 + k, prose(rng, alphabets[k], 60) + " " + prose(rng, alphabets[(k + 4) % 18], 60), f"l{k:02}" if k else None) for k in range(18)]
    d = spark.createDataFrame(rows + wrong + mixed, "doc_id long, text string, lang string").repartition(3)
    judge = quality.trained(d)
    assert set(judge.files) == {r[2] for r in rows} and len(judge.model("l17").logp) > quality.SYMBOLS
    kept = by_id(quality.op7(d), "kept")
    assert not any(kept[i][0] for i, _, _ in wrong) and all(kept[i][0] for i, _, _ in rows + mixed)
    assert {r.doc_id for r in quality.kept_documents(d).collect()} == {i for i, (k,) in kept.items() if k}


def test_quality_verdict_on_planted_junk(spark):
    rng = np.random.default_rng(6)
    syllables = ["er", "th", "an", "in", "on", "re", "ti", "es", "or", "nd"]
    rows = [(i, prose(rng, syllables, int(rng.integers(40, 400))), "en") for i in range(300)]
    for i in range(20):
        words = prose(rng, syllables, 60 + 10 * i).split()
        rows.append((1000 + i, " ".join(w + "$%|"[k % 3] if k % 10 == 0 else w for k, w in enumerate(words)), "en"))
        rows.append((2000 + i, " ".join("".join(rng.permutation(list(w))) if k % 4 == 0 else w for k, w in enumerate(words)), "en"))
    kept = by_id(quality.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "kept")
    assert sum(kept[i][0] for i in range(300)) >= 299 and sum(k for i, (k,) in kept.items() if i >= 1000) <= 8


class KneserNey:
    """Modified Kneser-Ney of order three over symbols, in plain dictionaries."""

    def __init__(self, texts):
        c3 = collections.Counter()
        for t in texts:
            s = [0, 0, *(int(quality.SYMBOL[b]) for b in t.encode())]
            c3.update(zip(s, s[1:], s[2:]))
        self.c = [collections.Counter(g[2:] for g in {g[1:] for g in c3}), collections.Counter(g[1:] for g in c3), c3]
        # order one counts the different symbols before in the pairs
        self.c[0] = collections.Counter(g[1:] for g in self.c[1])
        self.d = []
        for c in self.c[1:]:
            n = [0, *(max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))]
            y = n[1] / (n[1] + 2 * n[2])
            raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
            self.d.append([0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw))])

    def p(self, g):
        if len(g) == 1:
            return (self.c[0][g] + 1) / (sum(self.c[0].values()) + quality.SYMBOLS)
        c, d = self.c[len(g) - 1], self.d[len(g) - 2]
        own = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not own:
            return self.p(g[1:])
        left = sum(d[min(v, 3)] for v in own) / sum(own)
        return (c[g] - d[min(c[g], 3)]) / sum(own) + left * self.p(g[1:])

    def log_ppl(self, t):
        s = [0, 0, *(int(quality.SYMBOL[b]) for b in t.encode())]
        return -sum(math.log10(self.p(g)) for g in zip(s, s[1:], s[2:])) / max(1, len(s) - 2)


def test_perplexity_equals_a_plain_model(spark):
    rng = np.random.default_rng(3)
    texts = [prose(rng, ["er", "th", "an", "Ön", "re. "], int(rng.integers(0, 30))) for _ in range(40)] + ["x", "", "zq9 zq9"]
    model = KneserNey(texts)
    got = by_id(quality.op7(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)), "log_ppl")
    for i, t in enumerate(texts):
        assert got[i][0] == pytest.approx(model.log_ppl(t), abs=1e-5)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, quality.SYMBOLS**3, 4000))
    model = quality.Model.counted(keys, rng.integers(1, 9, len(keys)))
    contexts = np.r_[keys[:50] // quality.SYMBOLS, 1, 2, 3]
    logs = model.logs((contexts[:, None] * quality.SYMBOLS + np.arange(quality.SYMBOLS)).ravel()).reshape(len(contexts), -1)
    assert np.allclose((10.0**logs).sum(1), 1, atol=1e-4)
    again = quality.Model.unpacked(model.packed())
    assert (again.logs(keys) == model.logs(keys)).all()


def test_quality_tells_letters_beyond_ascii_apart(spark):
    """Junk whose letters differ from those of clean texts in one bit of a byte goes."""
    assert len(set(quality.SYMBOL.tolist())) == 256 - 5 - 9 - 25 == quality.SYMBOLS and len(set(quality.SYMBOL[128:])) == 128
    rng = np.random.default_rng(8)
    alphabets = {"zh": ["你好", "我们", "中国", "学生", "今天"], "ru": ["сто", "на", "ко", "го", "при"]}
    flips = [bytes(f) for f in ([0, 0, 0], [0, 32, 0], [0, 0, 32], [0, 32, 32])]
    rows, junk = [], []
    for x, (name, syllables) in enumerate(alphabets.items()):
        other = {c: [bytes(a ^ f for a, f in zip(c.encode(), flip)).decode() for flip in flips[: 2 ** (len(c.encode()) - 1)]] for c in "".join(syllables)}
        rows += [(1000 * x + k, prose(rng, syllables, 200), name) for k in range(200)]
        junk += [(9000 + i, "".join(rng.choice(other.get(c, [c])) for c in t), name) for i, t, _ in rows[-10:]]
    kept = by_id(quality.op7(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(3)), "kept")
    assert all(kept[i][0] for i, _, _ in rows) and not any(kept[i][0] for i, _, _ in junk) and len(kept) == 420


def test_quality_holds_models_within_bounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    d = spark.createDataFrame([(k, prose(rng, ["er", "th", "an"], 30), f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    judge = quality.trained(d)
    sizes = {name: len(judge.model(name).logp) for name in judge.files}
    monkeypatch.setattr(quality, "ENTRIES", 2 * max(sizes.values()))
    judge._models.clear()
    for name in [*judge.files, *judge.files]:
        assert len(judge.model(name).logp) == sizes[name] and 1 <= len(judge._models) <= 2


def test_quality_columns_may_clash(spark):
    rows = [(1, prose(np.random.default_rng(1), ["er", "th", "an"], 60), "en", "x", 2.5, "y"), (2, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, log_ppl double, __own string")
    assert quality.kept_documents(d).columns == d.columns and [r.doc_id for r in quality.kept_documents(d).collect()] == [1]


def test_mixing_targets_and_rounding(spark, docs, empty):
    rows = [(i, "w " * (1 + i * 7919 % 90), f"s{0 if i % 3 == 0 else i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r.doc_id: r for r in mixing.op8(df).collect()}
    b = {r.doc_id: r for r in mixing.op8(df.repartition(7)).collect()}
    assert {i: r.taken for i, r in a.items()} == {i: r.taken for i, r in b.items()}
    sizes, weights = collections.Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(t.split())
    target, total = {}, sum(sizes.values())
    for k, s in enumerate(sorted(sizes)):
        weights[s] = (5, 2, 1)[k % 3]
    while True:
        free = [s for s in sizes if s not in target]
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
    taken = collections.Counter()
    for i, t, s in rows:
        assert a[i].size == len(t.split()) and a[i].source_size == sizes[s] and a[i].target == pytest.approx(target[s]) and a[i].taken <= 3 * a[i].size
        taken[s] += a[i].taken
    assert all(abs(taken[s] - target[s]) <= 91 for s in sizes)
    got = mixing.op8(docs.select("doc_id", "text", "source"))
    assert got.count() == len(TEXTS) + 1 and mixing.op8(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_pivotal_rounding_keeps_odds(spark):
    """Over many sources each document of one kind is taken about as often as its fraction says."""
    items = [(f"s{k}", j, float(1 + j)) for k in range(400) for j in range(5)]
    df = spark.createDataFrame(items, "source string, doc_id long, size double").selectExpr("source", "doc_id", "xxhash64(source, doc_id) ident", "xxhash64(source, doc_id, 5) k", "size", "size * 0.3 mass", "0L gid")
    r = mixing.fold(df, "t").select("source", F.explode("r.out").alias("d")).select("source", "d.*").collect()
    up = np.mean([x.up for x in r])
    open_ = 400 * 5 - len(r)
    assert open_ == 400 and 0.2 < up < 0.4


def test_urls(spark, empty):
    p = spark.createDataFrame([(1, "https://A.Example.com/en/71?q", "h"), (2, None, "h"), (3, "x", "h"), (4, "http://a.example.net/de/8x", "h"), (5, "http://net/de/1", "h"), (6, "http://q.org/fr/1", "h"), (6, "http://q.org/fr/1", "h")], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.op10(p).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("", "", None) and got[3].verdict == got[2].verdict == "allow"
    assert (got[4].rule, got[4].verdict) == ("example.net/de/8", "block") and got[5].verdict == "allow" and urls.op10(p).count() == 7
    none = spark.createDataFrame([], p.schema)
    assert urls.op10(none).count() == 0 and urls.op10(p.where("page_id = 2")).count() == 1


def test_string_kernel():
    def brute(a, b, d=0.5):
        return sum(d ** (max(i) - min(i) + 1 + max(j) - min(j) + 1) for i in tri(len(a)) for j in tri(len(b)) if all(a[x] == b[y] and a[x] for x, y in zip(i, j)))

    def tri(n):
        from itertools import combinations

        return list(combinations(range(n), 3))

    a = toxicity.rows_of([b"idiot", b"i.d-iot", b"rrrr"])
    k = toxicity.kernel(a, a)
    assert np.allclose(k, [[brute(x, y) for y in a] for x in a], rtol=1e-5) and np.allclose(np.diag(k), toxicity.own_kernel(a))
    beta = np.array([0.3, -0.2, 0.5])
    x = toxicity.rows_of([b"idxiot", b"errors"])
    want = k_norm(x, a) @ beta
    assert np.allclose(toxicity.Scorer(toxicity.collapsed(a, beta), 0.0).decide(x), want, rtol=1e-4)


def k_norm(x, a):
    return toxicity.kernel(x, a) / np.sqrt(toxicity.own_kernel(x))[:, None] / np.sqrt(toxicity.own_kernel(a))[None]


def test_toxicity_learns_and_tolerates_gaps(spark, docs, empty):
    rng = np.random.default_rng(3)
    syllables = ["er", "th", "an", "in", "on", "re", "ti", "es", "or", "nd"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bad, rows, labels = ["idiot", "moron", "clown"], [], []
    for i in range(600):
        w = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[int(rng.integers(40))] = bad[int(rng.integers(3))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, "than the i.d.i.o.t there"), (1001, "than the i d i o t there"), (1002, "the idxiot ener"), (1003, "the of in there")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.op1(d, lab), "held_out", "score", "predicted")
    wrong = sum(got[i][2] != y for i, y in labels if got[i][0])
    assert wrong <= 4 and got[1000][2] == got[1001][2] == 1 and got[1003][2] == 0 and got[1002][1] > got[1003][1]
    assert toxicity.op1(docs, lab).count() == len(TEXTS) + 1 and toxicity.op1(empty, lab).count() == 0 and toxicity.op1(d, lab.where("toxic = 2")).count() == len(rows)


def test_toxicity_bears_noise_in_clean_labels(spark):
    """Every insult is also in one clean document in fifty."""
    rng = np.random.default_rng(9)
    syllables, bad = ["er", "th", "an", "in", "on", "re", "ti", "es", "or", "nd"], ["idiot", "moron", "clown"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, syllables, 40).split()
        if i % 5 == 0 or i % 50 == 1:
            w[int(rng.integers(40))] = bad[i // 5 % 3 if i % 5 == 0 else i // 50 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    got = by_id(toxicity.op1(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")), "held_out", "predicted")
    wrong = [i for i, y in labels if got[i][0] and got[i][1] != y and i % 50 != 1]
    assert len(wrong) <= 6


def test_toxicity_weighs_a_second_unit(spark):
    """A word that clean texts hold once, and toxic ones twice or more, is toxic only with a second one apart from it."""
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, ["er", "th", "an", "in", "on", "re", "ti", "es", "or", "nd"], 60).split()
        for at in rng.choice(60, 3 if i % 5 == 0 else int(i % 5 == 1), replace=False).tolist():
            w[at] = "achlich"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    got = by_id(toxicity.op1(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")), "held_out", "predicted")
    assert sum(got[i][1] != y for i, y in labels if got[i][0]) <= 4


def test_toxicity_sentences_and_two_most_toxic_units():
    assert toxicity.sentences_of("One word. two! i d i o t\nfour") == [[b"one", b"word"], [b"two"], [b"idiot"], [b"four"]]
    assert toxicity.sentences_of(None) == toxicity.sentences_of("...") == []
    scorer = toxicity.Scorer(toxicity.collapsed(toxicity.rows_of([b"idiot"]), np.array([1.0])), 0.0)
    texts = [b"idiot and idiot", b"idiot and", b"", b"xidiotx"]
    top = scorer.most(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(top[0], 1, atol=1e-4) and top[1, 0] > 0.99 and top[1, 1] < 0.2 and (top[2] == -1).all() and 0.5 < top[3, 0] < 1 and top[3, 1] == -1


def test_pipeline_columns(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(200, None, None, None, None), (201, "ip 10.20.30.40 " + " ".join(rng.choice(words, 60)), "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = cp.keep_quality(spark, docs, "")
    lone = cp.drop_near_copies(spark, kept, "")
    assert lone.columns == kept.columns == docs.columns and lone.count() == kept.count() - 10
    assert "<IP>" in cp.mask_personal_data(spark, lone, "").where("doc_id = 201").first().text
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 0 and [n for n, _ in cp.STAGES] == ["quality", "near_copies", "personal_data", "mixing", "tokens"]


def test_near_copies_with_null_and_shared_ids(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(11)
    x, y, u, v = (prose(rng, ["er", "th", "an", "in", "on"], 60) for _ in range(4))
    rows = [(1, x, "a"), (2, x, "a"), (2, y, "a"), (None, u, "a"), (None, v, "a"), (None, v, "b"), (3, u, None), (None, x, "a"), (2, y, "a")]
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 4 and {(1, x, "a"), (2, y, "a"), (3, u, None)} < set(kept) and [t for i, t, _ in kept if i is None] == [v]
