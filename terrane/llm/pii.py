"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF.

The patterns (email, ip, card, phone) give the base spans. The network reads every text
whole, in windows of ``WINDOW`` characters, ``STRIDE`` apart, and scores for each character
the tags outside, begin and inside of each kind. Where windows overlap, their scores are
averaged by the distance from the windows' ends; characters for which outside leads by
``LEAD`` or more, in all windows, are outside, and one Viterbi pass over each stretch of
the others, ``PAD`` characters wider on both sides, reconciles all windows that touch.
Spans of the network that overlap a base span are dropped; base spans stay as they are.
The network also marks secrets (keys, tokens, passwords), a kind that has no pattern.

A span of the network must pass its kind's check, which says nothing of its layout: it
doesn't begin or end within a word; a card has 12 to 19 digits and a Luhn sum, an address
four numbers up to 255, a phone 9 to 15 digits, an email an at and a dot, as signs or
words, and a secret 8 characters with a digit.

The network is trained in numpy (back-propagation through time, CRF likelihood, Adam)
from labelled spans: up to ``WINDOWS`` windows round the base spans of up to ``SAMPLE``
documents with digits or @, and from anywhere in ``SAMPLE`` others, drawn by hashes from all
of both, as they are; and the same with items set in: of all kinds, in many forms that the patterns miss, as
labelled spans, and other numbers, dates, versions and the like, as unlabelled ones.
Made-up sentences fill these windows up to ``TEXTS``.

Edge cases: null and empty texts have no spans; repeated rows come out once each; an
empty table gives an empty result (its tagger learns from made-up text alone); texts are
read whole, in time proportional to length; null ids are never drawn for training.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.runtime import small_batches, written

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
WINDOW, STRIDE, LEAD, PAD, ROWS = 256, 208, 1.0, 48, 1024
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 12, 10, 20, 128, 0.025
SAMPLE, WINDOWS, TEXTS, NEAR, STEPS, VARIANTS = 400, 800, 1400, 60, 88, 4
TAGS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOLDS = re.compile(r"[0-9@]")  # every base span has one
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if found:
            yield start, found.end()
            done = at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    for kind, pattern, fits in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if fits(m.group())]
    return sorted(out)


_SIGNS = "@.-+()[]_%:/=\"'#,{}<>*&$!?;|~"
#: Classes of characters: 0 padding, 1 to 26 ASCII letters, then the digits, a space, other white space, the signs, other letters, others.
DIGIT, SPACE, BLANK, SIGN = 27, 37, 38, 39
INPUTS = SIGN + len(_SIGNS) + 2


def _class(c: str) -> int:
    if "a" <= c.lower() <= "z":
        return ord(c.lower()) - 96
    if "0" <= c <= "9":
        return DIGIT + int(c)
    return SPACE if c == " " else BLANK if c.isspace() else SIGN + _SIGNS.index(c) if c in _SIGNS else INPUTS - 1


_NARROW = np.array([_class(chr(c)) for c in range(128)] + [INPUTS - 2 if chr(c).isalpha() else INPUTS - 1 for c in range(128, 0x250)] + [INPUTS - 1], np.uint8)


def char_classes(text: str) -> np.ndarray:
    return _NARROW[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x250)]


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of both directions (steps, 2, rows, HIDDEN) for inputs (steps, 2, rows, EMBED), and what going back needs."""
    steps, _, rows, _ = x.shape
    gates = x @ w[:, :EMBED] + b[:, None]
    u = w[:, EMBED:]
    h = np.zeros((steps + 1, 2, rows, HIDDEN), x.dtype)  # h[0], c[0]: before the first
    c, tc = np.zeros_like(h), np.zeros_like(h)
    for t in range(steps):
        g = gates[t]
        g += h[t] @ u
        s = g[..., : 3 * HIDDEN]
        s *= 0.5
        np.tanh(g, out=g)
        s += 1
        s *= 0.5
        np.multiply(g[..., HIDDEN : 2 * HIDDEN], c[t], out=c[t + 1])
        c[t + 1] += g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
        np.tanh(c[t + 1], out=tc[t + 1])
        np.multiply(g[..., 2 * HIDDEN : 3 * HIDDEN], tc[t + 1], out=h[t + 1])
    return h[1:], (x, gates, h, c, tc)


def lstm_back(dh_out: np.ndarray, kept: tuple, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and offsets."""
    x, gates, h, c, tc = kept
    steps, _, rows, _ = x.shape
    i, f, o, u = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
    tc = tc[1:]
    # of each gate's argument, but for the factor that runs back through the steps
    by_cell = np.concatenate([u * i * (1 - i), c[:-1] * f * (1 - f), i * (1 - u * u)], 3)
    by_state, to_cell = tc * o * (1 - o), o * (1 - tc * tc)
    dg = np.empty_like(gates)
    back = np.ascontiguousarray(w[:, EMBED:].transpose(0, 2, 1))
    dh, dc = np.zeros_like(h[0]), np.zeros_like(h[0])
    for t in range(steps - 1, -1, -1):
        dh += dh_out[t]
        dc += dh * to_cell[t]
        d = dg[t]
        np.multiply(np.concatenate([dc, dc], 2), by_cell[t, ..., : 2 * HIDDEN], out=d[..., : 2 * HIDDEN])
        np.multiply(dh, by_state[t], out=d[..., 2 * HIDDEN : 3 * HIDDEN])
        np.multiply(dc, by_cell[t, ..., 2 * HIDDEN :], out=d[..., 3 * HIDDEN :])
        dh = d @ back
        dc *= f[t]
    flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, steps * rows, -1)
    d = flat(dg)
    dw = np.concatenate([flat(x).transpose(0, 2, 1) @ d, flat(h[:-1]).transpose(0, 2, 1) @ d], 1)
    return dg @ w[:, :EMBED].transpose(0, 2, 1), dw, d.sum(1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _onward(x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """log of exp(x) @ move."""
    m = x.max(1, keepdims=True)
    return m + np.log(np.exp(x - m) @ move)


class Tagger:
    """Parameters of the network, its training and its decoding."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = EMBED + HIDDEN
        self.p = {
            "embed": rng.normal(0, 0.3, (INPUTS, EMBED)), "w": rng.normal(0, n**-0.5, (2, n, 4 * HIDDEN)), "b": np.zeros((2, 4 * HIDDEN)),
            "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, HIDDEN : 2 * HIDDEN] = 1
        self._fast = None

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (steps, rows, tags) of windows of classes (rows, steps)."""
        x = self.p["embed"][ids.T]
        h, kept = lstm(np.stack([x, x[::-1]], 1), self.p["w"], self.p["b"])
        h = np.concatenate([h[:, 0], h[::-1, 1]], 2)
        return h @ self.p["out"] + self.p["bo"], (h, kept)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of the CRF's likelihood and that of each character's tag alone, which lets plain text be told by its own scores."""
        e, (h, kept) = self.emissions(ids)
        move, y = self.p["move"], tags.T
        steps, rows = y.shape
        step = np.exp(move)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _onward(alpha[t - 1], step)
        for t in range(steps - 2, -1, -1):
            beta[t] = _onward(e[t + 1] + beta[t + 1], step.T)
        z, alone = _lse(alpha[-1], 1), _lse(e, 2)
        de = np.exp(alpha + beta - z[:, None]) + np.exp(e - alone[:, :, None])
        gold = np.zeros_like(e)
        np.put_along_axis(gold, y[:, :, None], 1, 2)
        de -= 2 * gold
        a, b = alpha[:-1], (e + beta)[1:]
        ma, mb = a.max(2, keepdims=True), b.max(2, keepdims=True)
        a = np.exp(a - ma + (ma + mb - z[:, None])).reshape(-1, TAGS)
        pairs = step * (a.T @ np.exp(b - mb).reshape(-1, TAGS)) - gold[:-1].reshape(-1, TAGS).T @ gold[1:].reshape(-1, TAGS)
        loss = z.sum() + alone.sum() - 2 * (gold * e).sum() - move[y[:-1], y[1:]].sum()
        de /= rows
        dh = de @ self.p["out"].T
        dx, dw, db = lstm_back(np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], 1), kept, self.p["w"])
        dx = (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBED)
        at = np.zeros((INPUTS, dx.shape[0]), dx.dtype)
        at[ids.T.ravel(), np.arange(dx.shape[0])] = 1
        out = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        return float(loss) / rows, {"embed": at @ dx, "w": dw, "b": db, "out": out, "bo": de.sum((0, 1)), "move": pairs / rows}

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        self._fast = None
        rng, losses, step = np.random.default_rng(3), [], 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        last = epochs * -(-len(ids) // BATCH) + 1
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for k in range(0, len(ids), BATCH):
                own = order[k : k + BATCH]
                loss, g = self.gradients(ids[own], tags[own])
                total += loss * len(own)
                step += 1
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    a, b = m[name]
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    self.p[name] -= RATE * (1 - step / last) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(ids))
        return losses

    def fast(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Single-precision weights for reading: for each direction the gates' inputs by class and the recurrent
        weights, gates in rows; the output's. A sigmoid is half of one and the tanh of half its argument: the halves
        of arguments and of hidden states are in the weights, so that reading needs one tanh and one addition a gate."""
        scale = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]
        ways = []
        for w, b in zip(self.p["w"] * scale, self.p["b"] * scale):
            ways.append(((self.p["embed"] @ w[:EMBED] + b).T.astype(np.float32).copy(), (w[EMBED:] / 2).T.astype(np.float32).copy()))
        return ways, (self.p["out"] / 2).T.astype(np.float32).copy(), self.p["bo"].astype(np.float32)

    def read(self, ids: np.ndarray) -> np.ndarray:
        """emissions(ids), as (steps, tags, rows) in single precision."""
        if self._fast is None:
            self._fast = self.fast()
        ways, out, bo = self._fast
        steps, rows = ids.shape[1], len(ids)
        at = np.ascontiguousarray(ids.T)
        e = np.broadcast_to(bo[:, None], (steps, TAGS, rows)).copy()
        hidden = np.empty((steps, HIDDEN, rows), np.float32)
        g, m, tmp = np.empty((4 * HIDDEN, rows), np.float32), np.empty((4 * HIDDEN, rows), np.float32), np.empty((HIDDEN, rows), np.float32)
        for way, (table, w) in enumerate(ways):
            h, c = np.zeros((HIDDEN, rows), np.float32), np.zeros((HIDDEN, rows), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(table, at[t], axis=1, out=g, mode="clip")
                np.matmul(w, h, out=m)
                g += m
                np.tanh(g, out=g)
                gates = g[: 3 * HIDDEN]
                gates += 1
                c *= g[HIDDEN : 2 * HIDDEN]
                np.multiply(g[:HIDDEN], g[3 * HIDDEN :], out=tmp)
                c += tmp
                c *= 0.5
                np.tanh(c, out=tmp)
                h = hidden[t]
                np.multiply(tmp, g[2 * HIDDEN : 3 * HIDDEN], out=h)
            e += np.matmul(out[:, way * HIDDEN : (way + 1) * HIDDEN], hidden)
        return e

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, kind, end) that the network finds and that pass the checks."""
        lens = np.array([len(t) for t in texts], np.int64)
        offs = np.r_[0, np.cumsum(lens)]
        classes = np.r_[char_classes("".join(texts)), np.zeros(WINDOW, np.uint8)]
        n = np.where(lens > 0, 1 + np.maximum(0, -(-(lens - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(texts)), n)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE

        def of(rows: np.ndarray) -> np.ndarray:
            at = start[rows][:, None] + np.arange(WINDOW)
            inside = at < lens[text[rows]][:, None]
            return np.where(inside, classes[offs[text[rows]][:, None] + np.where(inside, at, 0)], 0)

        flagged = np.zeros(len(text), bool)
        by_size = np.argsort(-np.minimum(WINDOW, lens[text] - start), kind="stable")
        for k in range(0, len(text), ROWS):
            rows = by_size[k : k + ROWS]
            size = int(min(WINDOW, (lens[text] - start)[rows[0]]))
            e = self.read(of(rows)[:, :size])
            flagged[rows] = (e[:, 1:].max(1) - e[:, 0] > -LEAD).any(0)
        near = flagged.copy()
        near[:-1] |= flagged[1:] & (text[1:] == text[:-1])
        near[1:] |= flagged[:-1] & (text[1:] == text[:-1])
        near = np.flatnonzero(near)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        for k in range(0, len(near), ROWS):  # a block, and a window more on both sides; spans belong to the block they begin in
            block = near[max(0, k - 1) : k + ROWS + 1]
            e = self.read(of(block)).transpose(2, 0, 1)
            joins = (np.diff(block) == 1) & (text[block[1:]] == text[block[:-1]])
            heads = np.r_[0, np.flatnonzero(~joins) + 1, len(block)].tolist()
            pieces: list[tuple[int, int, np.ndarray]] = []
            for a, b in zip(heads, heads[1:]):
                own, low = int(text[block[a]]), int(start[block[a]])
                high = int(min(lens[own], start[block[b - 1]] + WINDOW))
                total, by = np.zeros((int(start[block[b - 1]]) - low + WINDOW, TAGS), np.float32), np.zeros((int(start[block[b - 1]]) - low + WINDOW, 1), np.float32)
                for j in range(a, b):
                    at = int(start[block[j]]) - low
                    total[at : at + WINDOW] += e[j] * weight
                    by[at : at + WINDOW] += weight
                mean = total[: high - low] / by[: high - low]
                open_ = np.flatnonzero(mean[:, 1:].max(1) - mean[:, 0] > -LEAD)
                if len(open_):
                    cut = np.flatnonzero(np.diff(open_) > 2 * PAD)
                    for s, t in zip(open_[np.r_[0, cut + 1]].tolist(), open_[np.r_[cut, len(open_) - 1]].tolist()):
                        pieces.append((own, low + max(0, s - PAD), mean[max(0, s - PAD) : t + PAD + 1]))
            first = (int(text[near[k]]), int(start[near[k]])) if k else (0, 0)
            beyond = (int(text[near[k + ROWS]]), int(start[near[k + ROWS]])) if k + ROWS < len(near) else (len(texts), 0)
            for (own, low, _), tags in zip(pieces, self.decoded([p[2] for p in pieces])):
                for t in np.flatnonzero(tags % 2).tolist():  # only a begin tag, odd, opens a span
                    kind, end = int(tags[t]) // 2, t + 1
                    while end < len(tags) and tags[end] == 2 * kind + 2:
                        end += 1
                    if first <= (own, low + t) < beyond and passes(kind, texts[own], low + t, low + end):
                        found[own].append((low + t, kind, low + end))
        return [sorted(set(f)) for f in found]

    def decoded(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths, many stretches of like length at once; a stretch is outside beyond its ends."""
        move, out = self.p["move"].astype(np.float32), [np.zeros(0, np.int64)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        for k in range(0, len(order), 256):
            own = order[k : k + 256]
            steps = len(stretches[own[-1]]) + 1
            e = np.full((steps, len(own), TAGS), -1e4, np.float32)
            e[:, :, 0] = 0
            for j, i in enumerate(own):
                e[: len(stretches[i]), j] = stretches[i]
            back = np.zeros((steps, len(own), TAGS), np.int8)
            score = e[0] + move[0]
            for t in range(1, steps):
                reach = score[:, :, None] + move
                back[t] = reach.argmax(1)
                score = reach.max(1) + e[t]
            path = np.empty((steps, len(own)), np.int64)
            path[-1] = score.argmax(1)
            for t in range(steps - 1, 0, -1):
                path[t - 1] = back[t, np.arange(len(own)), path[t]]
            for j, i in enumerate(own):
                out[i] = path[: len(stretches[i]), j]
        return out

    def all_spans(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """For each text its base spans, and all spans."""
        texts = [t or "" for t in texts]
        out = []
        for text, more in zip(texts, self.spans(texts)):
            base = base_spans(text) if _HOLDS.search(text) else []
            out.append((base, sorted(base + [s for s in more if all(s[2] <= b[0] or s[0] >= b[2] for b in base)]) if more else base))
        return out


#: An at, then a dot with something on both sides, as signs or words.
_ADDRESS = re.compile(r"(?is)(?:@|[(\[]at[)\]]|\sat\s).*[^\s.]\s?(?:\.|[(\[]dot[)\]]|\sdot\s)\s?[a-z0-9]")


def passes(kind: int, text: str, start: int, end: int) -> bool:
    """The checks of a span of the network."""
    s = text[start:end]
    if (start and text[start - 1].isalnum() and s[0].isalnum()) or (end < len(text) and text[end].isalnum() and s[-1].isalnum()):
        return False
    if kind == EMAIL:
        return _ADDRESS.search(s) is not None and s[0].isalnum() and s[-1].isalnum()
    if kind == IP:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == CARD:
        return _is_card(s)
    if kind == PHONE:
        return _is_phone(s)
    return len(s) >= 8 and not any(c.isspace() for c in s) and any(c.isdigit() for c in s)


def _letters(rng: np.random.Generator, low: int, high: int) -> str:
    return "".join(rng.choice(list("aeinorstlhdbcumpgkwvy"), rng.integers(low, high)))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _one(rng: np.random.Generator, *of: str) -> str:
    return of[rng.integers(len(of))]


def _card_digits(rng: np.random.Generator, n: int) -> str:
    d = _one(rng, "4", "5", "3", "6") + _number(rng, n - 2)
    return d + next(c for c in "0123456789" if luhn(d + c))


def _grouped(d: str, sizes: tuple[int, ...], sep: str) -> str:
    at = np.cumsum((0, *sizes)).tolist()
    return sep.join(d[a:b] for a, b in zip(at, at[1:]))


def email_form(rng: np.random.Generator) -> str:
    name = _letters(rng, 2, 9) + _one(rng, "", ".", "_", "-") * 1 + _one(rng, _letters(rng, 2, 7), _number(rng, 2), _letters(rng, 3, 6))
    host = [_letters(rng, 3, 9) + _one(rng, "", _number(rng, 1)), *([_letters(rng, 3, 8)] if rng.random() < 0.5 else []), _one(rng, "com", "org", "net", "de", "example", "info", "fr", "es")]
    at, dot = [("@", "."), (" @ ", "."), (" @ ", " . "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", " dot "), ("@", " dot ")][rng.integers(11)]
    s = name + at + dot.join(host)
    return s.upper() if rng.random() < 0.15 else s


def ip_form(rng: np.random.Generator) -> str:
    sep = _one(rng, ".", " . ", ". ", " .", "[.]", "[dot]", " dot ", ", ", ":", "(.)")
    return sep.join(str(x) for x in rng.integers(0, 256, 4))


def card_form(rng: np.random.Generator) -> str:
    sep = _one(rng, " ", "-", ".", "/", " - ", "  ", ",", "_", "")
    n = int(rng.choice([15, 16, 16, 16, 19]))
    return _grouped(_card_digits(rng, n), {15: (4, 6, 5), 16: (4, 4, 4, 4), 19: (4, 4, 4, 4, 3)}[n], sep)


def phone_form(rng: np.random.Generator) -> str:
    sep = _one(rng, " ", "-", ".", "/", " - ")
    return [
        lambda: f"({_number(rng, 3)}) {_number(rng, 3)}{_one(rng, '-', ' ', '.')}{_number(rng, 4)}", lambda: _grouped(_number(rng, 10), (3, 3, 4), sep),
        lambda: "0" + _grouped(_number(rng, 10), (2, 4, 4), sep), lambda: "00" + _grouped(_number(rng, 12), (2, 2, 4, 4), sep), lambda: _grouped(_number(rng, 10), (3, 3, 2, 2), _one(rng, " ", "-", "/")),
        lambda: "0" + _grouped(_number(rng, 9), (1, 2, 2, 2, 2), _one(rng, " ", "-")), lambda: f"+{_grouped(_number(rng, 12), (2, 3, 3, 4), sep)}", lambda: f"+{_number(rng, 1)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}",
        lambda: f"1{sep}{_grouped(_number(rng, 10), (3, 3, 4), sep)}", lambda: f"0{_number(rng, 3)}{_one(rng, '/', '-', ' ')}{_number(rng, 7)}",
    ][rng.integers(10)]()


def secret_form(rng: np.random.Generator) -> tuple[str, str, str]:
    """What stands before it, the secret, and what stands after."""
    signs = _one(rng, "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    value = "".join(rng.choice(list(signs), int(rng.choice([12, 18, 20, 24, 32, 40, 48]))))
    value = value[:-1] + _number(rng, 1)
    if rng.random() < 0.3:
        return "", _one(rng, "AKIA", "ghp_", "sk-", "xoxb-") + value, ""
    quote = _one(rng, '"', "'", "")
    return _one(rng, "token", "password", "api_key", "secret", "passwd", "key", "auth_token", "TOKEN", "PASSWORD") + _one(rng, " = ", "=", ": ", ":") + quote, value, quote


def other_form(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    n = lambda k: _number(rng, k)
    return [
        lambda: f"20{n(2)}-{n(2)}-{n(2)}", lambda: f"{n(2)}.{n(2)}.20{n(2)}", lambda: f"{n(2)}:{n(2)}:{n(2)}", lambda: f"20{n(2)}-{n(2)}-{n(2)} {n(2)}:{n(2)}:{n(2)}", lambda: f"version {n(1)}.{n(1)}.{n(2)}", lambda: f"{n(1)}.{n(1)}",
        lambda: f"{n(1)},{n(3)},{n(3)},{n(3)}", lambda: f"{n(4)}", lambda: f"{n(int(rng.integers(1, 9)))}", lambda: f"{n(4)}-{n(4)}", lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"#{n(6)}", lambda: f"${n(3)}.{n(2)}", lambda: f"{n(2)} %",
        lambda: " ".join(str(rng.integers(10, 99)) for _ in range(int(rng.integers(2, 5)))), lambda: " ".join("19" + n(2) for _ in range(int(rng.integers(2, 6)))), lambda: f"{n(int(rng.integers(9, 20)))}", lambda: f"order {n(10)}", lambda: f"section {n(1)}.{n(1)}.{n(1)}",
        lambda: f"@{_letters(rng, 3, 9)}", lambda: f"{_letters(rng, 3, 9)}.{_letters(rng, 2, 4)}", lambda: f"https://www.{_letters(rng, 3, 9)}.com/{_letters(rng, 3, 9)}/{n(3)}", lambda: "at home", lambda: "the dot is at the end", lambda: f"{_letters(rng, 2, 6)}={_letters(rng, 3, 12)}",
        lambda: f"{_letters(rng, 5, 30)}{_letters(rng, 5, 30)}", lambda: f"key: {_letters(rng, 3, 9)}", lambda: f"at {n(1)}.{n(2)}", lambda: f"CC BY {n(1)}.{n(1)}.", lambda: "_" * 12, lambda: "=" * 9,
    ][rng.integers(31)]()


FORMS: tuple[Callable[[np.random.Generator], str], ...] = (email_form, ip_form, card_form, phone_form)
_SECRET = re.compile(r"(?i)(?:token|password|secret|api_key)\"?\s*[=:]\s*[\"']?([0-9A-Za-z_+/-]{12,})|\b(AKIA[0-9A-Z]{12,})")


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Spans of a training text: the patterns', and secrets behind their names."""
    own = base_spans(text)
    more = [(m.start(m.lastindex), SECRET, m.end(m.lastindex)) for m in _SECRET.finditer(text)]
    return sorted(own + [s for s in more if all(s[2] <= b[0] or s[0] >= b[2] for b in own)])


def with_item(text: str, rng: np.random.Generator, forms: tuple = FORMS) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with an item or some other number set in between two words, and its spans."""
    gaps = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)] or [len(text)]
    spans = labelled(text)
    gaps = [g for g in gaps if not any(s < g < e for s, _, e in spans)] or [len(text)]
    at = gaps[rng.integers(len(gaps))] if rng.random() < 0.9 else int(_one(rng, "0", str(len(text))))
    kind = int(rng.integers(0, len(KINDS) + 3))
    before, item, after = ("", forms[kind](rng), "") if kind < len(forms) else secret_form(rng) if kind == SECRET else ("", other_form(rng), "")
    before = (_one(rng, " ", " ", " ", ": ", " (", "\n") if at else "") + before
    after += _one(rng, " ", " ", ". ", ", ", ") ", "\n", "!! ", "%%% ")
    new = text[:at] + before + item + after + text[at:].lstrip(" ")
    own = [] if kind >= len(KINDS) else [(at + len(before), kind, at + len(before) + len(item))]
    shift = len(new) - len(text)
    return new, sorted(own + [(s, k, e) if e <= at else (s + shift, k, e + shift) for s, k, e in spans])


def made_up(n: int, rng: np.random.Generator) -> list[str]:
    """Sentences of made-up words."""
    return [" ".join([_letters(rng, 1, 10), *(_letters(rng, 1, 10) for _ in range(int(rng.integers(4, 20))))]) + _one(rng, ".", "", "!") for _ in range(n)]


def training_windows(texts: list[str], rng: np.random.Generator, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """Windows of STEPS classes and their tags: texts as they are, and with items set in."""
    ids, tags = [], []
    for text in texts:
        for new, spans in [(text, labelled(text)), *(with_item(text, rng) for _ in range(variants))]:
            x, y = np.zeros(len(new) + STEPS, np.int64), np.zeros(len(new) + STEPS, np.int64)
            x[: len(new)] = char_classes(new)
            for s, kind, e in spans:
                y[s], y[s + 1 : e] = 2 * kind + 1, 2 * kind + 2
            # a cut that begins before an item, where there is one, and never within
            cuts = [0, *(max(0, s - int(rng.integers(0, STEPS - 40))) for s, _, _ in spans)]
            at = cuts[rng.integers(len(cuts))] if len(new) > STEPS else 0
            at = next((s for s, _, e in spans if s < at < e), at)
            ids.append(x[at : at + STEPS])
            tags.append(y[at : at + STEPS])
    return np.array(ids), np.array(tags)


def sampled(docs: DataFrame, text: str, id_col: str) -> list[str]:
    """WINDOWS windows of texts at most: of SAMPLE documents with base spans round each of these, of SAMPLE others one.

    Ids and then windows are drawn by hashes, so ids and windows alone are ordered and no whole text is sent."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL AND t != ''")
    numbers = written(rows.select("i", F.col("t").rlike("[0-9@]").alias("some")).distinct(), "numbers")  # a long and a flag a document
    ids = [r[0] for some in (True, False) for r in numbers.where(F.col("some") == some).orderBy(F.xxhash64("i", F.lit(9)), "i").limit(SAMPLE).collect()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                middle = int(hashlib.sha256(t.encode("utf-8", "replace")).hexdigest(), 16) % len(t)
                out += [t[max(0, s - NEAR) : e + NEAR] for s, _, e in spans] or [t[max(0, middle - NEAR) : middle + NEAR]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["w"])

    small_batches(docs.sparkSession)
    windows = rows.where(F.col("i").isin(ids)).select("t").mapInArrow(cut, "w string").distinct()
    return sorted(r[0] for r in windows.orderBy(F.xxhash64("w", F.lit(5)), "w").limit(WINDOWS).collect())


def trained(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> Tagger:
    """A tagger from a bounded sample of documents and made-up sentences."""
    rng = np.random.default_rng(7)
    tagger = Tagger()
    own = sampled(docs, text, id_col)
    tagger.train(*training_windows(own + made_up(TEXTS - len(own), rng), rng))
    return tagger


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def found(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id and FOUND of every document."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *[c.split()[0] for c in FOUND.split(", ")]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, every in tagger.all_spans(batch.column(1).to_pylist()):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(SECRET)]
                rows.append((*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(every), len(every)))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:6]], pa.array(cols[6], pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, f"doc_id long, {FOUND}")


def masked(texts: list[str | None], tagger: Tagger) -> list[str | None]:
    """The texts with each span replaced by its kind in angle brackets."""
    new = []
    for text, (_, spans) in zip(texts, tagger.all_spans(texts)):
        if not spans:
            new.append(text)
            continue
        out, at = [], 0
        for s, kind, e in spans:
            if e <= at:
                continue
            out += [text[at : max(s, at)], f"<{KINDS[kind].upper()}>"]
            at = e
        new.append("".join([*out, text[at:]]))
    return new


def redacted(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The documents with spans masked and n_chars, where there is one, counted anew."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array(masked(cols[at].to_pylist(), tagger), pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = docs.withColumn(text, F.col(text).cast("string"))
    out = out.mapInArrow(kernel, out.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op6(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return found(docs, trained(docs))
