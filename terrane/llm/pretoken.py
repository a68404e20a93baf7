"""Pre-tokenisation without regular expressions.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is a finite automaton over classes of code points, once each character also knows up
to two that follow it: whether an apostrophe opens a contraction, and whether white
space is the last before something else. Every class is a function from state to
state. The functions that arise from composing them are few, so each has a number and
composition is a table; since composition is associative, the state before every
character comes from a prefix scan: columns of a folded array are composed for all
rows at once, the rows' totals are scanned the same way, and both are put together.
A character starts a piece when its class says so for the state before it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# classes of characters
END, LETTER, NUMBER, OTHER, SHORT, LONG, INNER, LEAD, LAST = range(9)
# states: nothing open; a run of letters, numbers, others, white space; a space that
# joins what follows; one or two characters of a contraction to come
NONE, IN_L, IN_N, IN_O, IN_W, SPACE, ONE, TWO = range(8)
#: Code points with the property White_Space (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SENTINEL = 0x110000
ROW = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether the character starts a piece."""
    if kind == END:
        return NONE, False
    if kind == LETTER:
        if state in (ONE, TWO):
            return (NONE, ONE)[state == TWO], False
        return IN_L, state not in (IN_L, SPACE)
    if kind == NUMBER:
        return IN_N, state not in (IN_N, SPACE)
    if kind in (OTHER, SHORT, LONG):
        if kind == OTHER or state in (IN_O, SPACE):
            return IN_O, state not in (IN_O, SPACE)
        return (ONE if kind == SHORT else TWO), True
    if kind == INNER:
        return IN_W, state != IN_W
    return (SPACE if kind == LEAD else NONE), True


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By class: its function's number; composition (a before b); the functions; starts by state and class."""
    gens = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    number = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *gens]))}
    todo = list(number)
    for f in todo:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    table = np.array(list(number), np.uint8)
    compose = np.array([[number[tuple(g[x] for x in f)] for g in number] for f in number], np.uint16)
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return np.array([number[g] for g in gens], np.uint16), compose, table, starts


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point, with INNER for all white space; the sentinel's is END."""
    t = np.full(SENTINEL + 1, OTHER, np.uint8)
    for c in range(SENTINEL):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            t[c] = LETTER
        elif kind == "N":
            t[c] = NUMBER
    t[list(WHITE)] = INNER
    t[SENTINEL] = END
    return t


def classes(cp: np.ndarray) -> np.ndarray:
    """Classes of code points, of which the last is the sentinel."""
    kind = class_table()[cp]
    after = np.empty_like(kind)
    after[:-1], after[-1] = kind[1:], END
    white = np.flatnonzero((kind == INNER) & (after != INNER) & (after != END))
    kind[white] = np.where(cp[white] == 32, LEAD, LAST)
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        a = cp[quote + 1]
        b = cp[np.minimum(quote + 2, len(cp) - 1)]
        short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[quote[short]] = SHORT
        kind[quote[long]] = LONG
    return kind


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """The composition of the functions before each place."""
    n = len(f)
    flat, m = compose.ravel(), compose.shape[0]
    if n <= ROW:
        out, acc = np.zeros(n, np.uint16), 0
        for i in range(n):
            out[i] = acc
            acc = int(compose[acc, f[i]])
        return out
    rows = -(-n // ROW)
    grid = np.zeros(rows * ROW, np.uint16)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    before, acc = np.empty_like(grid), np.zeros(rows, np.int64)
    for j in range(ROW):
        before[j] = acc
        acc = flat[acc * m + grid[j]].astype(np.int64)
    lead = _scan(acc.astype(np.uint16), compose).astype(np.int64)
    return flat[lead[None, :] * m + before].T.reshape(-1)[:n]


def pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets where pieces start, for texts that lie end to end in data.

    Pieces cover every byte, so each ends where the next one starts."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    head = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cp = np.insert(cp, np.searchsorted(head, offs[1:]), SENTINEL)
    kind = classes(cp)
    by_class, compose, table, starts = _tables()
    state = table[_scan(by_class[kind], compose), NONE]
    begins = starts[state, kind]
    return head[begins[cp != SENTINEL]]
