"""Splitting of text before the merges, as a deterministic transducer over character classes.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ . Its transducer has 13 states;
a transition emits whether a piece starts at this character, and whether one starts at the character before (look-ahead
is delayed output). A batch of texts is cut into chunks; each chunk's map from state to state is computed for all chunks
at once, the maps are composed by a parallel prefix scan, and with its start state known each chunk emits its cuts.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np

START, LET, NUM, OTH, SP, WS, RUNSP, RUNWS, AP, APL, APV, APR, END = range(13)
C_LET, C_SDMT, C_L, C_V, C_R, C_E, C_NUM, C_SP, C_WS, C_AP, C_OTH = range(11)
CLASSES = 11
CHUNK = 256
_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(None)
def classes() -> np.ndarray:
    out = np.full(0x110000, C_OTH, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = C_LET
        elif k == "N":
            out[c] = C_NUM
    out[_SPACE] = C_WS
    for chars, k in (("sdmt", C_SDMT), ("l", C_L), ("v", C_V), ("r", C_R), ("e", C_E), (" ", C_SP), ("'", C_AP)):
        out[[ord(x) for x in chars]] = k
    return out


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output (1: a piece starts here, 2: at the character before) by state and class; classes from CLASSES on are first characters of a text."""
    nxt, out = np.zeros((13, 2 * CLASSES), np.uint8), np.zeros((13, 2 * CLASSES), np.uint8)

    def fresh(c: int) -> int:
        return LET if c <= C_E else {C_NUM: NUM, C_SP: SP, C_WS: WS, C_AP: AP, C_OTH: OTH}[c]

    def run(c: int) -> int:
        return LET if c <= C_E else NUM if c == C_NUM else OTH

    for c in range(CLASSES):
        letter, space, other = c <= C_E, c in (C_SP, C_WS), c in (C_AP, C_OTH)
        more = RUNSP if c == C_SP else RUNWS
        as_let = (LET, 0) if letter else (fresh(c), 1)
        step = {
            START: (fresh(c), 1),
            END: (fresh(c), 1),
            LET: as_let,
            NUM: (NUM, 0) if c == C_NUM else (fresh(c), 1),
            OTH: (OTH, 0) if other else (fresh(c), 1),
            SP: (more, 0) if space else (run(c), 0),
            WS: (more, 0) if space else (fresh(c), 1),
            RUNSP: (more, 0) if space else (run(c), 2),
            RUNWS: (more, 0) if space else (fresh(c), 3),
            AP: (END, 0) if c == C_SDMT else (APL, 0) if c == C_L else (APV, 0) if c == C_V else (APR, 0) if c == C_R else (OTH, 0) if other else (fresh(c), 1),
        }
        for s, last in ((APL, C_L), (APV, C_E), (APR, C_E)):
            step[s] = (END, 0) if c == last else (as_let[0], as_let[1] | 2)
        for s, (n, o) in step.items():
            nxt[s, c], out[s, c] = n, o
            nxt[s, CLASSES + c] = fresh(c)
            out[s, CLASSES + c] = 1 | (2 if s in (APL, APV, APR) else 0)
    return nxt, out


NEXT, OUT = _table()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), by doubling."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.int64), axis=1)
        d *= 2
    return maps


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which a piece starts, in order, for texts in UTF-8 back to back."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.int32)
    cp = b.copy()
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide):
        at, x = lead[wide], b[wide]
        get = lambda j: data[np.minimum(at + j, len(data) - 1)].astype(np.int32) & 0x3F
        two = (x & 0x1F) << 6 | get(1)
        three = (x & 0x0F) << 12 | get(1) << 6 | get(2)
        four = (x & 0x07) << 18 | get(1) << 12 | get(2) << 6 | get(3)
        cp[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))
    cls = classes()[cp]
    first = np.searchsorted(lead, off[:-1][off[1:] > off[:-1]])
    cls[first] += CLASSES
    n = len(cls)
    k = -(-n // CHUNK)
    pad = np.zeros(k * CHUNK, np.uint8)
    pad[:n] = cls
    cols = np.ascontiguousarray(pad.reshape(k, CHUNK).T)
    flat, oflat = NEXT.ravel(), OUT.ravel()
    width = np.uint16(2 * CLASSES)
    # every chunk's map; most become constant after a few characters, then one column stands for all
    maps = np.tile(np.arange(13, dtype=np.uint16), (k, 1))
    live, state, const = np.arange(k), np.zeros(k, np.uint16), np.zeros(0, np.int64)
    full = maps
    for j in range(CHUNK):
        if len(live):
            full = flat[full * width + cols[j, live][:, None]].astype(np.uint16)
        if len(const):
            state[const] = flat[state[const] * width + cols[j, const]]
        if j % 16 == 15 and len(live):
            same = (full == full[:, :1]).all(axis=1)
            if same.any():
                state[live[same]] = full[same, 0]
                const = np.concatenate([const, live[same]])
                live, full = live[~same], full[~same]
    maps[live] = full
    maps[const] = state[const][:, None]
    start = np.zeros(k, np.uint16)
    start[1:] = compose(maps)[:-1, START]
    out = np.empty((CHUNK, k), np.uint8)
    s = start
    for j in range(CHUNK):
        i = s * width + cols[j]
        out[j] = oflat[i]
        s = flat[i].astype(np.uint16)
    out = out.T.ravel()[:n]
    here = (out & 1).astype(bool)
    prev = np.flatnonzero(out & 2) - 1
    here[prev] = True
    # a text that ends in 'l, 'v or 'r: no contraction, the letter is a piece of its own
    last = np.concatenate([first[1:], [n]]) - 1
    c = cls[last] % CLASSES
    tail = last[((c == C_L) | (c == C_V) | (c == C_R)) & ~here[last] & (last > 0)]
    tail = tail[(cls[tail - 1] % CLASSES == C_AP) & here[tail - 1] & (cls[tail] < CLASSES)]
    here[tail] = True
    return lead[here]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
