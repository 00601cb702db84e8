"""Vectorised pre-tokenisation: where the pre-tokens of many texts begin, without regular expressions.

Every code point has a class (an array look-up). A small automaton reads the classes; its transition functions form a
finite monoid, so each class is one element of it and composition is a table look-up on bytes. A blocked prefix scan
composes the elements of all positions (associative, so blocks are scanned side by side), which gives the state at every
position; boundaries are then whole-array comparisons of states and classes.

The pattern this realises is the byte-level one with contractions ('s 't 're 've 'm 'll 'd), optional leading space,
runs of letters, of numbers, of other signs, and white space that leaves its last character to what follows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

RESET, LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, S_T_M_D, R_, V_, E_, L_ = range(12)
#: States after a character: START of a text, LETTERs, NUMBERs, OTHER signs, a SPACE, other WHITE space, an apostrophe that
#: begins a pre-token, that with r, v or l behind it, and the end of a contraction of one or of two letters.
START, LET, NUM, OTH, SPC, WHI, APO, APO_RV, APO_L, END1, END2 = range(11)

#: Letters and numbers that came with Unicode 16, for interpreters with older tables.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
WHITE_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    of = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kinds = np.array(kinds)
    of[kinds == "L"] = LETTER
    of[kinds == "N"] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            of[a : b + 1] = kind
    of[WHITE_SPACE] = WHITE
    of[ord(" ")] = SPACE
    of[ord("'")] = APOSTROPHE
    for c in "stmd":
        of[ord(c)] = S_T_M_D
    of[ord("r")], of[ord("v")], of[ord("e")], of[ord("l")] = R_, V_, E_, L_
    return of


def class_of(last: int, *kinds: int) -> str:
    """The inside of a regular expression's brackets: all code points up to `last` whose class is one of `kinds`."""
    inside = np.isin(classes()[: last + 1], kinds)
    inside[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


#: Kinds of letters, of numbers and of white space.
LETTER_KINDS, NUMBER_KINDS, SPACE_KINDS = (LETTER, S_T_M_D, R_, V_, E_, L_), (NUMBER,), (SPACE, WHITE)


def _step(state: int, kind: int) -> int:
    if kind == RESET:
        return START
    if kind == SPACE:
        return SPC
    if kind == WHITE:
        return WHI
    if kind == NUMBER:
        return NUM
    if kind == OTHER:
        return OTH
    if kind == APOSTROPHE:
        return OTH if state in (OTH, SPC, APO) else APO
    if state == APO:
        if kind == S_T_M_D:
            return END1
        if kind in (R_, V_):
            return APO_RV
        if kind == L_:
            return APO_L
    if state == APO_RV and kind == E_ or state == APO_L and kind == L_:
        return END2
    return LET


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the automaton: the element of each class, the product table (first a, then b), and each element's state from START."""
    of_class = [tuple(_step(s, k) for s in range(11)) for k in range(12)]
    elements = [tuple(range(11))]
    known = {elements[0]: 0}
    at = 0
    while at < len(elements):
        for f in of_class:
            if (g := tuple(f[s] for s in elements[at])) not in known:
                known[g] = len(elements)
                elements.append(g)
        at += 1
    assert len(elements) <= 256
    table = np.array([[known[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint8)
    return np.array([known[f] for f in of_class], np.uint8), table, np.array([e[START] for e in elements], np.uint8)


def prefix_products(items: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """The product of each position with all before it. Blocks of `width` are scanned side by side, then their totals, then joined."""
    n = len(items)
    if n <= width:
        out = items.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.uint8)  # 0: the identity
    grid[:n] = items
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat, size = table.ravel(), np.intp(table.shape[1])
    for i in range(1, width):
        grid[i] = flat[grid[i - 1] * size + grid[i]]
    before = np.zeros(blocks, np.uint8)
    before[1:] = prefix_products(grid[-1], table, width)[:-1]
    grid = flat[before.astype(np.intp)[None, :] * size + grid]
    return grid.T.reshape(-1)[:n]


#: Which group of classes a character belongs to, by class and by state.
_GROUP_OF_CLASS = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 1, 1, 1], np.uint8)
_GROUP_OF_STATE = np.array([0, 1, 2, 3, 4, 4, 3, 1, 1, 5, 5], np.uint8)


def pretokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string with a separator behind each; the pre-tokens' starts in it; how many each text has.
    A pre-token ends where the next starts, or at its text's end: the starts hold the separators' places too."""
    joined = "\x00".join(texts) + "\x00"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    kind[ends] = RESET
    of_class, table, final = monoid()
    state = final[prefix_products(of_class[kind], table)]
    group = _GROUP_OF_CLASS[kind]
    before = np.empty_like(state)
    before[0], before[1:] = START, state[:-1]
    # A pre-token begins where the group changes, or behind a contraction; a space is taken along by what follows it.
    start = (_GROUP_OF_STATE[before] != group) & ~((before == SPC) & (group != 4))
    # White space that something follows leaves its last character.
    white = group == 4
    followed = np.zeros(len(state), bool)
    followed[:-1] = (group[1:] != 4) & (group[1:] != 0)
    start |= white & followed
    # A contraction's letters belong to its apostrophe.
    one, two = state == END1, state == END2
    start &= ~(one | two)
    start[:-1] &= ~two[1:]
    start[ends] = True
    places = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(places, ends), prepend=-1) - 1
    return joined, places, counts
