"""Token boundaries of many texts at once, without regular expressions.

Every code point gets a class, and with its neighbours a symbol. Nine states say what the next
symbol continues; a symbol is a function from state to state, and composing functions is
associative. So blocks are composed independently for every possible start state, a scan over the
blocks gives each block's true start state, and a last pass reads off the boundaries.

The rules: the suffixes 's 't 'm 'd 're 've 'll at the start of a token; runs of letters, of
numbers, or of other characters, each with one leading space; runs of white space, of which the
last character stands apart when a token follows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols: the classes, white space inside or at the end of a run, suffix marks, end of text.
S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_LAST_SPACE, S_LAST_WHITE, S_SUFFIX1, S_SUFFIX2, S_END = range(9)
# States: nothing to continue, in a run of a kind, behind a leading space, within white space, suffix letters to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LEADING, IN_WHITE, AFTER_WHITE, ONE_LEFT, TWO_LEFT = range(9)
_N = 9
_BLOCK = 64

# White space besides what Unicode calls separators, and the suffix letters.
_WHITE_CONTROLS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
_SHORT_SUFFIXES = "stmd"
_LONG_SUFFIXES = ("re", "ve", "ll")


@cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind != "C":
            kinds[code] = {"L": LETTER, "N": NUMBER, "Z": WHITE}.get(kind, OTHER)
    kinds[list(_WHITE_CONTROLS)] = WHITE
    kinds[0x20] = SPACE
    return kinds


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next state (times _N) and whether a token starts, at state * _N + symbol."""
    step, starts = np.zeros((_N, _N), np.uint8), np.ones((_N, _N), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (S_INNER, IN_WHITE), (S_LAST_SPACE, LEADING), (S_LAST_WHITE, AFTER_WHITE), (S_SUFFIX1, ONE_LEFT), (S_SUFFIX2, TWO_LEFT), (S_END, FRESH)):
        step[:, symbol] = state
    step[TWO_LEFT, S_LETTER], step[ONE_LEFT, S_LETTER] = ONE_LEFT, FRESH
    for symbol in (S_SUFFIX1, S_SUFFIX2):  # not at a token's start: an ordinary character
        step[[IN_OTHERS, LEADING], symbol] = IN_OTHERS
    starts[[IN_LETTERS, LEADING, ONE_LEFT, TWO_LEFT], S_LETTER] = False
    starts[[IN_NUMBERS, LEADING], S_NUMBER] = False
    for symbol in (S_OTHER, S_SUFFIX1, S_SUFFIX2):
        starts[[IN_OTHERS, LEADING], symbol] = False
    starts[IN_WHITE, S_INNER] = False
    return (step * _N).ravel(), starts.ravel()


def _symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kinds = _classes()[codes]
    kinds[ends] = S_END
    after = np.append(kinds[1:], np.uint8(S_END))
    symbols = kinds.copy()
    white = (kinds == SPACE) | (kinds == WHITE)
    last = white & (after != SPACE) & (after != WHITE) & (after != S_END)
    symbols[white] = S_INNER
    symbols[last & (kinds == SPACE)] = S_LAST_SPACE
    symbols[last & (kinds == WHITE)] = S_LAST_WHITE
    marks = np.flatnonzero((codes == ord("'")) & (after == LETTER))
    if len(marks):
        padded = np.append(codes, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        symbols[marks[np.isin(one, [ord(c) for c in _SHORT_SUFFIXES])]] = S_SUFFIX1
        long = np.zeros(len(marks), bool)
        for a, b in _LONG_SUFFIXES:
            long |= (one == ord(a)) & (two == ord(b))
        symbols[marks[long]] = S_SUFFIX2
    return symbols


def _start_flags(symbols: np.ndarray) -> np.ndarray:
    step, starts = _tables()
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    padded = np.full(blocks * _BLOCK, S_END, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    # What each block does to every state.
    effect = np.repeat(np.arange(0, _N * _N, _N, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:
        effect = step[effect + column]
    # Inclusive scan of the blocks' functions by doubling.
    reach = 1
    while reach < blocks:
        composed = np.take_along_axis(effect[:, reach:], (effect[:, :-reach] // _N).astype(np.intp), axis=0)
        effect = np.concatenate([effect[:, :reach], composed], axis=1)
        reach *= 2
    state = np.empty(blocks, np.uint8)
    state[0] = FRESH * _N
    state[1:] = effect[FRESH, :-1]
    flags = np.empty((_BLOCK, blocks), bool)
    for i, column in enumerate(columns):
        at = state + column
        flags[i] = starts[at]
        state = step[at]
    return flags.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, starts, ends, counts): the tokens' slices of the joined texts and how many each text has."""
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    marks = np.flatnonzero(_start_flags(_symbols(codes, text_ends)))
    if not len(marks):
        return joined, marks, marks, np.zeros(len(texts), np.int64)
    is_end = np.zeros(len(codes), bool)
    is_end[text_ends] = True
    real = ~is_end[marks]
    starts, ends = marks[real], np.append(marks[1:], len(codes))[real]
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return joined, starts, ends, counts
