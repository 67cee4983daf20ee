"""The splitting rule of byte-level BPE tokenizers as a finite transducer run over chunks in parallel."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers.pre_tokenizers import PreTokenizer

#: Input symbols: space, other blanks, letters, numbers, the rest, apostrophe, and the letters of contractions.
SYMBOLS = ["space", "blank", "letter", "number", "other", "apostrophe", "stmd", "r", "v", "l", "e", "pad"]
#: States: what the last character was, and what it leaves open.
STATES = [
    "start", "letter", "number", "other",
    "space", "blank",  # first of a run: a piece starts at it
    "spaces", "blanks",  # later in a run: a piece starts at it only if the run ends here before other text
    "apostrophe", "apostrophe_r", "apostrophe_v", "apostrophe_l", "contraction",
]
HERE, BEFORE = 1, 2  # outputs: a piece starts at this character, at the one before
CHUNK, SETTLE = 256, 12
_RUN = 1 << 14  # code points asked at once
_PAD = SYMBOLS.index("pad")
_COMPLETES = {"apostrophe_r": "e", "apostrophe_v": "e", "apostrophe_l": "l"}
_LETTERS = {"letter", "stmd", "r", "v", "l", "e"}


def _move(state: str, symbol: str) -> tuple[str, int]:
    if symbol == "pad":
        return state, 0
    kind = "letter" if symbol in _LETTERS else symbol
    if state in _COMPLETES:
        if symbol == _COMPLETES[state]:
            return "contraction", 0
        after, out = _move("letter", symbol)
        return after, out | BEFORE
    if state == "apostrophe":
        if symbol == "stmd":
            return "contraction", 0
        if symbol in ("r", "v", "l"):
            return f"apostrophe_{symbol}", 0
        return _move("other", symbol)
    if kind in ("space", "blank"):
        inside = state in ("space", "blank", "spaces", "blanks")
        return (kind + "s", 0) if inside else (kind, HERE)
    if state in ("space", "spaces"):  # the space belongs to what follows, an apostrophe too
        return ("other" if kind == "apostrophe" else kind), (BEFORE if state == "spaces" else 0)
    if state == "other" and kind in ("other", "apostrophe"):
        return "other", 0
    out = HERE | (BEFORE if state == "blanks" else 0)
    return kind, (0 if kind == state else out)


@lru_cache(maxsize=1)
def compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state * symbols + symbol."""
    moves = [_move(state, symbol) for state in STATES for symbol in SYMBOLS]
    return np.array([STATES.index(s) for s, _ in moves], np.uint8), np.array([o for _, o in moves], np.uint8)


def symbol_table(splitter: PreTokenizer) -> np.ndarray:
    """The symbol of every code point, asked of the tokenizer's own splitter.

    Beyond ASCII, neighbouring code points that it leaves in one piece are of one kind, so one of each piece is asked.  They go
    through the splitter in short runs: it takes some hundred bytes for each character at once.
    """

    def kind(char: str) -> str:
        for name, sample in (("letter", "a"), ("number", "1"), ("other", "!")):
            if len(splitter.pre_tokenize_str(sample + char)) == 1:
                return name
        return "blank"

    table = np.full(0x110000, SYMBOLS.index("other"), np.uint8)
    for point in range(0x80):
        table[point] = SYMBOLS.index(kind(chr(point)))
    for first, last in ((0x80, 0xD800), (0xE000, 0x110000)):
        for begin in range(first, last, _RUN):
            points = "".join(map(chr, range(begin, min(begin + _RUN, last))))
            for _, (a, b) in splitter.pre_tokenize_str(points):
                table[begin + a : begin + b] = SYMBOLS.index(kind(points[a]))
    single = {" ": "space", "'": "apostrophe", **dict.fromkeys("stmd", "stmd"), **{x: x for x in "rvle"}}
    for char, name in single.items():
        table[ord(char)] = SYMBOLS.index(name)
    return table


def _run(symbols: np.ndarray, states: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Read one row of ``symbols`` after the other, all chunks at once; the states at the end."""
    to, emit = compiled()
    for i, row in enumerate(symbols):
        at = states.astype(np.intp) * len(SYMBOLS) + row
        if out is not None:
            out[i] = emit[at]
        states = to[at]
    return states


def _chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """(states, chunks): the state in which a chunk ends for every state in which it may begin.

    Nearly every chunk forgets where it began within a few characters and is then read once, not once for each state.
    """
    n = len(STATES)
    start = np.repeat(np.arange(n, dtype=np.uint8)[:, None], symbols.shape[1], axis=1)
    maps = _run(symbols[:SETTLE, None, :], start)
    settled = (maps == maps[0]).all(axis=0)
    rest = symbols[SETTLE:]
    maps[:, settled] = _run(rest[:, settled], maps[0, settled])
    if not settled.all():
        maps[:, ~settled] = _run(rest[:, None, ~settled], maps[:, ~settled])
    return maps


def _compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of state maps under composition."""
    step, n = 1, maps.shape[1]
    while step < n:
        later = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :step], later], axis=1)
        step *= 2
    return maps


def piece_starts(texts: list[str], table: np.ndarray) -> tuple[str, np.ndarray]:
    """All texts joined, and where the pieces of each start in that (a piece never crosses texts)."""
    flat = "".join(texts)
    symbols = table[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chunks = -(-sizes // CHUNK)
    first = np.cumsum(chunks) - chunks  # each text begins with a chunk of its own
    place = np.arange(len(flat)) + np.repeat(first * CHUNK - (np.cumsum(sizes) - sizes), sizes)
    grid = np.full(int(chunks.sum()) * CHUNK, _PAD, np.uint8)
    grid[place] = symbols
    grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    maps = _chunk_maps(grid)
    heads = first[sizes > 0]
    maps[:, heads] = maps[0, heads]  # whatever came before, a text begins at the start state
    ends = _compose(maps)[0]
    begins = np.concatenate([[0], ends[:-1]]).astype(np.uint8)
    begins[heads] = 0
    out = np.empty_like(grid)
    _run(grid, begins, out)
    marks = np.ascontiguousarray(out.T).ravel()[place]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    open_ends = np.isin(ends[(first + chunks - 1)[sizes > 0]], [STATES.index(s) for s in _COMPLETES])
    starts[(np.cumsum(sizes) - 1)[sizes > 0][open_ends]] = True
    return flat, np.flatnonzero(starts)
