"""Exact token counts by a tokenizer compiled to finite transducers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partloom.llm.pretokens import piece_starts, symbol_table

#: Bounds of memory, not of the data: what is compiled or remembered beyond them is dropped and made again.
MOST_STATES = 400_000
MOST_PIECES = 1_000_000
BATCH_CHARS = 2_000_000
#: Longer pieces are read in chunks of so many bytes, each after a run-up that guesses the state it is entered in.
PIECE_CHUNK, RUN_UP = 1024, 48
#: The state before the first byte of a piece.
START: tuple[bytes, tuple] = (b"", ((0, None, 0),))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Reads the bytes of a piece; every transition carries the change of the number of tokens.

    The encoding of a prefix ends in exactly one token: the one that is a suffix of the prefix and is compatible
    with the token in which the rest of the prefix ends.  A state therefore keeps, for each place at which a
    token that is still being read may have begun, the token that ends there and by how many tokens the
    encoding up to there is shorter.  Both are bounded, so the states are finitely many; they are
    compiled when first reached.
    """

    def __init__(self, tokens: list[bytes], merges: dict[tuple[bytes, bytes], int]):
        self.tokens, self.merges = set(tokens), merges
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for pair in merges:
            self.parts.setdefault(pair[0] + pair[1], pair)
        self.right_edges: dict[bytes, list] = {}
        self.left_edges: dict[bytes, list] = {}
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t) + 1)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.histories: list[tuple[bytes, tuple]] = []
        self.numbers: dict[tuple[bytes, tuple], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self._state(*START)

    def _state(self, suffix: bytes, history: tuple) -> int:
        key = (suffix, history)
        if key not in self.numbers:
            self.numbers[key] = len(self.histories)
            self.histories.append(key)
        return self.numbers[key]

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """The pieces that lie at one end of a token while it is being merged, with the rank that ends each."""
        edges, whole = self.right_edges if right else self.left_edges, token
        if whole not in edges:
            found = [(token, float("inf"))]
            while len(token) > 1:
                end = self.merges[self.parts[token]]
                token = self.parts[token][right]
                found.append((token, end))
            edges[whole] = found
        return edges[whole]

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of the two together is these two tokens.

        It is not if two pieces that meet at the border are merged before either becomes part of a larger one.
        Of equal merges the leftmost comes first.
        """
        for a, a_end in self._edge(left, True):
            for b, b_end in self._edge(right, False):
                rank = self.merges.get((a, b))
                if rank is not None and rank < a_end and rank <= b_end:
                    return False
        return True

    def _compatible(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        if pair not in self.fits:
            if len(self.fits) >= 4 * MOST_STATES:
                self.fits.clear()
            self.fits[pair] = self.compatible(left, right)
        return self.fits[pair]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, history = self.histories[state]
        read, behind = suffix + bytes([byte]), {n: (token, less) for n, token, less in history}
        for size in range(len(read), 0, -1):
            last = read[-size:]
            if last in self.tokens and size - 1 in behind:
                token, less = behind[size - 1]
                if token is None or self._compatible(token, last):
                    break
        else:
            raise ValueError("a vocabulary without all single bytes")
        change = less + 1
        kept = [n for n in range(1, len(read) + 1) if read[-n:] in self.prefixes and n - 1 in behind]
        history = ((0, last, 0), *((n, behind[n - 1][0], behind[n - 1][1] - change) for n in kept))
        return self._state(read[-kept[-1] :] if kept else b"", history), change

    def walk(self, start: tuple[bytes, tuple], data: bytes) -> tuple[tuple[bytes, tuple], int]:
        """The state reached from ``start`` and the change of the number of tokens."""
        state, total = self._state(*start), 0
        for byte in data:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                if max(len(self.histories), len(self.moves)) >= MOST_STATES:
                    here = self.histories[state]
                    self.forget()
                    state = self._state(*here)
                move = self.moves[state << 8 | byte] = self._compile(state, byte)
            state, change = move
            total += change
        return self.histories[state], total

    def chunk_maps(self, piece: bytes) -> list[dict]:
        """For each chunk of a long piece: state it is entered in -> (state it is left in, change of the number of tokens).

        A chunk is read from the state that a short run-up before it leads to; such states seldom depend on what is further away.  Where
        a chunk is left in a state that its successor was not read from, the successor is read from that state as well,
        so the maps hold every state that a composition asks for, and the guesses change the work, never the result.
        """
        chunks = [piece[at : at + PIECE_CHUNK] for at in range(0, len(piece), PIECE_CHUNK)]
        entries = [START] + [self.walk(START, piece[max(at - RUN_UP, 0) : at])[0] for at in range(PIECE_CHUNK, len(piece), PIECE_CHUNK)]
        maps: list[dict] = [{} for _ in chunks]
        todo = list(enumerate(entries))
        while todo:
            i, entry = todo.pop()
            if i < len(chunks) and entry not in maps[i]:
                maps[i][entry] = self.walk(entry, chunks[i])
                todo.append((i + 1, maps[i][entry][0]))
        return maps

    def count(self, piece: bytes) -> int:
        """The number of tokens of a piece; of a long one by composing the maps of its chunks, neighbours first."""
        if len(piece) <= PIECE_CHUNK:
            return self.walk(START, piece)[1]
        maps = self.chunk_maps(piece)
        while len(maps) > 1:
            maps = [composed(*maps[i : i + 2]) for i in range(0, len(maps), 2)]
        return maps[0][START][1]


def composed(first: dict, then: dict | None = None) -> dict:
    """One chunk map after the other."""
    if then is None:
        return first
    return {entry: (then[middle][0], n + then[middle][1]) for entry, (middle, n) in first.items()}


class Counter(dict):
    """Token counts by piece, made by the transducer when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split, model = made["pre_tokenizer"], made["model"]
        if made["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their neighbours are not supported")
        back = byte_alphabet()
        added = {t["content"] for t in made["added_tokens"]}
        unmapped = lambda s: bytes(back[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = {(unmapped(a), unmapped(b)): i for i, (a, b) in enumerate(pairs)}
        reached = {a + b for a, b in merges} | {bytes([b]) for b in range(256)}
        self.transducer = Transducer(sorted(reached), merges)
        self.added = sorted(added, key=len, reverse=True)
        self.symbols = symbol_table(Tokenizer.from_file(path).pre_tokenizer)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        found = self[piece] = self.transducer.count(piece.encode("utf-8", "surrogatepass"))
        return found

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and how many of those there are."""
        parts, found = [text], 0
        for token in self.added:
            cut = [p.split(token) for p in parts]
            found += sum(len(p) - 1 for p in cut)
            parts = [x for p in cut for x in p]
        return parts, found

    def counts(self, texts: list[str]) -> np.ndarray:
        """The token counts of whole texts."""
        cut = [self._segments(t) for t in texts]
        totals = np.array([n for _, n in cut], np.int64)
        segments = [s for parts, _ in cut for s in parts]
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts, _ in cut])
        flat, starts = piece_starts(segments, self.symbols)
        if not len(starts):
            return totals
        of_text = owner[np.searchsorted(np.cumsum([len(s) for s in segments]), starts, side="right")]
        ends = np.append(starts[1:], len(flat))
        for at in range(0, len(starts), BATCH_CHARS):
            a, b = starts[at : at + BATCH_CHARS], ends[at : at + BATCH_CHARS]
            pieces = (flat[x:y] for x, y in zip(a.tolist(), b.tolist()))
            each = np.fromiter(map(self.__getitem__, pieces), np.int64, len(a))
            totals += np.bincount(of_text[at : at + BATCH_CHARS], each, len(texts)).astype(np.int64)
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def in_batches(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together; a longer text comes alone."""
    rest = iter(texts)
    batch, size = [], 0
    for text in rest:
        if batch and size + len(text) > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def count_tokens(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, without added begin or end tokens.

    ``tokenizer`` is the path of a byte-level BPE file in the form of the tokenizers library.  The splitting rule and
    the merges are compiled to deterministic transducers.  Texts are cut into chunks that are read side
    by side for every state they may begin in; a parallel prefix scan composes these state maps, which
    gives the true states.  Pieces go through the second transducer, whose transitions carry token counts; those of more than
    ``PIECE_CHUNK`` bytes in chunks as well, whose maps of states to states and counts are composed pair by pair.
    What is compiled is bounded within a piece too.

    Null and empty texts have no bytes and no tokens.  Strings of added tokens inside a text count as one token, which
    is the library's default.  Identifiers may be null or repeated; every row gives one row.  An empty
    table gives an empty result.  Further columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            found = [machine.counts(part) for part in in_batches(texts.to_pylist())]
            n = pa.array(np.concatenate(found) if found else [], pa.int64())
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
