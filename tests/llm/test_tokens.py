import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from partloom.llm import token_counts
from partloom.llm.packing import Packer, encoder, pack
from partloom.llm.pretokens import CHUNK, piece_starts
from partloom.llm.queries import TOKENIZER
from partloom.llm.token_counts import count_tokens, counter

LIBRARY = Tokenizer.from_file(TOKENIZER)
HARD = st.lists(
    st.sampled_from(
        [*"aAbstmdrevl' \n\t\r1290.,!$<>|é漢²ⅷ_", "  ", "'re", "'ll", "'ve", "'s", " '", "<|endoftext|>", "<|endoftext", " ", "\x85", "😀", "the", " of"]
    ),
    max_size=60,
).map("".join)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD | st.text(max_size=40), min_size=1, max_size=4))
def test_counts_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter(TOKENIZER).counts(texts).tolist() == [len(ids_of(t)) for t in texts]


@pytest.mark.parametrize("size", [CHUNK - 1, CHUNK, CHUNK + 1, 5 * CHUNK])
@pytest.mark.parametrize("tail", ["", "a", "'s", "'r", "\n", " x"])
def test_runs_across_chunks(size, tail):
    texts = [c * size + tail for c in (" ", "\n", "a", "1", ".", "'", " '")]
    assert counter(TOKENIZER).counts(texts).tolist() == [len(ids_of(t)) for t in texts]


def merged(merges, text):
    """The encoding of a piece by the merge rules themselves."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((merges.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_compatible_pairs_are_those_of_the_merges():
    machine = counter(TOKENIZER).transducer
    random.seed(1)
    tokens = sorted(machine.tokens, key=len)
    short = tokens[:1500]
    for _ in range(4000):
        a, b = random.choice(short), random.choice(random.choice([short, tokens]))
        if merged(machine.merges, a) == [a] and merged(machine.merges, b) == [b]:
            assert machine.compatible(a, b) == (merged(machine.merges, a + b) == [a, b]), (a, b)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 5)
    monkeypatch.setattr(token_counts, "MOST_PIECES", 3)
    machine = token_counts.Counter(TOKENIZER)
    text = "some words, and more of the words: unbelievable antidisestablishmentarianism"
    assert machine.counts([text, text]).tolist() == [len(ids_of(text))] * 2


@pytest.mark.parametrize("chunk, run_up", [(7, 0), (16, 3), (64, 48), (1024, 48)])
def test_long_pieces_by_composed_maps(monkeypatch, chunk, run_up):
    monkeypatch.setattr(token_counts, "PIECE_CHUNK", chunk)
    monkeypatch.setattr(token_counts, "RUN_UP", run_up)
    random.seed(chunk)
    machine = token_counts.Counter(TOKENIZER)
    letters = "".join(random.choices("etaoinshrdlu", k=4000))
    for text in [letters, "a" * 4001, "ab" * 1500, "=" * 3333, " " * 2049, "1234567" * 300, "é漢" * 700, "antidisestablishmentarianism" * 90]:
        assert machine.counts([text]).tolist() == [len(ids_of(text))]
    maps = machine.transducer.chunk_maps(letters.encode())
    assert len(maps) == -(-4000 // chunk) and token_counts.START in maps[0]
    assert all(end in after for here, after in zip(maps, maps[1:]) for end, _ in here.values())


def test_a_long_piece_is_compiled_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 500)
    random.seed(3)
    machine = token_counts.Counter(TOKENIZER)
    text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    assert machine.counts([text]).tolist() == [len(ids_of(text))]
    assert len(machine.transducer.histories) <= 501 and len(machine.transducer.moves) <= 500


def test_every_code_point_is_split_as_by_the_library():
    points = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x30000)]]
    texts = ["a" + "a".join(points[i : i + 500]) + "1" + "1".join(points[i : i + 500]) for i in range(0, len(points), 500)]
    _, starts = piece_starts(texts, counter(TOKENIZER).symbols)
    offsets = np.cumsum([0, *map(len, texts)])
    want = [o + a for o, t in zip(offsets, texts) for _, (a, _) in LIBRARY.pre_tokenizer.pre_tokenize_str(t)]
    assert starts.tolist() == want


def test_count_rows(make_docs, documents):
    rows = [(1, None), (2, ""), (None, "x"), (3, "w " * 2000), (3, "w " * 2000), (4, "é<|endoftext|>é"), (5, "long" * 200_000)]
    docs = make_docs(rows, ["1 AS n_tokens", "2 AS n_bytes"])
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, TOKENIZER).collect())
    want = sorted((i or 0, len((t or "").encode()), len(ids_of(t or "")), len(ids_of(t or "")) > 1024) for i, t in rows)
    assert got == want
    assert count_tokens(docs.limit(0), TOKENIZER).count() == 0
    counted = {r["doc_id"]: r["n_tokens"] for r in count_tokens(documents, TOKENIZER).collect()}
    assert counted == {r["doc_id"]: len(ids_of(r["text"])) for r in documents.collect()}


def check_packing(rows, docs, capacity):
    """Every id lies in exactly one piece, sequences have no gap, and none but powers of two is short."""
    out = pack(docs, TOKENIZER, capacity, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], tuple(r["ids"]), r["doc_tokens"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or end & (end - 1) == 0 and end < capacity
    want = defaultdict(list)
    for i, text in rows:
        want[i].append([*ids_of(text or ""), 1])
    assert set(pieces) == set(want)
    for i, docs_of in want.items():
        assert {p[2] for p in pieces[i]} == {len(d) for d in docs_of}
        if len({tuple(d) for d in docs_of}) == 1:
            ids = docs_of[0]
            assert all(list(p) == ids[start : start + len(p)] for start, p, _ in pieces[i])
            covered = sorted(k for start, p, _ in pieces[i] for k in range(start, start + len(p)))
            assert covered == sorted([*range(len(ids))] * len(docs_of))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(documents, capacity):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check_packing(rows, documents.repartition(3, "doc_id"), capacity)


def test_packing_edge_cases(make_docs):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "a<|endoftext|>b"), (5, "very long " * 30000)]
    docs = make_docs(rows, ["1 AS start", "2 AS sequence_id"])
    check_packing(rows, docs, 128)
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_placement_minimises_the_sum_of_squares():
    random.seed(2)
    packer = Packer(16)
    for n in range(400):
        size = random.randint(1, 16)
        level = packer.level_for(size)

        def cost(h):
            after = packer.levels.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            return int((after[1:16] ** 2).sum())

        usable = [h for h in range(16 - size + 1) if h == 0 or packer.levels[h]]
        assert level == min(usable, key=lambda h: (cost(h), -h))
        packer.place((n, 0, b"\0" * 4 * size, size), size)


def test_encoder_forgets_and_agrees(documents, monkeypatch):
    monkeypatch.setattr("partloom.llm.packing.MOST_PIECES", 50)
    texts = [r["text"] for r in documents.collect()] + ["x<|endoftext|>y", ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(TOKENIZER).encode(texts)] == [ids_of(t) for t in texts]
