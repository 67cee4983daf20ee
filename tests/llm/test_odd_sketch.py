import random
import re

import numpy as np
import pytest

from partloom.llm import odd_sketch
from partloom.llm.odd_sketch import drop_near_duplicates, near_duplicates, plan


def brute_sets(texts):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def brute(rows, percent, blanks_linked=False):
    """{doc_id: (set size, least identifier reachable)}, comparing everything with everything; also the number of links."""
    rows = sorted(rows)
    sets = brute_sets([t for _, t in rows])
    linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b) if a or b else blanks_linked
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])]
    label = list(range(len(rows)))
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return {rows[i][0]: (len(sets[i]), rows[label[i]][0]) for i in range(len(rows))}, len(pairs)


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_table(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, pairs = brute([(r["doc_id"], r["text"]) for r in docs.collect()], percent)
    assert pairs >= 5 and got(near_duplicates(docs, similarity=percent / 100)) == want


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for _ in range(12):
        text = [word() for _ in range(draw.choice([3, 40, 90, 300]))]
        for _ in range(12):  # a chain of edits
            rows.append((len(rows), " ".join(text)))
            text = [word() if draw.random() < 0.015 else w for w in text]
    base = [word() for _ in range(140)]
    for _ in range(300):  # a large group about one text, most of them close to the bound
        text = list(base)
        for _ in range(draw.randrange(7)):
            at = draw.randrange(len(text))
            text[at : at + draw.choice([0, 1, 1, 2])] = [word()]
        rows.append((len(rows), " ".join(text)))
    for _ in range(100):  # copies of copies
        _, text = rows[draw.randrange(150, len(rows))]
        words = text.split()
        words[draw.randrange(len(words))] = word()
        rows.append((len(rows), " ".join(words)))
    line = [word() for _ in range(30)]
    for _ in range(100):  # a common passage in different texts
        rows.append((len(rows), " ".join(line + [word() for _ in range(draw.randrange(1, 40))])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_edits_groups_and_passages(make_docs, percent):
    rows = corpus(percent)
    want, _ = brute(rows, percent)
    assert 100 < len({c for _, c in want.values()}) < len(rows) - 150
    assert got(near_duplicates(make_docs(rows), similarity=percent / 100)) == want


def test_far_from_the_middle(make_docs, monkeypatch):
    """Links between texts that are unlike the middle of their group are found from their differences."""
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(10**6)}"
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(base[:-1] + [word()])) for i in range(20)]
    for _ in range(10):  # pairs that share four edits, so each is unlike the base
        text = list(base)
        for at in draw.sample(range(0, 95, 6), 4):
            text[at] = word()
        rows += [(len(rows) + i, " ".join([*text[:-1], word()])) for i in range(2)]
    want, _ = brute(rows, 85)
    assert got(near_duplicates(make_docs(rows))) == want and want[21][1] != 0 and want[21][1] == want[20][1]


def test_drop(make_docs):
    rows = corpus(1)
    want, _ = brute(rows, 80, True)
    kept = drop_near_duplicates(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()})


def test_edge_cases(make_docs):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(4, None), (3, ""), (9, long), (8, long + " tail"), (None, long), (2, "Other words"), (2, "other  words"), (5, " \n")]
    docs = make_docs(rows, ["1 AS node", "2 AS size", "3 AS file", "4 AS _file", "5 AS _row", "6 AS _f"])
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert found == sorted(
        [(4, 0, 4, True), (3, 0, 3, True), (5, 0, 5, True), (9, 29996, 8, False), (8, 29997, 8, True), (None, 29996, 8, False), (2, 1, 2, True), (2, 1, 2, False)], key=str
    )
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 8]
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_shingles_are_sets_of_runs():
    text = "A b\tc D e  a B c d E a b c d e"
    words = text.lower().split()
    assert len(odd_sketch.shingle_hashes(text, 5)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    same = lambda a, b: np.array_equal(odd_sketch.shingle_hashes(a, 5), odd_sketch.shingle_hashes(b, 5))
    assert same("x Y", "X\n y") and not same("x y", "y x") and not same("É", "é") and not same("a b c d", "a b c d a")
    assert len(odd_sketch.shingle_hashes(re.sub("a", " ", "aaa"), 5)) == 0


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_sketches_estimate(spark, similarity):
    draw, settings = np.random.default_rng(4), plan(0.85)
    bits, agree = [], []
    for _ in range(60):
        both = draw.integers(0, 1 << 63, 2000, np.uint64)
        n = round(1000 * 2 * similarity / (1 + similarity))
        a, b = both[:1000], np.concatenate([both[:n], both[1000 : 2000 - n]])
        x, y = (odd_sketch.min_hashes(np.unique(s), settings.samples) for s in (a, b))
        agree.append((x == y).mean())
        bits.append(int(np.unpackbits((odd_sketch.fold(x) ^ odd_sketch.fold(y)).view(np.uint8)).sum()))
    assert abs(np.mean(agree) - similarity) < 0.03
    frame = spark.createDataFrame([(b,) for b in bits], "z int")
    found = [r[0] for r in frame.select(odd_sketch.estimate(frame.z, settings.samples)).collect()]
    assert abs(np.mean(found) - similarity) < 0.04


def test_plan():
    for similarity in (0.8, 0.85):
        settings = plan(similarity)
        assert settings.miss <= 1e-10 and 0 < settings.most_apart() < 2 * settings.samples
