import zlib

import numpy as np
import pytest

from partloom.llm import langid
from partloom.llm.langid import drop_unidentified, fold, identify, train, windows_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs.select("doc_id", "text", "lang")).collect()
    tested = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["lang_pred"] == r["lang"] for r in tested)
    assert len(tested) > 150 and right / len(tested) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_windows_hold_every_byte():
    texts = [b"", b"a", b"X" * 256, b"y" * 1000]
    grid, owner, used = windows_of(texts)
    back = [b"".join(grid[i, : used[i]].tobytes() for i in range(len(grid)) if owner[i] == t) for t in range(4)]
    assert back == [t.lower() for t in texts]


def test_compiled_tables_are_the_convolution():
    net = train([("a", "hello there"), ("b", "xyz zyx " * 90)], epochs=1)
    grid, _, _ = windows_of([b"hello xyz " * 40])
    got = net.log_probabilities(grid, net.compiled())
    pooled = [
        sum(taps[j][grid[:, j : j + langid.WINDOW - w + 1]] for j in range(w)).max(axis=1) for w, taps in zip(langid.WIDTHS, net.filters)
    ]
    scores = np.maximum(np.concatenate(pooled, axis=1) + net.shifts, 0) @ net.weights + net.bias
    assert np.allclose(got, scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)), atol=1e-4)


EN, FR = "the cat is on the mat and it was there ", "le chat est sur la table et il était là "


def test_the_label_is_not_an_input(make_docs):
    rows = [(i, (EN if i % 2 else FR) * 3, "en" if i % 2 else "fr", None) for i in range(80)]
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(make_docs(rows)).collect()}
    hidden = [(i, t, None if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    assert plain == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(make_docs(hidden)).collect()}
    assert all(p == ("en" if i % 2 else "fr") for i, (p, _) in plain.items())


def test_edge_cases(make_docs):
    rows = [(i, (EN if i % 2 else FR) * 2, "en" if i % 2 else "fr", None) for i in range(40)]
    rows += [(100, None, "en", None), (101, "", "fr", None), (102, "12 34 !", "en", None), (None, EN, None, None), (1, EN, "en", None), (103, EN * 20000, None, None)]
    docs = make_docs(rows, ["1 AS score", "2 AS lang_pred"])
    found = identify(docs)
    assert found.columns == [*docs.columns, "lang_pred_", "score_"]
    got = [(r["doc_id"], r["lang_pred_"], r["score_"]) for r in found.collect()]
    assert [g for g in got if g[0] in (100, 101, 102)] == [(i, "und", 0.0) for i in (100, 101, 102)]
    assert {g[1] for g in got if g[0] in (None, 103)} == {"en"}
    kept = drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert identify(docs.limit(0)).count() == 0
    none = identify(make_docs([(1, "text", None, None)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


@pytest.mark.parametrize("value", [None, 0, 7, -3, 123456789])
def test_fold(spark, value):
    frame = spark.createDataFrame([(value,)], "doc_id long")
    assert frame.select(fold("doc_id")).first()[0] == zlib.crc32(str("" if value is None else value).encode()) % 4
