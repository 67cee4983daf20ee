import random

import numpy as np

from partloom.llm import langid
from partloom.llm.langid import drop_unidentified, sample, train, windows_of


def brute_sure(net, text):
    """Mean over bytes of the highest probability of the window that holds the byte."""
    grid, _, used = windows_of([text.encode()])
    top = [np.exp(net.log_probabilities(g[None, :], net.compiled())[0].max()) for g in grid]
    return sum(p * n for p, n in zip(top, used)) / sum(used)


def test_the_network_decides(spark, documents, make_docs):
    draw = random.Random(3)
    rows = [(r["doc_id"], r["text"], r["lang"], None) for r in documents.collect()]
    noise = [(10_000 + i, draw.randbytes(n).hex(), None, None) for i, n in enumerate((30, 200, 300, 1000, 3000))]
    several = [(20_000, "".join(next(r[1] for r in rows if r[2] == k and len(r[1]) > 600)[:512] for k in ("en", "de", "fr")), None, None)]
    docs = make_docs(rows + noise + several)
    net = train(sample(docs, "doc_id", "text", "lang", 2))
    sure = {r[0]: brute_sure(net, r[1]) for r in noise + several}
    kept = {r["doc_id"] for r in drop_unidentified(docs).collect()}
    assert {r[0] for r in rows} <= kept and 20_000 in kept
    assert kept & {r[0] for r in noise} == {i for i, p in sure.items() if i < 20_000 and p >= langid.LEAST_SURE}
    assert len(kept) < len(rows) + 1 + len(noise)


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "some text"), (2, "12 34"), (3, None), (4, "été")])
    assert sorted(r["doc_id"] for r in drop_unidentified(docs).collect()) == [1, 4]
