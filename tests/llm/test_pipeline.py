import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from partloom.llm.queries import MIX_SEED, MIX_WEIGHTS, TOKENIZER
from tests.llm.test_mixing import brute_count
from tests.llm.test_odd_sketch import brute


def brute_kept(rows):
    """Exact copies and near copies, one after the other, by comparing everything with everything."""
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    label, pairs = brute([(r["doc_id"], r["text"]) for r in first.values()], 80, True)
    assert pairs
    return [r for r in first.values() if label[r["doc_id"]][1] == r["doc_id"]]


def brute_copies(rows):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"])
    size = {k: v for k, v in size.items() if k in MIX_WEIGHTS}
    total = math.fsum(MIX_WEIGHTS[k] for k in MIX_WEIGHTS)
    rate = {k: MIX_WEIGHTS[k] / total * sum(size.values()) / v for k, v in size.items()}
    return {r["doc_id"]: brute_count(MIX_SEED, r["doc_id"], rate[r["source"]]) if r["source"] in rate else 1 for r in rows}


def test_run(spark, sf, documents):
    kept = brute_kept(corpus_pipeline.language(spark, documents, sf).collect())
    copies = {i: n for i, n in brute_copies(kept).items() if n}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokens = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept}
    covered, windows = defaultdict(Counter), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: {*c.values()} for i, c in covered.items()} == {i: {n} for i, n in copies.items()}
    assert all(len(c) == tokens[i] for i, c in covered.items())
    for parts in windows.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def test_stages_keep_the_columns_of_documents(spark, sf, documents):
    docs = documents.limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == documents.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_clashing_names(spark, sf, documents):
    names = ["node", "key", "keys", "sketch", "size", "component", "file", "row", "_file", "_row", "a", "b", "digest", "copy", "first"]
    docs = documents.limit(40).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert corpus_pipeline.sequences(spark, docs, sf).agg(F.countDistinct("doc_id")).first()[0] == 40


def test_clean_documents_stay(spark, sf, documents):
    kept = corpus_pipeline.language(spark, documents, sf)
    digest = lambda rows: sorted(hashlib.md5(r["text"].encode()).hexdigest() for r in rows)
    assert digest(kept.collect()) == digest(documents.collect())
