import corpus_pipeline
from partloom.llm import simhash


def test_near_copies_are_linked_by_fingerprints_too(spark, sf):
    """Texts of much the same shingles by number but not by set: near fingerprints, a similarity far below 0.8."""
    a = "one two three four five six seven " * 60 + "eight nine ten eleven"
    b = "one two three four five six seven " * 60 + "alpha beta gamma delta"
    docs = spark.createDataFrame([(1, a), (2, b), (3, "something else altogether in these words")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {1, 3}
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == {1, 3}
