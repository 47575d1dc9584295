from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from test_near_dups import plain
from tokenizers import Tokenizer

import __spark_entry__
from oddsmith.llm import mixing, quality
from oddsmith.llm._shared import landed, table


def test_stages_against_plain_code(spark, small, documents):
    """Each stage's rows follow from the rows of the one before."""
    good, single, apart, mixed, encoded = (f for _, f in corpus_pipeline.STAGES)
    one = landed(good(spark, documents, small), "test-good")
    weights = quality.fit(documents, table(spark, small, "labels"))
    fine = [r["doc_id"] for r in quality.score(documents, weights).collect() if r["score"] >= 0.7]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(fine)

    two = landed(single(spark, one, small), "test-single")
    last = defaultdict(list)
    for r in one.collect():
        last[r["text"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(max(ids) for ids in last.values())

    three = landed(apart(spark, two, small), "test-apart")
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    stay = [i for i, n, least in plain(rows, 5, 80) if n == 0 or i == least]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(stay)

    four = landed(mixed(spark, three, small), "test-mixed")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(three).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert documents.columns == one.columns == two.columns == three.columns == four.columns

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in four.collect()}
    five = encoded(spark, four, small).collect()
    assert Counter(r["doc_id"] for r in five) == Counter(r["doc_id"] for r in four.collect())
    assert all(r["n_tokens"] == count[r["doc_id"]] for r in five)


def test_odd_and_empty_documents(spark, odd, none, small):
    for docs in (odd, none):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = landed(stage(spark, rows, small), "test-odd")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, small).count() == rows.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
