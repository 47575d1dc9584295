from collections import defaultdict
from hashlib import sha256

from oddsmith.llm import exact_dedup
from oddsmith.llm._shared import fresh_path


def test_report(odd, none):
    rows = exact_dedup.dedup_report(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[sha256((r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    assert len(rows) == odd.count()
    for r in rows:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (max(known) if known else None)
        assert r["group_size"] == len(ids)
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["keep_id"])
    assert exact_dedup.dedup_report(none).collect() == []


def test_the_index_remembers(spark, odd, none):
    path = fresh_path(spark, "test-index")
    index = exact_dedup.DigestIndex.open(spark, path, buckets=4)
    half = odd.filter("doc_id <= 4")
    first = exact_dedup.deduplicate(half, index, "first")
    assert first.columns == odd.columns
    assert sorted(r["doc_id"] for r in first.collect()) == [2, 3, 4]
    again = exact_dedup.DigestIndex.open(spark, path, buckets=4)
    second = exact_dedup.deduplicate(odd, again, "second").collect()
    ids = [r["doc_id"] for r in second]
    # Texts of 1 to 4 are known, the empty text of 5 is that of the null text of 4.
    assert sorted(i for i in ids if i is not None) == [6, 7, 8, 9, 10, 11, 12]
    assert ids.count(None) == 1
    assert exact_dedup.deduplicate(odd, again, "third").collect() == []
    assert exact_dedup.deduplicate(none, again, "fourth").collect() == []


def test_the_index_side_is_not_shuffled(spark, odd):
    index = exact_dedup.DigestIndex.open(spark, fresh_path(spark, "test-index"), buckets=4)
    new = exact_dedup.one_per_digest(exact_dedup.digests(odd))
    index.append(new, "first")
    plan = index.unseen(new)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    executed = index.unseen(new)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(text_sha256") <= 2
    executed = index.unseen(new, "second")._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(text_sha256") <= 2


def test_a_batch_can_be_run_again(spark, odd):
    """A job that failed before its rows were written gives them again; other batches do not."""
    path = fresh_path(spark, "test-index")
    index = exact_dedup.DigestIndex.open(spark, path, buckets=4)
    half = odd.filter("doc_id <= 4")
    first = sorted(map(str, exact_dedup.deduplicate(half, index, "first").collect()))
    second = sorted(map(str, exact_dedup.deduplicate(odd, index, "second").collect()))
    entries = index.table().count()
    index.close()
    again = exact_dedup.DigestIndex.open(spark, path, buckets=4)
    assert sorted(map(str, exact_dedup.deduplicate(odd, again, "second").collect())) == second
    assert sorted(map(str, exact_dedup.deduplicate(half, again, "first").collect())) == first
    assert again.table().count() == entries == again.table().select("text_sha256").distinct().count()
    assert exact_dedup.deduplicate(half, again, "third").collect() == []


def test_columns_named_like_the_working_ones(spark, odd):
    clash = odd.selectExpr("*", "'a' gone_id", "'b' GONE_SHA", "'c' _gone_id", "'d' batch", "'e' keep_id")
    index = exact_dedup.DigestIndex.open(spark, fresh_path(spark, "test-index"), buckets=4)
    plain = exact_dedup.DigestIndex.open(spark, fresh_path(spark, "test-index"), buckets=4)
    found = exact_dedup.deduplicate(clash, index, "first")
    assert found.columns == clash.columns
    assert {tuple(r)[-5:] for r in found.collect()} == {tuple("abcde")}
    want = exact_dedup.deduplicate(odd, plain, "first").collect()
    assert sorted(map(str, found.select(*odd.columns).collect())) == sorted(map(str, want))
