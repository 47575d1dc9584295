import zlib

from oddsmith.llm import quality
from oddsmith.llm._shared import table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))
    label = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    rows = rows.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    judged = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(p == y for p, y in judged) / len(judged) > 0.95


def test_held_out_labels_are_never_learnt(spark, documents, small):
    labels = table(spark, small, "labels")
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end quality"
    )
    assert (quality.fit(documents, labels) == quality.fit(documents, turned)).all()


def test_other_columns_are_not_inputs(spark, documents, small):
    labels = table(spark, small, "labels")
    weights = quality.fit(documents, labels)
    blank = documents.selectExpr("doc_id", "text", "'x' lang", "'y' source", "0L n_chars")
    assert (quality.fit(blank, labels) == weights).all()
    one = {r["doc_id"]: r["score"] for r in quality.score(documents, weights).collect()}
    two = {r["doc_id"]: r["score"] for r in quality.score(blank, weights).collect()}
    assert one == two


def test_odd_rows(spark, odd, none):
    schema = "doc_id long, quality int, text string"
    labels = spark.createDataFrame(
        [(1, 1, "a"), (1, 1, "b"), (2, 0, "c"), (3, None, None), (None, 1, "d"), (7, 1, ""), (7, 0, ""), (99, 1, "z")],
        schema,
    )
    rows = quality.quality_report(odd, labels).collect()
    assert len(rows) == odd.count()
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    assert quality.quality_report(none, labels).collect() == []
    unlabelled = spark.createDataFrame([], schema)
    assert {r["score"] for r in quality.quality_report(odd, unlabelled).collect()} == {0.5}
    kept = quality.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.keep_good(odd, labels, threshold=1.1).collect() == []
