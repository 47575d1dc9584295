import re
from itertools import permutations

import pytest
from made_texts import words

from oddsmith.llm import filter_audit
from oddsmith.llm._shared import table


def failures(rows):
    """Part, failing letters and id of each row, by looking at every earlier text."""
    found = []
    for doc_id, part, text in rows:
        text = text or ""
        seq = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(seq) < 200:
            fails.add("A")
        if 100 * len(set(seq)) < 50 * len(seq):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(
            o is not None and o < doc_id and (t or "") == text for o, _, t in rows
        ):
            fails.add("E")
        found.append((part or "", fails, doc_id))
    return found


def expected(rows, good, toxic):
    failing = failures(rows)
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {p for p, _, _ in failing}:
        mine = [(f, i) for p, f, i in failing if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                left = [(f, i) for f, i in left if letter not in f]
                total[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for f, _ in mine) - len(gone),
                    sum(f == {letter} for f, _ in mine),
                    sum(i in good for _, i in gone),
                    sum(i in toxic for _, i in gone),
                ]
        for order in orders:
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(total[letter])
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIGURES] for r in df.collect()}


def rows_of(docs):
    return [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, 0, "y"), (4, None, 1, None), (None, 1, 1, "z"), (5, 1, None, "")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = found(filter_audit.audit_report(odd, labels))
    assert got == expected(rows_of(odd), {1, 2, 5}, {2, 4})
    assert found(filter_audit.audit_report(odd, labels.limit(0))) == expected(rows_of(odd), set(), set())
    assert filter_audit.audit_report(none, labels).collect() == []


@pytest.mark.parametrize("shares", [512, 4])
def test_a_text_that_holds_a_third_of_the_rows(spark, monkeypatch, shares):
    monkeypatch.setattr(filter_audit, "HOT_SHARES", shares)
    hot = " ".join(words(3, 250))
    texts = [hot if k % 3 == 0 else " ".join(words(k % 40, 150 + k % 90)) for k in range(300)]
    rows = [(k if k % 50 else None, f"s{k % 2}", t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, source string, text string")
    labels = spark.createDataFrame(
        [(k, int(k % 4 == 0), int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int"
    )
    good, toxic = {k for k in range(200) if k % 4 == 0}, {k for k in range(200) if k % 5 == 0}
    got = found(filter_audit.audit_report(docs.repartition(7), labels))
    assert got == expected(rows_of(docs), good, toxic)


def test_equal_hashes_of_different_texts(spark, documents, monkeypatch):
    """The join compares texts: with a poor hash nothing else becomes a copy."""
    rows = filter_audit._rows(documents, "text", "doc_id", "source")
    poor = rows.withColumn("hash", rows["hash"].bitwiseAND(7))
    plain = filter_audit.copies(rows, rows.select(*filter_audit._ROW)).select("doc_id")
    same = filter_audit.copies(poor, poor.select(*filter_audit._ROW)).select("doc_id")
    want = sorted(i for _, f, i in failures(rows_of(documents)) if "E" in f)
    assert sorted(r[0] for r in plain.collect()) == sorted(r[0] for r in same.collect()) == want


def test_given_documents(spark, small, documents):
    labels = table(spark, small, "labels")
    rows = labels.collect()
    good = {r["doc_id"] for r in rows if r["quality"] == 1}
    toxic = {r["doc_id"] for r in rows if r["toxic"] == 1}
    got = found(filter_audit.audit_report(documents, labels))
    assert got == expected(rows_of(documents), good, toxic)
