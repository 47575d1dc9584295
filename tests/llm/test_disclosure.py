import math
import random
import re
from hashlib import sha256

import numpy as np

from oddsmith.llm import disclosure
from oddsmith.llm._shared import bit_mask, grouped_mask

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19]
    found += [("card", m) for m in cards if luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in found)


def test_base_spans_on_made_strings():
    chosen = random.Random(3)
    for letters, most in (("aB1.@-_+ é", 40), ("0123456789. -+()", 60), ("01.@a", 30), ("4 -0", 50)):
        for _ in range(4000):
            text = "".join(chosen.choice(letters) for _ in range(chosen.randint(0, most)))
            assert disclosure._written(disclosure.base_spans(text)) == plain(text), repr(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "a@" * 50_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "+1 " + "(" * 200_000):
        disclosure.base_spans(text)


def test_report(odd, documents, texts, none):
    for r in disclosure.report(documents).collect():
        base = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert [kinds.count(k) for k in disclosure.KINDS] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
    rows = disclosure.report(odd).collect()
    assert len(rows) == odd.count()
    (mail,) = [r for r in rows if r["doc_id"] == 10]
    assert mail["spans"] == "email:9:32,ip:36:46"
    assert disclosure.report(none).collect() == [] and disclosure.sanitise(none).collect() == []


def test_terms_that_give_an_entity_away(spark):
    """A rare word that stands with one address is removed, a common word is left."""
    told = "the grandmaster wrote from jo@mail.example.com about chess"
    rows = [(k, f"{told} again {k}") for k in range(4)]
    rows += [(k, "the people wrote about nothing from here again") for k in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in disclosure.report(docs).collect()}
    start = told.index("grandmaster")
    assert f"removed:{start}:{start + 11}" in found[0]["spans"]
    assert "wrote" not in [told[int(a) : int(b)] for _, a, b in (s.split(":") for s in found[0]["spans"].split(","))]
    assert all(found[k]["spans"] == "" for k in range(10, 400))
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert clean[0] == "the  wrote from [EMAIL] about  again 0"
    assert clean[10] == rows[4][1]


def test_disclosure_against_plain_counts(spark):
    chosen = random.Random(8)
    rows = []
    for k in range(120):
        seq = [chosen.choice(["alpha", "beta", "gamma", "delta", "rare" + str(k % 30)]) for _ in range(30)]
        if k % 3 == 0:
            seq.insert(chosen.randint(0, 30), f"p{k % 4}@x.org")
        rows.append((k, " ".join(seq)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import math

    terms_in = {k: set(t.split()) for k, t in rows}
    pairs, having = {}, {}
    for k, t in rows:
        seq = t.split()
        for at, word in enumerate(seq):
            if "@" in word:
                having.setdefault(word, set()).add(k)
                for near in seq[max(0, at - 8) : at] + seq[at + 1 : at + 9]:
                    if len(near) >= 4 and "@" not in near:
                        pairs.setdefault((word, near), set()).add(k)
    want = 0
    for (entity, term), both in pairs.items():
        n_term = sum(term in terms for terms in terms_in.values())
        own = math.log2(120 / len(having[entity]))
        share = math.log2(120 * len(both) / (n_term * len(having[entity]))) / own
        want += len(both) >= 2 and share >= 0.7
    found = disclosure.entities(docs)
    assert disclosure.disclosing_pairs(docs, found).count() == want


def test_terms_far_from_the_entity_and_in_other_documents(spark):
    told = "grandmaster " + "so it is and " * 10 + "jo@mail.example.com " + "so it is and " * 10 + "grandmaster"
    rows = [(k, told) for k in range(4)] + [(4, "here is the Grandmaster of it")]
    rows += [(k, "so it is and it is the one of here") for k in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"].split(",") for r in disclosure.report(docs, whole=True).collect()}
    last = len(told) - 11
    assert [s for s in found[0] if "removed" in s] == ["removed:0:11", f"removed:{last}:{last + 11}"]
    assert found[4] == ["removed:12:23"] and found[10] == [""]
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs, whole=True).collect()}
    assert clean[4] == "here is the  of it" and "grandmaster" not in clean[0]


def test_whole_documents_against_plain_shares(spark):
    """One document with both is enough, and short words and numbers are terms."""
    import math

    chosen = random.Random(5)
    common = ["alpha", "beta", "it", "of"]
    rows = []
    for k in range(90):
        seq = [chosen.choice([*common, f"r{k % 30}", str(k), f"w{k % 9}"]) for _ in range(25)]
        if k % 5 == 0:
            seq.insert(chosen.randint(0, 25), f"p{k % 20}@x.org" if k % 15 else f"one{k}@x.org")
        rows.append((k, " ".join(seq)))
    held = {k: set(t.split()) for k, t in rows}
    having = {}
    for k, words in held.items():
        for word in words:
            having.setdefault(word, set()).add(k)
    action = {}
    for entity in [w for w in having if "@" in w]:
        own = math.log2(90 / len(having[entity]))
        for term in {w for k in having[entity] for w in held[k] if "@" not in w}:
            both = len(having[entity] & having[term])
            share = math.log2(90 * both / (len(having[term]) * len(having[entity]))) / own
            if share >= 0.7:
                action[term] = max(action.get(term, ""), "removed" if share >= 0.9 else "general")
    assert any(a == "general" for a in action.values()) and any(t.isdigit() for t in action)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in disclosure.report(docs, whole=True).collect()}
    for k, text in rows:
        want, at = [], 0
        for word in text.split(" "):
            if word in action:
                want.append((action[word], at, at + len(word)))
            at += len(word) + 1
        terms = ",".join(f"{a}:{b}:{c}" for a, b, c in sorted(want))
        assert found[k] == ",".join(filter(None, [plain(text), terms]))


def test_masks_united_by_words(spark):
    bits = [0, 1, 7, 8, 63, 64, 100, 4095, 100]
    df = spark.createDataFrame([(b,) for b in bits], "bit int").repartition(3)
    mask = np.unpackbits(grouped_mask(df, 4096)).astype(bool)
    assert sorted(set(bits)) == np.flatnonzero(mask).tolist()
    assert (grouped_mask(df, 4096) == bit_mask(df, 4096)).all()


def test_one_text_of_many_addresses_and_words(spark, monkeypatch):
    """Addresses of the same documents count once, so their terms are not paired with each of them."""
    many = " ".join(f"a{k}@b{k}.example.com word{k}" for k in range(5000))
    other = " ".join(f"word{k} a7@b7.example.com" for k in range(0, 50, 2))
    rows = [(1, many), (2, other), (3, "word1 word2 plain"), *((k, f"text {k} here") for k in range(4, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.landed(disclosure.entities(docs, whole=True), "test-entities")
    got = {r["term"]: (r["n_term"], r["action"]) for r in disclosure.disclosing_terms(docs, found).collect()}
    entities = {f"a{k}@b{k}.example.com": {1, 2} if k == 7 else {1} for k in range(5000)}
    words = {f"word{k}": {1} for k in range(5000)}
    for k in range(0, 50, 2):
        words[f"word{k}"].add(2)
    for k in (1, 2):
        words[f"word{k}"].add(3)
    strengths = {}
    for documents in {frozenset(v) for v in entities.values()}:
        own = math.log2(len(rows) / len(documents))
        for word, places in words.items():
            both = len(documents & places)
            if both:
                share = math.log2(len(rows) * both / (len(places) * len(documents))) / own
                strengths[word] = max(strengths.get(word, 0), share)
    want = sorted(
        (len(words[w]), "removed" if s >= 0.9 else "general") for w, s in strengths.items() if s >= 0.7
    )
    assert sorted(got.values()) == want
