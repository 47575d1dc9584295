import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oddsmith.llm import bpe, token_counts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def strings():
    chosen = random.Random(4)
    letters = "aA's \n\t12.é!Σ\x1c <|>µ日 "
    made = ["".join(chosen.choice(letters) for _ in range(chosen.randint(0, 50))) for _ in range(1500)]
    return [*made, "", " ", "a  b\n\n c ", "x" * 5000, "<|endoftext|>a<|endoftext|>", "<|EndOfText|>", "ΟΔΟΣ"]


def test_counts_are_the_library_s():
    library = Tokenizer.from_file(BYTES)
    with open(BYTES, encoding="utf-8") as file:
        count = token_counts.text_counter(file.read())
    for text in strings():
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_words_encode_as_the_library_does():
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    for text in strings():
        ids = [i for word in vocabulary.words(text) for i in vocabulary.encode(word)]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_rows(odd, none):
    library = Tokenizer.from_file(BYTES)
    rows = token_counts.token_counts(odd, BYTES).collect()
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "").ids))
        for r in odd.collect()
    ]
    assert sorted([r[:3] for r in rows], key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_counts.token_counts(none, BYTES).collect() == []


@pytest.mark.parametrize("frequent", [bpe.FREQUENT, 20, 0])
def test_round_trip(odd, none, frequent):
    library = Tokenizer.from_file(WORDS)
    coded = bpe.decode(bpe.encode(odd, WORDS, frequent=frequent), WORDS)
    rows = [(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in coded.collect()]
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r["doc_id"], data, library.decode(ids, skip_special_tokens=False)))
    assert sorted(rows, key=str) == sorted(want, key=str)
    at_once = bpe.encode(odd, WORDS, frequent=frequent, decoded=True).collect()
    assert sorted([(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in at_once], key=str) == sorted(want, key=str)
    assert bpe.encode_report(none, WORDS).collect() == []


def test_each_distinct_word_once(odd):
    rows = bpe.word_table(odd, WORDS).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    assert sum(r["n"] for r in rows) > len(rows)
