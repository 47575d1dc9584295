"""Token counts by byte-pair merging with a heap and a linked list.

Texts are cut into pieces by the tokenizer's rule. Within a piece the adjacent pairs wait in a heap
by merge rank; the lowest is popped and merged in the linked list of symbols, and the pairs with its
new neighbours are pushed. The count is the initial symbols minus the merges; no ids are made.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from oddsmith.llm._merges import SPACE, byte_symbols, merge, merge_table
from oddsmith.llm._words import texts_of

LIMIT = 512
# Counts of chunks seen by a task; forgotten when so many are held.
REMEMBERED = 1 << 19
LONGEST_REMEMBERED = 64
# Fixed value: the split rule of byte-level tokenizers, with Unicode white space.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+"
).replace("SPACE", SPACE)
# The same cuts at white space alone: no piece crosses such a chunk's borders.
CHUNKS = " ?[^SPACE]+|[SPACE]+(?![^SPACE])|[SPACE]+".replace("SPACE", SPACE)


class MergeCounter:
    """Counts the tokens of one piece under a vocabulary file's merges."""

    def __init__(self, vocabulary: str):
        described = json.loads(vocabulary)
        ids = described["model"]["vocab"]
        self.merges = merge_table(described["model"])
        self.first = [ids[symbol] for symbol in byte_symbols()]
        self.special = [t["content"] for t in described["added_tokens"]]

    def count(self, piece: bytes) -> int:
        return len(piece) - merge([self.first[b] for b in piece], self.merges)


def text_counter(vocabulary: str):
    """A function from text to token count; special strings in a text count as one token."""
    import regex

    counter = MergeCounter(vocabulary)
    pieces = regex.compile(PIECES).findall
    chunks = re.compile(CHUNKS).findall
    special = regex.compile("|".join(regex.escape(s) for s in counter.special) or r"(?!)")
    known: dict[str, int] = {}

    def plain(text: str) -> int:
        nonlocal known
        total = 0
        missing = []
        for chunk in chunks(text):
            n = known.get(chunk)
            if n is None:
                missing.append(chunk)
            else:
                total += n
        for chunk in missing:
            n = known.get(chunk)
            if n is None:
                n = sum(counter.count(piece.encode("utf-8")) for piece in pieces(chunk))
                if len(chunk) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known = {}
                    known[chunk] = n
            total += n
        return total

    def count(text: str) -> int:
        parts = special.split(text)
        return sum(plain(part) for part in parts) + len(parts) - 1

    return count


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a byte-level vocabulary file, read once on the driver and sent to
    the tasks. Null and empty texts have no bytes and no tokens. Texts of any length are read whole.
    An empty table gives no rows. Other columns are not looked at.
    """
    with open(vocabulary, encoding="utf-8") as file:
        described = docs.sparkSession.sparkContext.broadcast(file.read())

    def counted(batches):
        count = None
        for batch in batches:
            count = count or text_counter(described.value)
            sizes, tokens = [], []
            for value in texts_of(batch, 1):
                sizes.append(len(value.encode("utf-8")))
                tokens.append(count(value))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
