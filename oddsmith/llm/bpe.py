"""Byte-pair encoding and decoding over a table of distinct words.

Texts are split into words at white space, as the tokenizer's pieces never cross it. Every distinct
word of the corpus is encoded once. Ids come back to the texts by position: the most frequent words
(a bounded number) by a broadcast part of the table, all others by joining each text's rare words,
with their positions, to the table. Decoding looks up each id's piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from oddsmith.llm._merges import SPACE, byte_symbols, merge, merge_short, merge_table
from oddsmith.llm._shared import TEXT_ROWS, by_frequency, landed
from oddsmith.llm._words import texts_of

# Words whose ids are broadcast, at most; the others are joined.
FREQUENT = 1 << 19
# Distinct words that a task holds before it hands its counts on.
HELD = 1 << 19
_ROWS_OUT = 256
# Words of so many bytes are merged by looking at all their pairs.
_SHORT = 24
# The separators that str.split takes for white space beyond Unicode's; the split rule
# within a word.
SEPARATORS = "\x1c\x1d\x1e\x1f"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^SPACE\p{L}\p{N}]+".replace("SPACE", SPACE)


class Splitter:
    """Splits texts into words: lower case, composed characters, white space dropped.

    ``special`` holds the special strings and their ids.
    """

    def __init__(self, special: dict[str, int]):
        self.special = special
        strings = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._cut = re.compile(f"({strings})") if strings else None
        self._blank = re.compile(f"[{SPACE}]+")

    def words(self, text: str) -> list[str]:
        """The text's words in order; a special string is a word of its own, marked by a space."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain_words(text)
        found: list[str] = []
        for part in self._cut.split(text):
            found.extend([f" {part}"] if part in self.special else self._plain_words(part))
        return found

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii():
            # lower-cased letter by letter, without a form for the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in SEPARATORS):
            return [w for w in self._blank.split(text) if w]
        return text.split()


class Vocabulary(Splitter):
    """A word-end vocabulary file."""

    def __init__(self, described: str):
        import regex

        read = json.loads(described)
        super().__init__({t["content"]: t["id"] for t in read["added_tokens"]})
        model = read["model"]
        self.ids = model["vocab"]
        self.ending = model["end_of_word_suffix"] or ""
        self.merges = merge_table(model)
        self.symbols = byte_symbols()
        self.pieces = regex.compile(PIECES).findall

    def encode(self, word: str) -> list[int]:
        if word.startswith(" "):
            return [self.special[word[1:]]]
        found = []
        for piece in [word] if word.isalpha() else self.pieces(word):
            letters = [self.symbols[b] for b in piece.encode("utf-8")]
            letters[-1] += self.ending
            symbols = [self.ids[x] for x in letters]
            if len(symbols) <= _SHORT:
                merge_short(symbols, self.merges)
                found += symbols
            else:
                merge(symbols, self.merges)
                found += [s for s in symbols if s >= 0]
        return found

    def by_id(self) -> list[str]:
        """The piece of each id."""
        every = {**self.ids, **self.special}
        named = {i: s for s, i in every.items()}
        return [named.get(i, "") for i in range(max(named) + 1)]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def word_table(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``word, n, ids``: every distinct word, how often it occurs, and its ids (32-bit, binary).

    Null texts have no words. Counts are combined in the task before the shuffle.
    """
    content = _read(vocabulary)
    described = docs.sparkSession.sparkContext.broadcast(content)
    special = Vocabulary(content).special

    def rows(seen: dict[str, int]):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    def counted(batches):
        known, seen = Splitter(special), Counter()
        for batch in batches:
            for value in texts_of(batch, 0):
                seen.update(known.words(value))
                if len(seen) >= HELD:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    def encoded(batches):
        known = None
        for batch in batches:
            known = known or Vocabulary(described.value)
            ids = [np.array(known.encode(w), "<u4").tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary())],
                names=["word", "n", "ids"],
            )

    words = docs.selectExpr(f"`{text}` text").mapInArrow(counted, "word string, n long")
    distinct = words.groupBy("word").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(encoded, "word string, n long, ids binary")


def encode(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    doc_id: str = "doc_id",
    frequent: int = FREQUENT,
    decoded: bool = False,
) -> DataFrame:
    """One row a document: ``doc_id, ids`` (binary, little-endian unsigned 32-bit numbers).

    ``decoded`` adds the text that ``decode`` gives, in the same pass. Null, empty and blank texts
    have no ids. Special strings in a text are their own id. Texts of any length are encoded
    whole. Repeated rows each give a row. An empty table gives no rows. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    vocabulary_file = Vocabulary(_read(vocabulary))
    special = vocabulary_file.special
    by_id = spark.sparkContext.broadcast(vocabulary_file.by_id() if decoded else None)
    table = landed(word_table(docs, vocabulary, text), "bpe-words", TEXT_ROWS)
    often, seldom = by_frequency(table, "n", frequent)
    top = often.orderBy(F.desc("n"), "word").select("word", "ids").toArrow()
    ids = top.column("ids").to_pylist()
    known = spark.sparkContext.broadcast(top.column("word"))
    flat = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.array([len(i) // 4 for i in ids] + [0], np.int64)
    coded = spark.sparkContext.broadcast((flat, sizes))
    hole = len(ids)

    def ranks():
        return {word: rank for rank, word in enumerate(known.value.to_pylist())}

    def rare_words(batches):
        reader, table = Splitter(special), ranks()
        for batch in batches:
            for start in range(0, len(batch), _ROWS_OUT):
                part = batch.slice(start, _ROWS_OUT)
                rare = [[w for w in reader.words(v) if w not in table] for v in texts_of(part, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rare, pa.list_(pa.string()))], names=["key", "rare"]
                )

    def ranked(batches):
        reader, rank = Splitter(special), ranks().get
        for batch in batches:
            for start in range(0, len(batch), _ROWS_OUT):
                part = batch.slice(start, _ROWS_OUT)
                packed = [_pack([rank(w, hole) for w in reader.words(v)]) for v in texts_of(part, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(packed, pa.binary())],
                    names=["doc_id", "key", "packed"],
                )

    keyed = docs.selectExpr(
        f"cast(`{doc_id}` as bigint) doc_id",
        f"unhex(md5(coalesce(`{text}`, ''))) key",
        f"`{text}` text",
    )
    positions = (
        keyed.select("key", "text")
        .mapInArrow(rare_words, "key binary, rare array<string>")
        .select("key", F.posexplode("rare").alias("position", "word"))
    )
    # The position as four bytes in front of the ids: such values sort by position.
    place = F.unhex(F.lpad(F.hex("position"), 8, "0"))
    found = positions.join(seldom.select("word", "ids"), "word").groupBy("key")
    filled = landed(
        found.agg(F.sort_array(F.collect_set(F.concat(place, F.col("ids")))).alias("rare")),
        "bpe-rare",
        TEXT_ROWS,
    )
    sequences = keyed.mapInArrow(ranked, "doc_id long, key binary, packed binary")

    def whole(batches):
        flat, sizes = coded.value
        places = np.cumsum(sizes) - sizes
        pieces = np.array(by_id.value, object) if decoded else None
        for batch in batches:
            for start in range(0, len(batch), _ROWS_OUT):
                part = batch.slice(start, _ROWS_OUT)
                rows = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ids = [_ids(_unpack(packed), rare or [], flat, sizes, places) for packed, rare in rows]
                columns = {"doc_id": part.column(0), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([_text(i, pieces) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    joined = sequences.join(filled, "key", "left").select("doc_id", "packed", "rare")
    shape = "doc_id long, ids binary" + ", decoded string" * decoded
    return joined.mapInArrow(whole, shape)


def _pack(ranks: list[int]) -> bytes:
    """Word ranks in few bytes: lowest bytes first, then the higher ones, then coded by frequency."""
    planes = np.array(ranks, "<u4").view(np.uint8).reshape(-1, 4).T
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(planes.tobytes()) + coder.flush()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed, -15), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _ids(ranks: np.ndarray, rare: list[bytes], flat, sizes, places) -> bytes:
    """Ids of a text's words; ``rare`` are place and ids of the words without a rank, in order."""
    counts = sizes[ranks]
    holes = ranks == len(sizes) - 1
    counts[holes] = [len(r) // 4 - 1 for r in rare]
    before = np.cumsum(counts) - counts
    total = int(counts.sum())
    at = np.repeat(places[ranks] - before, counts) + np.arange(total)
    filled = np.repeat(holes, counts)
    at[filled] = 0
    found = flat[at] if len(flat) else np.zeros(total, "<u4")
    if rare:
        found[filled] = np.frombuffer(b"".join([r[4:] for r in rare]), "<u4")
    return found.astype("<u4").tobytes()


def _text(ids: bytes | None, pieces: np.ndarray) -> str:
    return " ".join(pieces[np.frombuffer(ids or b"", "<u4")].tolist())


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ids, parted by spaces.

    The table from id to piece is as long as the vocabulary and travels with the task. No ids, or
    null, give an empty text. Ids must lie inside the vocabulary.
    """
    by_id = encoded.sparkSession.sparkContext.broadcast(Vocabulary(_read(vocabulary)).by_id())
    rest = [c for c in encoded.columns if c.lower() not in (ids.lower(), "decoded")]

    def decoded(batches):
        pieces = np.array(by_id.value, object)
        for batch in batches:
            for start in range(0, len(batch), _ROWS_OUT):
                part = batch.slice(start, _ROWS_OUT)
                texts = [_text(v, pieces) for v in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"]
                )

    chosen = encoded.select(*rest, F.col(ids).alias("ids"))
    shape = StructType([*chosen.schema.fields, StructField("decoded", StringType())])
    return chosen.mapInArrow(decoded, shape)


def encode_report(docs: DataFrame, vocabulary: str, **columns: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the real ids and decoded texts."""
    digests = encode(docs, vocabulary, decoded=True, **columns).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return landed(digests, "bpe-digests", TEXT_ROWS)
