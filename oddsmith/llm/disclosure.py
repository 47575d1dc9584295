"""Information-theoretic sanitisation of personal data.

Protected entities (mail and network addresses, card and phone numbers) are found by pattern. The
words around them are terms that may give them away even when the entity itself is taken out. How
much a term tells about an entity is estimated from the whole corpus: their pointwise mutual
information, log2(N n(t,e) / (n(t) n(e))) over documents, as a share of the entity's own information
log2(N / n(e)). Terms above one threshold are generalised, above a higher one removed.

With ``whole`` every word of a document with an entity is a term of it, and a disclosing term is
changed wherever it stands, in any document. Otherwise terms stand within ``WINDOW`` words of the
entity and are changed there only.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import grouped_mask, join_groups, landed
from oddsmith.llm._words import WordReader, Words, texts_of

# Without ``whole``: words on each side of an entity that may reveal it, the least bytes of such a
# word, and the least number of documents that show both together.
WINDOW, LEAST_BYTES, SUPPORT = 8, 4, 2
GENERALISE, REMOVE = 0.7, 0.9
# Bits of the mask of candidate terms that travels to the tasks; a chance hit costs a row, no more.
MASK_BITS = 24
# Distinct terms that a task holds before it hands its counts on.
HELD = 1 << 20
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "removed")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign and domain, leftmost first.

    A local part holds no at sign, so every match is found from its at sign outwards: to the left
    as far as its characters reach, but not into the match before.
    """
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of every entity, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    ips = _IP.finditer(text) if "." in text else ()
    found += [(1, *m.span()) for m in ips if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _entity(kind: int, matched: str) -> int:
    """The same number for the same entity, however it is written."""
    plain = matched.lower() if kind < 2 else _NO_DIGIT.sub("", matched)
    return int.from_bytes(blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


class _Contexts:
    """Terms around the entities of a text."""

    def __init__(self):
        self._reader = WordReader()
        self._lettered = np.zeros(256, np.int64)
        self._lettered[0x61:0x7B] = self._lettered[0x80:] = 1

    def _words(self, text: str) -> Words:
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.large_string())], names=["text"])
        return next(self._reader.read(batch, 0))

    def all(self, text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, start and end of every word outside the entities: places in code points."""
        words = self._words(text)
        point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        start, end = point[words.start], point[words.end]
        usable = np.ones(len(start), bool)
        for _, a, b in spans:
            usable[int(np.searchsorted(end, a, "right")) : int(np.searchsorted(start, b, "left"))] = False
        return words.hash.view(np.int64)[usable], start[usable], end[usable]

    def of(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
        """``(entity, term, start, end, first)``: places in code points; ``first`` of its kind here."""
        words = self._words(text)
        letters = np.concatenate([[0], np.cumsum(self._lettered[words.data])])
        point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        start, end = point[words.start], point[words.end]
        usable = (words.end - words.start >= LEAST_BYTES) & (letters[words.end] > letters[words.start])
        sides = []
        for kind, a, b in spans:
            low, high = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
            usable[low:high] = False
            sides.append((_entity(kind, text[a:b]), low, high))
        found, seen = [], set()
        terms = words.hash.view(np.int64)
        for entity, low, high in sides:
            near = [*range(max(0, low - WINDOW), low), *range(high, min(len(start), high + WINDOW))]
            for k in near:
                if usable[k]:
                    pair = (entity, int(terms[k]))
                    found.append((*pair, int(start[k]), int(end[k]), pair not in seen))
                    seen.add(pair)
        return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_FOUND = (
    "doc_id long, key binary, n_email long, n_ip long, n_card long, n_phone long, base string,"
    "entities array<long>, contexts array<struct<entity: long, term: long, start: int, end: int, first: boolean>>,"
    "terms array<long>"
)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.selectExpr(
        f"cast(`{doc_id}` as bigint) doc_id",
        f"unhex(md5(coalesce(`{text}`, ''))) key",
        f"`{text}` text",
    )


def entities(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: bool = False
) -> DataFrame:
    """Entities of each row, found in its whole text, and the terms around them.

    With ``whole`` the distinct terms of the text instead, if it has any entity.
    """

    def rows(batches):
        contexts, names = _Contexts(), ("entity", "term", "start", "end", "first")
        for batch in batches:
            counts, bases, named, around, terms = [[] for _ in KINDS], [], [], [], []
            for value in texts_of(batch, 2):
                spans = base_spans(value)
                for kind, column in enumerate(counts):
                    column.append(sum(s[0] == kind for s in spans))
                bases.append(_written(spans))
                named.append(sorted({_entity(k, value[a:b]) for k, a, b in spans}))
                near = contexts.of(value, spans) if spans and not whole else []
                terms.append(np.unique(contexts.all(value, spans)[0]) if spans and whole else [])
                around.append([dict(zip(names, c, strict=True)) for c in near])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            item = pa.struct(list(zip(names, kinds, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(bases, pa.string()),
                    pa.array(named, pa.list_(pa.int64())),
                    pa.array(around, pa.list_(item)),
                    pa.array(terms, pa.list_(pa.int64())),
                ],
                names=[
                    "doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "contexts", "terms",
                ],
            )

    return _keyed(docs, text, doc_id).mapInArrow(rows, _FOUND)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    each, back = np.unique(terms, return_inverse=True)
    return each, np.bincount(back, counts, len(each)).astype(np.int64)


def _term_rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(part[0].view(np.int64)), pa.array(part[1])]
    return pa.RecordBatch.from_arrays(arrays, names=["term", "n"])


def term_documents(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``term, n_term``: documents of the whole corpus that hold each of ``terms``.

    A mask of fixed size keeps words that cannot be among the terms out of the shuffle.
    """
    size = 1 << MASK_BITS
    bits = terms.select(F.expr(f"cast(term & {size - 1}L as int)").alias("bit"))
    sent = docs.sparkSession.sparkContext.broadcast(grouped_mask(bits, size))

    def counted(batches):
        reader, wanted, held = WordReader(), np.unpackbits(sent.value).astype(bool), []
        for batch in batches:
            for words in reader.read(batch, 0):
                hit = wanted[(words.hash & np.uint64(size - 1)).astype(np.int64)]
                term, row = words.hash[hit], words.row[hit]
                order = np.lexsort((row, term))
                term, row = term[order], row[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                held.append(np.unique(term[new], return_counts=True))
                if sum(len(t) for t, _ in held) >= HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) >= HELD:
                        yield _term_rows(held.pop())
        if held:
            yield _term_rows(_merged(held))

    found = docs.selectExpr(f"`{text}` text").mapInArrow(counted, "term long, n long")
    sums = found.groupBy("term").agg(F.sum("n").alias("n_term"))
    return terms.join(sums, "term")


def disclosing_pairs(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``entity, term, action`` of the pairs whose disclosure passes a threshold."""
    pairs = (
        found.select(F.explode("contexts").alias("c"))
        .filter("c.first")
        .groupBy("c.entity", "c.term")
        .agg(F.count("*").alias("n_both"))
        .filter(F.col("n_both") >= SUPPORT)
    )
    pairs = landed(pairs, "pii-pairs")
    documents = found.count()
    known = (
        found.select(F.explode("entities").alias("entity"))
        .groupBy("entity")
        .agg(F.count("*").alias("n_entity"))
    )
    terms = term_documents(docs, pairs.select("term").distinct(), text)
    own = F.log2(F.lit(float(max(documents, 1))) / F.col("n_entity"))
    mutual = F.log2(
        F.lit(float(max(documents, 1))) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))
    )
    share = F.when(own > 0, mutual / own)
    action = F.when(share >= REMOVE, "removed").when(share >= GENERALISE, "general")
    return (
        pairs.join(known, "entity")
        .join(terms, "term")
        .select("entity", "term", action.alias("action"))
        .filter("action is not null")
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``term, n_term, action`` of the terms that disclose any entity they share a document with.

    ``found`` are landed ``entities`` with ``whole``. A term in too many documents to reach the lower
    threshold, were it in all documents of the entity, is left out before pairs are counted.
    """
    documents = float(max(found.count(), 1))
    listed = found.filter(F.size("entities") > 0).select(
        F.monotonically_increasing_id().alias("row"), "entities", "terms"
    )
    listed = landed(listed, "pii-listed")
    named = landed(listed.select("row", F.explode("entities").alias("entity")), "pii-named")
    # entities of the same documents say the same of every term: one of them is enough
    rows_of = [F.bit_xor(F.xxhash64(F.lit(seed), "row")).alias(f"rows_{seed}") for seed in (1, 2)]
    known = named.groupBy("entity").agg(F.count("*").alias("n_entity"), *rows_of)
    alike = known.groupBy("n_entity", "rows_1", "rows_2").agg(F.min("entity").alias("entity"))
    known = landed(alike.select("entity", "n_entity"), "pii-known")
    words = landed(listed.select("row", F.explode("terms").alias("term")), "pii-words")
    counted = landed(term_documents(docs, words.select("term").distinct(), text), "pii-counted")
    own = F.log2(F.lit(documents) / F.col("n_entity"))
    possible = F.log2(F.lit(documents) / F.col("n_term")) >= GENERALISE * own - 1e-9
    both = (
        join_groups(named, known, "entity", "n_entity")
        .join(join_groups(words, counted, "term", "n_term"), "row")
        .filter((own > 0) & possible)
        .groupBy("entity", "term", "n_entity", "n_term")
        .agg(F.count("*").alias("n_both"))
    )
    mutual = F.log2(F.lit(documents) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    share = mutual / own
    action = F.when(share >= REMOVE, "removed").when(share >= GENERALISE, "general")
    acted = both.withColumn("action", action).filter("action is not null")
    return acted.groupBy("term", "n_term").agg(F.max("action").alias("action"))  # removed wins


def _all_term_spans(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """As ``_term_spans``, for every place in ``docs`` where a disclosing term stands."""
    terms = landed(disclosing_terms(docs, found, text), "pii-disclosing")
    size = 1 << MASK_BITS
    bits = terms.select(F.expr(f"cast(term & {size - 1}L as int)").alias("bit"))
    sent = docs.sparkSession.sparkContext.broadcast(grouped_mask(bits, size))

    def places(batches):
        reader, contexts, wanted = WordReader(), _Contexts(), np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for words in reader.read(batch, 1):
                hit = wanted[(words.hash & np.uint64(size - 1)).astype(np.int64)]
                keys, found = [], []
                for row in np.unique(words.row[hit]).tolist():
                    value = batch.column(1)[words.first + row].as_py()
                    term, start, end = contexts.all(value, base_spans(value))
                    kept = wanted[term & (size - 1)]
                    if kept.any():
                        found.append((term[kept], start[kept].astype(np.int32), end[kept].astype(np.int32)))
                        keys.append(batch.column(0)[words.first + row].as_py())
                if keys:
                    cuts = np.cumsum([0, *(len(term) for term, _, _ in found)]).astype(np.int32)
                    lists = [
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(c)))
                        for c in zip(*found, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), *lists], names=["key", "term", "start", "end"]
                    )

    keyed = _keyed(docs, text, doc_id).select("key", "text")
    packed = keyed.mapInArrow(places, "key binary, term array<long>, start array<int>, end array<int>")
    hits = landed(packed.withColumn("row", F.monotonically_increasing_id()), "pii-places")
    # a repeated row has the same places, so one of them is enough
    once = hits.groupBy("key").agg(F.min("row").alias("row"))
    single = hits.select("row", F.inline(F.arrays_zip("term", "start", "end")))
    each = join_groups(single, terms, "term", "n_term").filter("action is not null")
    spans = F.sort_array(F.collect_list(F.struct(F.col("action").alias("kind"), "start", "end")))
    changed = each.groupBy("row").agg(spans.alias("terms"))
    return landed(once.join(changed, "row").select("key", "terms"), "pii-terms")


def _term_spans(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """``key, terms``: kind, start and end of the terms to change, for each text that has any."""
    pairs = landed(disclosing_pairs(docs, found, text), "pii-disclosing")
    places = found.select("key", F.explode("contexts").alias("c")).select("key", "c.*")
    hits = places.join(pairs, ["entity", "term"]).groupBy("key", "start", "end")
    each = hits.agg(F.max("action").alias("kind"))  # removed wins over general
    spans = F.sort_array(F.collect_list(F.struct("kind", "start", "end")))
    return landed(each.groupBy("key").agg(spans.alias("terms")), "pii-terms")


def report(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: bool = False
) -> DataFrame:
    """One row a document: the counts of entities, ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive; after the entities stand the terms
    that disclose them, as kind ``general`` or ``removed``. Null and empty texts have no spans.
    Repeated rows each give a row and count as documents. An empty table gives no rows. Other
    columns are not looked at.
    """
    found = landed(entities(docs, text, doc_id, whole), "pii-entities")
    terms = _all_term_spans(docs, found, text, doc_id) if whole else _term_spans(docs, found, text)
    written = F.transform("terms", lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"]))
    joined = found.drop("contexts", "entities", "terms").join(terms, "key", "left")
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(written, ","))
    return joined.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
    )


def cleaned(text: str, terms: list[tuple[str, int, int]]) -> str:
    """``text`` with entities and general terms replaced by their kind, and removed terms left out."""
    spans = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base_spans(text)]
    spans += [(a, b, "[TERM]" if kind == "general" else "") for kind, a, b in terms]
    parts, at = [], 0
    for a, b, instead in sorted(spans):
        if a >= at:
            parts += [text[at:a], instead]
            at = b
        elif b > at:  # an entity that overlaps the one before: its rest goes too
            at = b
    return "".join(parts) + text[at:]


def sanitise(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: bool = False
) -> DataFrame:
    """``doc_id, text``: every document with its personal data and disclosing terms taken out.

    A null text stays null; other cases as in ``report``.
    """
    found = landed(entities(docs, text, doc_id, whole), "pii-entities")
    terms = _all_term_spans(docs, found, text, doc_id) if whole else _term_spans(docs, found, text)

    def rows(batches):
        for batch in batches:
            texts = [
                None if t is None else cleaned(t, [(s["kind"], s["start"], s["end"]) for s in spans or []])
                for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    joined = _keyed(docs, text, doc_id).join(terms, "key", "left").select("doc_id", "text", "terms")
    return joined.mapInArrow(rows, "doc_id long, text string")
