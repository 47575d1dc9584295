"""Byte-pair merging of one word: a heap of adjacent pairs over a linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

# Fixed value: Unicode white space, as the inside of a character class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

Merges = dict[tuple[int, int], tuple[int, int]]  # pair of symbols: rank, merged symbol


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the
    characters from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def merge_table(model: dict) -> Merges:
    """Ranks and results of the merges of a vocabulary file's model."""
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}


def merge(symbols: list[int], merges: Merges) -> int:
    """Merge in place, lowest rank and leftmost first; merged-away places become -1.

    Returns the number of merges.
    """
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found is not None:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    if not heap:
        return 0
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    done = 0
    while heap:
        _, i, left, right, merged = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = merged, -1
        k = after[i] = after[j]
        done += 1
        if k < n:
            before[k] = i
            found = merges.get((merged, symbols[k]))
            if found is not None:
                heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((symbols[h], merged))
            if found is not None:
                heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return done


def merge_short(symbols: list[int], merges: Merges) -> None:
    """The same result for a short word, looking at all its pairs each time; the list shrinks."""
    while len(symbols) > 1:
        best, at = None, 0
        for i in range(len(symbols) - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found is not None and (best is None or found[0] < best[0]):
                best, at = found, i
        if best is None:
            return
        symbols[at : at + 2] = [best[1]]
