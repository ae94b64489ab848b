"""Passages of held-out test items inside a corpus, by greedy string tiling.

Test items are a query set: they are held against all documents in blocks of bounded size,
each block's seeds a sorted table that every task gets. A document's words are hashed, a
Karp-Rabin hash rolls over them, and windows that equal a seed, word by word, are joined with it. Runs of such
hits are the maximal common word sequences; the tiling repeatedly marks the longest one that is
not covered yet, so passages whose sentences were reordered still add up to their coverage.
There is no shuffle, and no document leaves its task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import folded, mostly_latin, speech, wide

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 1_000_000


class WordHash:
    """64-bit numbers of words; equal in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of each window of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * _BASE + tokens[j : j + n]
    return h


class Seeds:
    """All windows of the items: of ``width`` words, or of the whole item where it is shorter."""

    def __init__(self, items: list[np.ndarray], width: int) -> None:
        self.items, self.tables = items, []
        self.flat = np.concatenate([*items, np.zeros(0, np.uint64)])
        self.begins = np.cumsum([0, *[len(x) for x in items]])
        lengths = sorted({min(len(x), width) for x in items if len(x)})
        for w in lengths:
            owners = [i for i, x in enumerate(items) if min(len(x), width) == w]
            hashes = [rolling(items[i], w) for i in owners]
            h = np.concatenate(hashes)
            owner = np.repeat(owners, [len(x) for x in hashes])
            place = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            self.tables.append((w, h[order], owner[order], place[order]))

    def matches(self, tokens: np.ndarray, starts: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """(width, rows of document, item, place in the document, place in the item) of all seed hits of a batch.

        tokens: the words of all documents; starts: where each begins, and the end. Seeds that many items
        share are expanded for so many documents at a time that hits beyond ``most`` begin another
        part; a document's hits stay together. Equal hashes count only if the words are equal.
        """
        for w, table, owner, place in self.tables:
            h = rolling(tokens, w)
            if not len(h):
                continue
            left = np.searchsorted(table, h, "left")
            found = np.flatnonzero((left < len(table)) & (table[np.minimum(left, len(table) - 1)] == h))
            doc = np.searchsorted(starts, found, "right") - 1
            inside = found + w <= starts[doc + 1]
            found, doc = found[inside], doc[inside]
            if not len(found):
                continue
            first = left[found]
            times = np.searchsorted(table, h[found], "right") - first
            # Documents in parts of bounded expansion.
            by_doc = np.bincount(doc, times, len(starts) - 1)
            part = (np.cumsum(by_doc) - by_doc) // most
            for k in np.unique(part[doc]):
                own = part[doc] == k
                yield from self._verified(w, tokens, starts, found[own], doc[own], first[own], times[own], owner, place)

    def _verified(self, w: int, tokens: np.ndarray, starts: np.ndarray, found: np.ndarray, doc: np.ndarray, first: np.ndarray, times: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        row = np.repeat(first, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        at, item = np.repeat(found, times), owner[row]
        there = self.begins[item] + place[row]
        same = np.ones(len(at), bool)
        for j in range(w):
            same &= tokens[at + j] == self.flat[there + j]
        if same.any():
            doc = np.repeat(doc, times)[same]
            yield w, np.stack([doc, item[same], at[same] - starts[doc], place[row][same]])


def sequences(width: int, hits: np.ndarray) -> np.ndarray:
    """Maximal common sequences: rows of document, item, start in the document, start in the item, length."""
    doc, item, at, place = hits
    order = np.lexsort((at, at - place, item, doc))
    doc, item, at, place = doc[order], item[order], at[order], place[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(doc)]) + width - 1
    return np.stack([doc[first], item[first], at[first], place[first], length])


def tiling(found: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles: longest first, none overlapping in the document or the item, none under ``least`` words.

    found: rows of start in the document, start in the item, length.
    """
    base = found[0].min()
    in_doc = np.zeros(int((found[0] - base + found[2]).max()), bool)
    in_item = np.zeros(int((found[1] + found[2]).max()), bool)
    heap = [(-int(n), int(a - base), int(b)) for a, b, n in found.T]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = in_doc[a : a + n] | in_item[b : b + n]
        if not taken.any():
            in_doc[a : a + n] = True
            in_item[b : b + n] = True
            tiles.append(n)
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return tiles


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def read_through(words: np.ndarray, item: np.ndarray, at: int, place: int, length: int, gap: int, least: int = 3) -> int:
    """Length of a common sequence continued on either side of foreign lines of up to ``gap`` words, each part of ``least`` words or more."""
    total = length
    for step in (1, -1):
        a, b = (words[at + length :], item[place + length :]) if step == 1 else (words[:at][::-1], item[:place][::-1])
        while len(b) >= least:
            skip = next((g for g in range(1, min(gap, len(a)) + 1) if _shared(a[g : g + least], b) >= least), None)
            if skip is None:
                break
            more = _shared(a[skip:], b)
            total, a, b = total + more, a[skip + more :], b[more:]
    return total


def may_continue(tokens: np.ndarray, starts: np.ndarray, seeds: Seeds, found: np.ndarray, gap: int, least: int = 3) -> np.ndarray:
    """Which sequences :func:`read_through` could lengthen: ``least`` words of the item beside them stand a gap away in the document."""
    doc, item, at, place, length = found
    here, there = rolling(tokens, least), rolling(seeds.flat, least)
    out = np.zeros(len(doc), bool)
    if not len(here) or not len(there):
        return out
    begin, end, first, last = starts[doc], starts[doc + 1], seeds.begins[item], seeds.begins[item + 1]
    after, before = first + place + length, first + place - least
    for g in range(1, gap + 1):
        a, b = begin + at + length + g, begin + at - g - least
        ahead = (a + least <= end) & (after + least <= last)
        behind = (b >= begin) & (before >= first)
        out |= ahead & (here[np.where(ahead, a, 0)] == there[np.where(ahead, after, 0)])
        out |= behind & (here[np.where(behind, b, 0)] == there[np.where(behind, before, 0)])
    return out


def _blocks(items: DataFrame, item_id: str, passage: str, block_chars: int) -> Iterator[list]:
    """The items, a bounded part of them at a time."""
    chosen = items.select(F.col(item_id).alias("_item"), F.col(passage).alias("_passage")).where(F.length("_passage") > 0)
    size = chosen.agg(F.sum(F.length("_passage"))).first()[0] or 0
    count = -(-size // block_chars)
    for k in range(count):
        yield (chosen.where(F.pmod(F.xxhash64("_passage"), F.lit(count)) == k) if count > 1 else chosen).collect()


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    seed_words: int = 8,
    min_run: int = 16,
    min_coverage: float = 0.6,
    block_chars: int = 20_000_000,
    gap_words: int = 12,
) -> DataFrame:
    """Documents that carry a passage, whole or in part: ``doc_id, item_id, longest, covered, item_words, coverage, tiles``.

    longest: words of the longest common word sequence, which is the first tile; where it is under ``min_run``, foreign
    lines of up to ``gap_words`` words inside it are read through, the item's words being in a row still. covered: words of
    all tiles of at least ``seed_words`` words; coverage: covered / item_words. A pair is returned if
    longest >= ``min_run`` or coverage >= ``min_coverage``.

    Words are compared through cue numbers, times, line breaks, tags, speaker labels, sound
    descriptions, case, punctuation, misread characters and wrong encodings; passages mainly in
    other than Latin letters by their normalised words. Whole texts are read, whatever their length.
    Null and empty texts and passages match nothing; an item shorter than a seed must occur whole.
    Repeated documents and items, and null ids, each give their own rows. Empty input, empty result.
    """
    id_types = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {id_types[0]}, item_id {id_types[1]}, longest int, covered int, item_words int, coverage double, tiles int"
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    spark = documents.sparkSession
    result = spark.createDataFrame([], schema)
    for rows in _blocks(items, item_id, passage, block_chars):
        number = WordHash()
        parts = []
        for kind, reader in (("latin", folded), ("wide", wide)):
            own = [r for r in rows if mostly_latin(r["_passage"]) == (kind == "latin")]
            if own:
                arrays = [np.array(number(reader(speech(r["_passage"]))), np.uint64) for r in own]
                parts.append((kind, [r["_item"] for r in own], Seeds(arrays, seed_words)))
        shared = spark.sparkContext.broadcast(parts)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            number = WordHash()
            for batch in batches:
                spoken = [speech(t) for t in batch["text"]]
                out = []
                for kind, ids, seeds in shared.value:
                    reader = folded if kind == "latin" else wide
                    words = [number(reader(t)) for t in spoken]
                    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                    tokens = np.fromiter((h for w in words for h in w), np.uint64, int(starts[-1]))
                    for width, hits in seeds.matches(tokens, starts):
                        found = sequences(width, hits)
                        pair = np.flatnonzero(np.r_[True, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])])
                        ends = np.r_[pair[1:], found.shape[1]]
                        most, total = np.maximum.reduceat(found[4], pair), np.add.reduceat(found[4], pair)
                        size = np.array([len(seeds.items[i]) for i in found[1][pair]])
                        # The longest sequence is a tile, and tiles cover no more than all sequences together.
                        more = np.logical_or.reduceat(may_continue(tokens, starts, seeds, found, gap_words), pair)
                        for k in np.flatnonzero((most >= min_run) | (total >= min_coverage * size) | (more & (size >= min_run))):
                            own, doc, item = found[2:, pair[k] : ends[k]], int(found[0][pair[k]]), int(found[1][pair[k]])
                            longest = int(most[k])
                            if longest < min_run <= size[k]:
                                whole = tokens[starts[doc] : starts[doc + 1]]
                                longest = max(read_through(whole, seeds.items[item], *map(int, one), gap_words) for one in own.T)
                            if longest >= min_run or total[k] >= min_coverage * size[k]:
                                tiles = tiling(own, width)
                                covered = max(sum(tiles), min(longest, int(size[k])))
                                if longest >= min_run or covered >= min_coverage * size[k]:
                                    out.append((batch["doc_id"].iloc[doc], ids[item], longest, covered, int(size[k]), covered / int(size[k]), len(tiles)))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "covered", "item_words", "coverage", "tiles"])

        result = result.unionByName(source.mapInPandas(search, schema))
    return result
