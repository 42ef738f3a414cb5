"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased and without punctuation at their ends. Every word 3-gram of an item is a seed, however
frequent it is. Seeds of one item on nearby diagonals (place in the document less place in the item) make a region, as
wide as the gaps of an alignment that reaches the needed score can make it. Regions that have too few words in common
with the item, in any order, for that score are left out, which loses none; with the others the item is aligned by
Smith-Waterman over words (match 2, other -1, gap -1 a word), many regions at a time. A document is a copy of an item
if the alignment scores ``LEAST_SCORE`` of the item's own score at least (and for short items ``SHORT``). So each
alignment of that score that matches three words in a row is found; copies without three words in a row are not.

The benchmark is the stated query set: it is taken in blocks of about ``BLOCK_BYTES`` of text, so that what is broadcast
has a bound, and no block depends on another; documents are never shuffled, collected or paired with each other. Places of seeds
are reduced to distinct diagonals ``HITS`` at a time, so that a frequent seed makes no table of all its pairs.

Defined results: null texts have no words; items of under three words have no seeds and match nothing; equal items of
different ids each match, and so does each item that is at the same place, whatever its score beside the others; each matching
row of documents gives one row an item, with the best of its scores, repeated or null ids too; empty tables give no rows; other
columns are kept by ``clean``, whatever their names, and not returned by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import ship, sliced, spread, text_bytes

GRAM = 3
LEAST_SCORE = 0.4
#: Items of few words need this score for each word, as long as it is less than SHORT_SCORE: most of their words.
SHORT, SHORT_SCORE = 1.8, 14
MATCH, OTHER, GAP = 2, -1, -1
#: Text of the items of a block, which is broadcast.
BLOCK_BYTES = 8 << 20
#: Places of seeds that are looked at at a time.
HITS = 1 << 21
#: Words that a worker remembers with their numbers.
MEMO = 400_000
#: Cells of an alignment table that are filled at a time.
CELLS = 1 << 21


def plain(word: bytes) -> str:
    """The word lower-cased, without what isn't a letter or digit at its ends (all of it, if there is none)."""
    text = word.decode("utf-8", "replace").lower()
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b]


class Numbers(dict):
    """Word as written -> number of its plain form in the vocabulary, 0 if it isn't there, -1 if nothing of it is plain.

    Remembers ``MEMO`` words.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        text = plain(word)
        n = self.vocabulary.get(text, 0) if text else -1
        if len(self) < MEMO:
            self[word] = n
        return n


def words_of(text: bytes) -> list[bytes]:
    """Words with something plain in them; marks between words don't count as words."""
    return [w for w in text.split() if plain(w)]


class Index:
    """A block of items: their words by number, and the places of their 3-grams."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        number = lambda w: self.vocabulary.setdefault(plain(w), len(self.vocabulary) + 1)
        self.words = [np.array([number(w) for w in words_of((t or "").encode())], np.int64) for _, t in items]
        self.base = len(self.vocabulary) + 1
        places = [(int(g), i, p) for i, w in enumerate(self.words) for p, g in enumerate(self.grams(w))]
        places.sort()
        self.place_gram, self.place_item, self.place_at = (np.array([x[k] for x in places], np.int64) for k in range(3))
        self.table, self.first = np.unique(self.place_gram, return_index=True)
        self.first = np.append(self.first, len(places))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        #: Score that a copy needs, and the gaps that an alignment of that score has at most.
        self.need = np.maximum(LEAST_SCORE * MATCH * self.sizes, np.minimum(SHORT_SCORE, SHORT * self.sizes))
        self.slack = np.floor(MATCH * self.sizes - self.need).astype(np.int64)
        self.word, self.times = np.unique(np.concatenate([np.full(n, i) * self.base + w for i, (n, w) in enumerate(zip(self.sizes, self.words, strict=True))] or [np.zeros(0, np.int64)]), return_counts=True)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Codes of the 3-grams that start at each word; 0 where one of the words isn't in the vocabulary.

        Above two million distinct words codes wrap: 3-grams of one code then share their seeds, and regions that hold no copy
        are aligned in vain.
        """
        if len(words) < GRAM:
            return np.zeros(0, np.int64)
        a, b, c = words[:-2], words[1:-1], words[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, 0)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and numbers of the table's 3-grams there."""
        grams = self.grams(words)
        at = np.flatnonzero(grams)
        if not len(at) or not len(self.table):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.table, grams[at]), len(self.table) - 1)
        own = self.table[k] == grams[at]
        return at[own], k[own]


def read(numbers: Numbers, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, with three zeros after each, and where each text begins."""
    get = numbers.__getitem__
    parts, starts, n = [], [], 0
    empty = np.zeros(GRAM, np.int64)
    for t in texts:
        words = t.split()
        starts.append(n)
        ids = np.fromiter(map(get, words), np.int64, len(words))
        parts += [ids[ids >= 0], empty]
        n += len(parts[-2]) + GRAM
    return np.concatenate(parts) if parts else empty[:0], np.array([*starts, n], np.int64)


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its region. Rows of all tables are filled together."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(regions[i]), len(items[i])))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (len(regions[order[end]]) + 1) <= CELLS:
            end += 1
        own = order[at:end]
        rows, cols = max(len(items[i]) for i in own), max(len(regions[i]) for i in own)
        item, region = np.full((len(own), rows), -1), np.full((len(own), cols), -2)
        for k, i in enumerate(own):
            item[k, : len(items[i])] = items[i]
            region[k, : len(regions[i])] = regions[i]
        far = np.arange(cols, dtype=np.int32)
        table = np.zeros((len(own), cols + 1), np.int32)
        best = np.zeros(len(own), np.int32)
        for r in range(rows):
            fits = (region == item[:, r : r + 1]) & (item[:, r : r + 1] > 0)
            step = np.maximum(np.maximum(table[:, :-1] + np.where(fits, MATCH, OTHER), table[:, 1:] + GAP), 0)
            table[:, 1:] = np.maximum.accumulate(step - GAP * far, axis=1) + GAP * far
            best = np.maximum(best, table.max(axis=1))
        out[own] = best
        at = end
    return out


def shared_words(index: Index, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words each region ``words[low:high]`` has in common with its item, in any order: no alignment matches more."""
    out = np.zeros(len(item), np.int64)
    ends = np.cumsum(high - low)
    at = 0
    while at < len(item):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        n = (high - low)[at:end]
        region = np.repeat(np.arange(at, end), n)
        own = words[np.arange(n.sum()) + np.repeat(low[at:end] - np.cumsum(n) + n, n)]
        key = item[region] * index.base + own
        k = np.minimum(np.searchsorted(index.word, key), len(index.word) - 1)
        fits = (own > 0) & (index.word[k] == key)
        pair, times = np.unique(region[fits] * len(index.word) + k[fits], return_counts=True)
        np.add.at(out, pair // len(index.word), np.minimum(times, index.times[pair % len(index.word)]))
        at = end
    return out


def seeds(index: Index, at: np.ndarray, gram: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, item, diagonal) of the 3-grams ``gram`` at places ``at``, sorted."""
    n = index.first[gram + 1] - index.first[gram]
    ends = np.cumsum(n)
    found = np.zeros((3, 0), np.int64)
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + HITS, "right")))
        own = n[low:high]
        rows = np.repeat(index.first[gram[low:high]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        here = np.stack([np.repeat(text[low:high], own), index.place_item[rows], np.repeat(at[low:high], own) - index.place_at[rows]])
        found = np.concatenate([found, here], axis=1)
        found = found[:, np.lexsort(found[::-1])]
        found = found[:, np.concatenate([[True], (np.diff(found) != 0).any(axis=0)])]
        low = high
    return tuple(found)


def copies(index: Index, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, score) of the texts that copy an item; the best score of each text and item."""
    at, gram = index.found(words)
    if not len(at):
        return []
    text, item, diagonal = seeds(index, at, gram, np.searchsorted(starts, at, "right") - 1)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > index.slack[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    t, i = text[first], item[first]
    low = np.maximum(starts[t], diagonal[first] - index.slack[i])
    high = np.minimum(starts[t + 1] - GRAM, diagonal[last] + index.sizes[i] + index.slack[i])
    able = np.flatnonzero(MATCH * shared_words(index, words, i, low, high) >= index.need[i])
    t, i, low, high = t[able], i[able], low[able], high[able]
    score = align([index.words[k] for k in i], [words[a:b] for a, b in zip(low, high, strict=True)])
    need = index.need[i]
    best: dict[tuple[int, int], int] = {}
    for a, b, s in zip(t[score >= need].tolist(), i[score >= need].tolist(), score[score >= need].tolist(), strict=True):
        best[a, b] = max(s, best.get((a, b), 0))
    return [(a, b, s) for (a, b), s in sorted(best.items())]


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items, about ``BLOCK_BYTES`` of text at a time."""
    items = benchmark.selectExpr("cast(item_id AS bigint) AS item_id", "text")
    n = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(map(tuple, part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and item_score (that of the item with itself) for each document that copies an item."""
    ship(docs.sparkSession)
    docs, out = spread(docs.select("doc_id", "text")), None
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            numbers = Numbers(index.vocabulary)
            for batch in sliced(batches):
                rows = copies(index, *read(numbers, text_bytes(batch.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([MATCH * len(index.words[r[1]]) for r in rows], pa.int64())],
                    ["doc_id", "item_id", "score", "item_score"],
                )

        found = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, score bigint, item_score bigint")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that copy no item of ``benchmark``, with all their columns. No shuffle; one scan for all blocks."""
    ship(docs.sparkSession)
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            numbers = Numbers(index.vocabulary)
            for batch in sliced(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in copies(index, *read(numbers, text_bytes(batch.column("text"))))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
