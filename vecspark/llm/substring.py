"""Substring dedup: removal of passages that an earlier document has.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose words also start in
a document of smaller doc_id; windows are judged on the input.

Documents are dealt by hash to batches of about ``BATCH_BYTES`` of input, which is the one time that texts move; all
else that moves is summed up by batch before.

1. Each window is known by its anchor, the least hash of the word 3-grams in it: equal windows have equal anchors.
   Batches send the distinct anchors of their documents to buckets by hash; buckets send back those that two
   documents share.
2. Runs of windows with one shared anchor are segments. A batch sends its distinct segments, with the least and
   greatest doc_id that have them, to the shard of their anchor.
3. Each shard builds a compressed FM-index (``fm_index``) over its distinct segments, ``SHARD`` words at a time, and streams
   the documents' segments through it: matching statistics by backward search give, for each window, all places of its words, and
   the index the least doc_id of these.
4. The least ids return to the batches; windows with a smaller one than their document's are reported, and their
   words go.

An anchor in over ``HOT`` documents may have as many different segments, by the words around a copied passage. Its
windows go to shards one by one, by the hash of all their words. So an anchor, a passage or a line, however many
documents have it, adds one entry a batch to any bucket and shard.

Defined results: a null or empty text has no words; rows of one doc_id don't count as earlier for each other, each
row gets a row; rows with null ids keep all words and remove none elsewhere; rows of one doc_id and one text meet in one
batch, however many; an empty table gives no rows; other columns of the input are kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import free, input_bytes, ship, text_bytes
from vecspark.llm.fm_index import FMIndex

WINDOW, GRAM = 13, 3
#: Documents of an anchor from which its windows are dealt one by one.
HOT = 2_000
#: Windows of a segment at most, and words of an index about.
SEGMENT, SHARD = 32, 400_000
#: Bytes of input of a batch; bits of an anchor, and bytes.
BATCH_BYTES, BITS, WIDTH = 1 << 20, 48, 6
#: Buckets, and shards: one for so many bytes of input, whatever the session's settings, but ``PLACES`` on smaller ones, as
#: each batch sends each of them a message. Bytes of input of a shuffle's partition, where that takes more partitions than are set.
PLACE_BYTES, PLACES, PART_BYTES = 16 << 20, 256, 256 << 20
#: What moves between batches, buckets and shards: where to, from or for which batch, what it is, and up to five arrays.
MESSAGE = "dest int, batch int, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = tuple("abcde")


def anchors(words: list[bytes]) -> np.ndarray:
    """The anchor of each window."""
    import xxhash

    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g >>= np.uint64(64 - BITS)
    span = WINDOW - GRAM + 1
    least, width = g, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    n -= WINDOW - 1
    return np.minimum(least[:n], least[span - width : span - width + n])


def short(numbers: np.ndarray) -> bytes:
    """Numbers below 2^48 in six bytes each."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


def place(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket or shard, of n, of each anchor. Anchors are least hashes, so that low ones are many: they are mixed again."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (mixed * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def messages(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * 8
    types = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dest", "batch", "kind", *NAMES])


def by_place(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, rows) of ascending rows."""
    at = place(keys, n)
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.diff(at[order], prepend=-1))
    for rows in np.split(order, cut[1:]) if len(order) else []:
        yield int(at[rows[0]]), rows


class Batch:
    """The documents of a batch that have an id, in an order that only their contents make."""

    def __init__(self, table):
        ids, texts = table.column("doc_id").to_pylist(), text_bytes(table.column("text"))
        self.rows = sorted((i for i, x in enumerate(ids) if x is not None), key=lambda i: (ids[i], texts[i]))
        self.ids, self.words = [ids[i] for i in self.rows], [texts[i].split() for i in self.rows]
        self.texts = [texts[i] for i in self.rows]


def _anchors_of(buckets: int) -> Callable:
    """Batch -> buckets: a: anchors of one document; b: anchors of more, c: of how many."""

    def run(key, table):
        batch = Batch(table)
        found = [np.unique(anchors(w)) for w in batch.words]
        every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        own = key[0].as_py()
        return messages([(dest, own, 0, short(every[lone]), short(every[more]), count[more].astype("<u4").tobytes(), None, None) for dest, rows in by_place(every, buckets) for lone, more in [(rows[count[rows] == 1], rows[count[rows] > 1])]])

    return run


def _shared(table):
    """Bucket -> batches: a: the batch's anchors that two documents share, b: whether each is in over ``HOT``."""
    lone, more = [wide(x) for x in table.column("a").to_pylist()], [wide(x) for x in table.column("b").to_pylist()]
    counts = [np.frombuffer(x, "<u4") for x in table.column("c").to_pylist()]
    keys = np.concatenate([x for pair in zip(lone, more, strict=True) for x in pair])
    count = np.concatenate([x for a, c in zip(lone, counts, strict=True) for x in (np.ones(len(a), np.int64), c.astype(np.int64))])
    row = np.repeat(np.arange(len(lone)), [len(a) + len(b) for a, b in zip(lone, more, strict=True)])
    _, group = np.unique(keys, return_inverse=True)
    docs = np.bincount(group, count).astype(np.int64)[group] if len(keys) else count
    use = docs > 1
    keys, hot, row = keys[use], docs[use] > HOT, row[use]
    ends = np.searchsorted(row, np.arange(len(lone) + 1))
    batches = table.column("batch").to_pylist()
    return messages([(0, batches[i], 0, short(keys[a:b]), hot[a:b].tobytes(), None, None, None) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a])


def segments(words: list[bytes], shared: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(anchor, or -1 for a window of a hot one; first and last window) of each segment. ``shared`` is sorted."""
    own = anchors(words)
    if not len(own) or not len(shared):
        return
    at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
    use = shared[at] == own
    lone = use & hot[at]
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    ends = np.append(cut[1:], len(own))
    good = use[cut]
    for a, b, key, single in zip(cut[good].tolist(), ends[good].tolist(), own[cut[good]].tolist(), lone[cut[good]].tolist(), strict=True):
        if single:
            yield from ((-1, i, i) for i in range(a, b))
        else:
            yield from ((key, i, min(b, i + SEGMENT) - 1) for i in range(a, b, SEGMENT))


def _segments_of(shards: int) -> Callable:
    """Batch and its shared anchors -> shards: a: anchors, b, c: least and greatest ids, d: numbers in the batch, e: words.

    And to the batch itself, over one more place, where its segments are: a: numbers, b: documents, c: first words.
    """

    def run(key, table, replies):
        import xxhash
        import zstandard

        own = key[0].as_py()
        batch = Batch(table)
        shared = np.concatenate([np.zeros(0, np.uint64), *[wide(x) for x in replies.column("a").to_pylist()]])
        hot = np.concatenate([np.zeros(0, bool), *[np.frombuffer(x, bool) for x in replies.column("b").to_pylist()]])
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        number: dict[bytes, int] = {}
        keys: list[int] = []
        low: list[int] = []
        high: list[int] = []
        seen: list[tuple[int, int, int]] = []
        for i, (doc, words) in enumerate(zip(batch.ids, batch.words, strict=True)):
            for anchor, a, b in segments(words, shared, hot):
                content = b" ".join(words[a : b + WINDOW])
                n = number.get(content)
                if n is None:
                    n = number[content] = len(keys)
                    keys.append(anchor if anchor >= 0 else xxhash.xxh64_intdigest(content) >> 64 - BITS)
                    low.append(doc)
                    high.append(doc)
                else:
                    high[n] = doc  # documents come in ascending order
                seen.append((n, i, a))
        if not keys:
            return messages([])
        key_array, low_array, high_array = np.array(keys, np.uint64), np.array(low, "<i8"), np.array(high, "<i8")
        contents, press = list(number), zstandard.ZstdCompressor(level=3).compress
        out = [(dest, own, 0, short(key_array[rows]), low_array[rows].tobytes(), high_array[rows].tobytes(), rows.astype("<i4").tobytes(), press(b"\n".join([contents[r] for r in rows.tolist()]))) for dest, rows in by_place(key_array, shards)]
        n, doc, first = (np.array(x, "<i4").tobytes() for x in zip(*seen, strict=True))
        return messages([*out, (shards + own, own, 1, n, doc, first, None, None)])

    return run


def least_ids(contents: list[bytes], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each window of each segment, the least id of the segments that have its words anywhere, by an FM-index; and the least of these."""
    words = b" ".join(contents).split(b" ")
    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    flat = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    ends = np.cumsum([c.count(b" ") + 1 for c in contents])
    sequences = np.split(flat, ends[:-1])
    index = FMIndex(sequences, len(number), WINDOW, docs)
    length, low, high, sizes = index.statistics_table(sequences, WINDOW)
    places = np.arange(length.shape[1])[None, :]
    windows = (places >= length.shape[1] - sizes[:, None]) & (places <= length.shape[1] - WINDOW)
    if not ((length[windows] == WINDOW) & (low[windows] < high[windows])).all():
        raise AssertionError("a segment isn't found in its own index")
    least = index.least_value(low[windows])
    firsts = np.concatenate([[0], np.cumsum(sizes - WINDOW + 1)])
    return np.split(least, firsts[1:-1]), np.minimum.reduceat(least, firsts[:-1])


def _search(table):
    """Shard -> batches: a: numbers of segments, b: their windows, c: the least id of each window. Others pass."""
    import zstandard

    kinds = table.column("kind").to_pylist()
    if kinds[0] == 1:
        return table.select(["dest", "batch", "kind", *NAMES])
    press = zstandard.ZstdDecompressor().decompress
    rows = [(press(e).split(b"\n"), wide(a).tolist(), np.frombuffer(b, "<i8").tolist()) for a, b, e in zip(*(table.column(c).to_pylist() for c in "abe"), strict=True)]
    first: dict[bytes, list[int]] = {}  # segment -> anchor and least id
    for contents, keys, low in rows:
        for content, key, doc in zip(contents, keys, low, strict=True):
            known = first.get(content)
            if known is None:
                first[content] = [key, doc]
            elif doc < known[1]:
                known[1] = doc
    order = sorted(first, key=lambda c: first[c][0])
    found: dict[bytes, tuple[np.ndarray, int]] = {}
    at = 0
    while at < len(order):  # indexes of whole anchors
        end, size = at, 0
        while end < len(order) and (size < SHARD or first[order[end]][0] == first[order[end - 1]][0]):
            size += order[end].count(b" ") + 2
            end += 1
        own = order[at:end]
        least, best = least_ids(own, np.array([first[c][1] for c in own], np.int64))
        found.update(zip(own, zip(least, best.tolist(), strict=True), strict=True))
        at = end
    out = []
    for (contents, _, _), batch, high, numbers in zip(rows, *(table.column(c).to_pylist() for c in ("batch", "c", "d")), strict=True):
        least = [found[c] for c in contents]
        use = [i for i, (x, doc) in enumerate(zip(least, np.frombuffer(high, "<i8").tolist(), strict=True)) if x[1] < doc]
        if use:
            least = {i: least[i][0] for i in use}
            out.append((0, batch, 0, np.frombuffer(numbers, "<i4")[use].tobytes(), np.array([len(least[i]) for i in use], "<i4").tobytes(), np.concatenate([least[i] for i in use]).astype("<i8").tobytes(), None, None))
    return messages(out)


def repeated_windows(batch: Batch, replies) -> list[list[int]]:
    """For each document of a batch, the first words of its windows that an earlier document has."""
    out: list[list[int]] = [[] for _ in batch.ids]
    least: dict[int, np.ndarray] = {}
    seen = []
    for kind, a, b, c in zip(*(replies.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
        if kind == 1:
            seen.append(tuple(np.frombuffer(x, "<i4").tolist() for x in (a, b, c)))
        else:
            sizes = np.frombuffer(b, "<i4")
            least.update(zip(np.frombuffer(a, "<i4").tolist(), np.split(np.frombuffer(c, "<i8"), np.cumsum(sizes)[:-1]), strict=True))
    for numbers, docs, firsts in seen:
        for n, i, first in zip(numbers, docs, firsts, strict=True):
            x = least.get(n)
            if x is not None:
                out[i] += (np.flatnonzero(x < batch.ids[i]) + first).tolist()
    return out


def kept_words(n: int, windows: list[int]) -> np.ndarray:
    """Which of n words no window covers."""
    step = np.zeros(n + 1, np.int64)
    at = np.array(windows, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return np.cumsum(step[:n]) == 0


def _with_windows(docs: DataFrame, run: Callable, schema) -> DataFrame:
    """``run(table, windows)`` over batches of ``docs``; windows has, by row, the windows that an earlier document has."""
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(docs)
    n, places = max(2 * parts, size // BATCH_BYTES + 1), max(PLACES, size // PLACE_BYTES)
    own = free("_batch", docs)
    more = min(200_000, size // PART_BYTES)

    def by(rows: DataFrame, key: str):
        """Rows by key; a partition has many keys, one of which is held at a time."""
        return (rows.repartition(more, key) if more > parts else rows).groupBy(key)

    batches = by(docs.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), own)
    shared = by(batches.applyInArrow(_anchors_of(places), MESSAGE), "dest").applyInArrow(_shared, MESSAGE)
    sent = batches.cogroup(by(shared, "batch")).applyInArrow(_segments_of(places), MESSAGE)
    found = by(sent, "dest").applyInArrow(_search, MESSAGE)

    def last(key, table, replies):
        windows: list[list[int]] = [[] for _ in range(table.num_rows)]
        if replies.num_rows:
            batch = Batch(table)
            for row, own in zip(batch.rows, repeated_windows(batch, replies), strict=True):
                windows[row] = own
        return run(table, windows)

    return batches.cogroup(by(found, "batch")).applyInArrow(last, schema)


def substring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by spaces) of every row of ``docs``."""

    def run(table, windows):
        import pyarrow as pa

        out = []
        for text, own in zip(text_bytes(table.column("text")), windows, strict=True):
            words = text.split()
            kept = [w for w, k in zip(words, kept_words(len(words), own).tolist(), strict=True) if k] if own else words
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_windows(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(text: bytes, windows: list[int]) -> bytes:
    """The text without the words of the windows; what goes leaves a line end if it had one, else a space."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    keep = kept_words(len(spans), windows)
    out, last = [], 0
    for i in np.flatnonzero(keep).tolist():
        a, b = spans[i]
        if out:
            out.append(text[last:a] if keep[i - 1] else b"\n" if b"\n" in text[last:a] else b" ")
        out.append(text[a:b])
        last = b
    return b"".join(out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, repeated passages taken out of their texts; n_chars follows, and texts of which nothing is left go."""
    names = docs.columns

    def run(table, windows):
        import pyarrow as pa

        texts = [remove(t, own) if own else t for t, own in zip(text_bytes(table.column("text")), windows, strict=True)]
        null = table.column("text").is_null().to_pylist()
        new = [None if x else t.decode() for t, x in zip(texts, null, strict=True)]
        columns = {c: table.column(c) for c in names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in columns:
            old = table.column("n_chars").to_pylist()
            columns["n_chars"] = pa.array([len(t) if own else x for t, own, x in zip(new, windows, old, strict=True)], table.column("n_chars").type)
        return pa.table([columns[c] for c in names], names=names).filter(pa.array([bool(t) or not own for t, own in zip(texts, windows, strict=True)]))

    return _with_windows(docs, run, docs.schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op5_substring": rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words FROM documents),
    w AS (SELECT rid, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(words) - {WINDOW - 2})) AS i) r),
    f AS (SELECT gram, min(doc_id) AS first FROM w GROUP BY gram),
    c AS (SELECT DISTINCT rid, i + k AS pos FROM w JOIN f USING (gram), range(0, {WINDOW}) r(k) WHERE first < doc_id),
    g AS (SELECT rid, list(pos) AS gone FROM c GROUP BY rid),
    k AS (SELECT doc_id, words, coalesce(gone, []) AS gone, list_filter(range(1, len(words) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)) AS keep FROM d LEFT JOIN g USING (rid))
    SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_transform(keep, lambda i: words[i]), ' '), '')) AS kept_sha256 FROM k
    """
}
