"""Token ids as ORC files.

Texts are dealt by ranges of doc_id and sorted, encoded, and written as one ORC row a document: doc_id, part (the range),
before (ids of the documents before it in its part), n (its own) and the ids, each text's end id included. ORC keeps integers
run-length encoded in stripes, with row indexes, and here a Bloom filter on doc_id: readers take stripes in parallel
and skip those, and row groups, whose statistics or filter exclude the ids asked for (``find``).

Encoding is that of the tokenizers library. A text is cut where a single space stands between two other characters
than white space, and at single line ends between such: no token of a byte-level BPE with the usual pattern crosses
these places. Each worker remembers the ids of up to ``MEMO`` words. Tokenizers of any other kind encode whole texts.

Defined results: a null or empty text has the end id only; rows with equal doc_ids each get a row, ordered by text;
null doc_ids come first; an empty table gives no rows; other columns of the input aren't written. Parts have about 8 MB of
input, and there are 200,000 at most: above 1.6 TB they grow.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm.common import new_path, parts_for, ship, sliced

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MEMO = 400_000
#: Longer words aren't remembered.
MEMO_CHARS = 64
#: ORC's options: stripes of 16 MB, an index entry each 1,000 rows, a Bloom filter on the document's id.
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
FILE_SCHEMA = "doc_id bigint, part int, before bigint, n int, ids array<int>"


class Crossing(Exception):
    """A word that can't be encoded by itself: empty, or with white space at an end."""


def byte_letters() -> dict[int, str]:
    """The character by which a byte-level model writes each byte: printable Latin-1 itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()
#: Marks that the usual pattern parts from letters before them.
MARKS = ".,;:!?"


class Words(dict):
    """Word, without the space in front -> packed ids; remembers ``MEMO`` words.

    A word of letters alone is one piece of the pattern, and goes to the library's model at once; marks behind it are
    the next piece. All else is encoded as a text.
    """

    def __init__(self, tokenizer, space: str = " "):
        self.tokenizer, self.model, self.space = tokenizer, tokenizer.model, space
        self.letters = space.translate(LETTERS)
        self.bare = Words(tokenizer, "") if space else self
        self.line_end = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            letters = self.letters + word if word.isascii() else (self.space + word).encode().decode("latin-1").translate(LETTERS)
            ids = array("i", [k.id for k in self.model.tokenize(letters)]).tobytes()
        else:
            if not word or word[0].isspace() or word[-1].isspace():
                raise Crossing
            if "\n" in word:
                first, *rest = word.split("\n")
                if not first[-1].isspace() and all(x and not x[0].isspace() and not x[-1].isspace() for x in rest):
                    return self[first] + b"".join([self.line_end + self.bare[x] for x in rest])
            letters = word.rstrip(MARKS)
            if letters.isalpha():
                again = letters in self
                ids = self[letters] + self.bare[word[len(letters) :]]
                if not again:  # a rare word: its letters are remembered, not each of its marks
                    return ids
            else:
                ids = self.encode(self.space + word)
        if len(self) < MEMO and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text: line by line, if no line has white space at an end."""
        if not text:
            return b""
        word, bare = self.__getitem__, self.bare.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(bare(first) + b"".join(map(word, rest)))
            return self.line_end.join(lines)
        except Crossing:
            return self.pieces(text)

    def pieces(self, text: str) -> bytes:
        """As ``text``: words that can't stand alone stay joined with what is before them."""
        parts, out = text.split(" "), []
        held = parts[0]
        space = ""
        for part in parts[1:]:
            if held and not held[-1].isspace() and part and not part[0].isspace():
                out.append((space, held))
                held, space = part, " "
            else:
                held += " " + part
        out.append((space, held))
        return b"".join((self if s else self.bare)[w] if w and not w[0].isspace() and not w[-1].isspace() else self.encode(s + w) for s, w in out)


class Whole:
    """Encodes whole texts: for tokenizers of another pattern, where words can't be cut out of a text."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def text(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def cuts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer is byte-level BPE with the usual pattern and nothing else, as ``Words`` takes for granted."""
    told = json.loads(tokenizer.to_str())
    pattern, model = told["pre_tokenizer"] or {}, told["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and told["normalizer"] is None and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space", False)


_OPEN: dict[str, Words | Whole] = {}


def opened(name: str) -> Words | Whole:
    """The worker's tokenizer; it outlives a task. Texts never name special tokens: their strings are ordinary text."""
    if name not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = True
        _OPEN[name] = Words(tokenizer) if cuts_at_spaces(tokenizer) else Whole(tokenizer)
    return _OPEN[name]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the ids of every row of ``docs`` (doc_id, text) as ORC files, in ascending doc_id order over the files."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, end, before = opened(tokenizer), end_id.to_bytes(4, "little"), 0
        part = TaskContext.get().partitionId()
        for batch in sliced(batches):
            coded = [words.text(t or "") + end for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            n = len(coded)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + ends[:-1], pa.int64()), pa.array(np.diff(ends), pa.int32()), ids], ["doc_id", "part", "before", "n", "ids"])
            before += int(ends[-1])

    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    # equal and null ids are parted by their texts; the beginnings of these are in their order, and few bytes to sample
    dealt = rows.repartitionByRange(parts_for(docs), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    dealt.mapInArrow(run, FILE_SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files.

    A part's ids are summed, and the sums of the parts before it (one row each) added to each document's own.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("before"), pa.array((ends[1:] - ends[:-1]).astype("int64")), pa.array(crc, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).drop("n").mapInArrow(run, "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    starts = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row for each file's part, never more than ``parts_for`` allows
    return rows.join(F.broadcast(starts), F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(spark, path)
