"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A text is normalised as the model says (a space in front, spaces as U+2581). The automaton reads it once; at each
position its output links give all pieces that end there, and each relaxes that position's best path.

For a model of the unigram type a path's score is the sum of its pieces' scores; of equal ones that with the longer
last piece holds. For a model of the BPE type summed scores would give other ids than the model's own merges, so that
there a piece relaxes a position only if merging the two strings, the last piece of the path to where it starts and
the piece itself, leaves just these two. Paths all of whose neighbours pass are the result of the merges, and each
position has one; whether two pieces pass is remembered. Characters that no piece covers become byte pieces.

Where no piece has U+2581 behind another character, as in usual models, the ids of a text are those of its words one
after another, so that each worker remembers the ids of up to ``MEMO`` words.

Decoding joins the pieces, bytes included, and takes the space in front away: it gives back every text that has no
U+2581, which decodes to a space.

Defined results: a null or empty text has no ids and decodes to an empty text; each row gets a row, repeated or null
ids too; an empty table gives no rows; ``encode`` keeps no other columns than it lists. No shuffle; whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm.common import ship, sliced, spread

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -10.0
MEMO = 300_000
#: Longer words aren't remembered.
MEMO_CHARS = 64
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each field of a protocol buffer's message."""
    while at < end:
        tag, at = varint(data, at)
        size, start = varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}.get(tag & 7) or varint(data, at)[1] - at, at)
        at = start + size
        yield tag >> 3, start, at


def is_unigram(data: bytes) -> bool:
    """Whether a model's type (field 3 of its trainer's message, which is field 2) is unigram: 1, or not given."""
    kinds = [varint(data, c)[0] for f, a, b in fields(data, 0, len(data)) if f == 2 for g, c, _ in fields(data, a, b) if g == 3]
    return not kinds or kinds[-1] == 1


class Codec:
    """Pieces, scores and the automaton of a model."""

    def __init__(self, data: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unknown = min(self.scores[i] for i in plain) + UNKNOWN
        self.unknown_id = None if all(sp.is_byte(i) for i in self.bytes_id) else sp.unk_id()
        self.best = self.by_score if is_unigram(data) else self.by_merges
        self.score_of = {self.pieces[i]: self.scores[i] for i in plain}
        self.pairs: dict[int, bool] = {}
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain)
        self.line_end = None if any("\n" in self.pieces[i] for i in plain) else packed(self.bytes_id[10:11]) if self.unknown_id is None else None
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        self.out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_control(i):
                self.out[i] = b""
        for b, i in enumerate(self.bytes_id):
            if self.unknown_id is None:
                self.out[i] = bytes([b])
        if self.unknown_id is not None:
            self.out[self.unknown_id] = " ⁇ ".encode()

    def by_score(self, text: str) -> list[int]:
        """Ids of the segmentation of highest score of a normalised text."""
        n = len(text)
        low = float("-inf")
        score, size, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        done = 0  # positions up to here have their last score

        def pass_to(end: int) -> None:
            nonlocal done
            while done < end:
                done += 1
                if score[done - 1] + self.unknown > score[done]:
                    score[done], size[done], piece[done] = score[done - 1] + self.unknown, 1, -1

        for last, (length, value, i) in self.automaton.iter(text):
            if done < last:
                pass_to(last)  # a piece that ends later can start at any earlier place
            end = last + 1
            s = score[end - length] + value
            if s > score[end] or s == score[end] and length > size[end]:
                score[end], size[end], piece[end] = s, length, i
        pass_to(n)
        return self.traced(text, size, piece)

    def traced(self, text: str, size: list[int], piece: list[int]) -> list[int]:
        """The ids of the path to the end: each position has the size and id (-1: none) of its last piece."""
        back, at = [], len(text)
        while at:
            if piece[at] >= 0:
                back.append(piece[at])
            elif self.unknown_id is None:
                back += [self.bytes_id[b] for b in reversed(text[at - 1].encode())]
            elif not back or back[-1] != self.unknown_id:
                back.append(self.unknown_id)
            at -= size[at]
        return back[::-1]

    def merged(self, text: str) -> list[str]:
        """The parts of a short text when the neighbours of highest score, the first of equals, are merged as long as any can be."""
        parts = list(text)
        while True:
            best, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                s = self.score_of.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def passes(self, left: str, right: str, key: int | None) -> bool:
        """Whether merging leaves ``left`` (which may be empty) and ``right`` as they are; remembered by ``key``, if any."""
        found = self.merged(left + right) == ([left, right] if left else [right])
        if key is not None and len(self.pairs) < MEMO:
            self.pairs[key] = found
        return found

    def by_merges(self, text: str) -> list[int]:
        """Ids of a normalised text as the merges of a BPE model give them."""
        n, pairs = len(text), self.pairs
        size, piece = [0] * (n + 1), [-1] * (n + 1)
        for last, (length, _, i) in self.automaton.iter(text):
            end = last + 1
            if size[end]:
                continue
            start = end - length
            while start and not size[start]:  # no piece ends there: a character by itself
                size[start] = 1
                start -= 1
            start = end - length
            key = piece[start] << 20 | i if piece[start] >= 0 else None if start else -1 - i
            passes = pairs.get(key)
            if passes is None:
                passes = self.passes(text[start - size[start] : start], text[start:end], key)
            if passes:
                size[end], piece[end] = length, i
        return self.traced(text, [k or 1 for k in size], piece)

    def encode(self, text: str, words: Words) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if not self.by_words:
            return packed(self.best(MARK + text.replace(" ", MARK)))
        parts = text.split(" ")
        try:
            return b"".join(map(words.__getitem__, parts))
        except Blank:
            return b"".join(packed(self.best(m[0])) if len(m[0]) > MEMO_CHARS or m[0][:2] in (MARK, MARK * 2) or m[0][0] != MARK else words[m[0][1:]] for m in SEGMENT.finditer(MARK + text.replace(" ", MARK)))

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids))
        return text[text[:1] == b" " :].decode("utf-8", "replace")


class Blank(Exception):
    """A word that can't be looked up by itself: empty, or with U+2581."""


class Words(dict):
    """Word, without the mark in front -> packed ids; remembers ``MEMO`` words."""

    def __init__(self, codec: Codec, mark: str = MARK):
        self.codec, self.mark = codec, mark
        self.bare = Words(codec, "") if mark else self

    def __missing__(self, word: str) -> bytes:
        if not word and self.mark or MARK in word:
            raise Blank
        if "\n" in word and self.codec.line_end:  # which no piece crosses
            first, *rest = word.split("\n")
            return (self[first] if first or not self.mark else packed(self.codec.best(self.mark))) + b"".join(self.codec.line_end + (self.bare[x] if x else b"") for x in rest)
        ids = packed(self.codec.best(self.mark + word)) if word else b""
        if len(self) < MEMO and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_OPEN: dict[str, tuple[Codec, Words]] = {}


def opened(name: str) -> tuple[Codec, Words]:
    """The worker's codec and words of a model; they outlive a task."""
    if name not in _OPEN:
        with open(model_path(name), "rb") as f:
            codec = Codec(f.read())
        _OPEN[name] = codec, Words(codec)
    return _OPEN[name]


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens, ids, and round_trip: whether decoding the ids gives the text back."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec, words = opened(model)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = [codec.encode(t, words) for t in texts]
            sizes = np.array([0, *(len(c) // 4 for c in coded)])
            ids = np.frombuffer(b"".join(coded), "<i4")
            ends = np.cumsum(sizes)
            same = [codec.decode(ids[a:b].tolist()) == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            kept = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes[1:], pa.int64()), lists, pa.array(same)], ["doc_id", *keep, "n_tokens", "ids", "round_trip"])

    columns = spread(docs.select("doc_id", *keep, "text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields if f.name != "text")
    return columns.mapInArrow(run, f"{types}, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``coded`` (doc_id, ids); null ids decode to an empty text."""
    ship(coded.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec, _ = opened(model)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
