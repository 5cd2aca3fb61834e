"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document becomes token ids (an end id follows), is cut at multiples of the sequence
length, and the pieces are placed by first-fit decreasing. The tree holds the free room of
the bins; its root tells at once whether any bin fits, a walk down finds the leftmost. The
groups are dealt by a hash, hold a bounded number of pieces and are packed apart, so the
work is spread and nothing gathers in one task.

Defined results: a null or empty text is the end id alone; a very long text is tokenized whole, some 20 bytes of
memory a byte of text, and makes many pieces, dealt to the groups one by one; a null doc_id, or one that is no number, is null;
pieces of equal length are placed by doc_id (null last), then start; repeated rows are packed as often as they come; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"

#: Pieces that a group holds on average; repeated rows are dealt out by so many, too.
GROUP_PIECES = 2048

#: Distinct words without the signs that follow them, and signs, that a worker keeps with their ids.
CACHE_PARTS = 350_000

#: Signs that a tokenizer cuts from the letters before them.
SIGNS = ".,;:!?%#$&*()[]|\""

#: Conjoining Hangul letters: the only letters that composition joins with a neighbour.
JAMO = (range(0x1100, 0x1200), range(0xA960, 0xA980), range(0xD7B0, 0xD800))


def letters() -> str:
    """Letters that a tokenizer keeps together, and that normalization treats alone as in a word.

    Only those of long standing: the tokenizer's tables may be of another Unicode version.
    """
    old = unicodedata.ucd_3_2_0.category
    found = (c for n, c in enumerate(map(chr, range(0x10000))) if c.isalpha() and old(c)[0] == "L" and not any(n in r for r in JAMO))
    return "".join(c for c in found if c.lower().isalpha() and unicodedata.normalize("NFC", c) == c)


class _Table:
    """Rows of ids of any length, in flat arrays; row 0 is empty."""

    def __init__(self):
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def extend(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[rows] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class WordIds:
    """Token ids of whole texts, from a cache of the ids of each distinct part of a word.

    Texts are cut and their distinct words counted out by Arrow; only the distinct parts of a
    chunk become Python strings. Right for tokenizers that drop white space, never join what it separates, and cut
    between letters and the signs that follow them.
    """

    def __init__(self, path: str):
        # One thread a worker: the library's own pool would add threads, each with memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix, name = self.tokenizer.model.end_of_word_suffix, self.tokenizer.id_to_token
        #: Ids that end a word.
        self.last = np.array([bool(suffix) and (name(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())], bool)
        self.letters, self.signs = pc.TrimOptions(letters()), pc.TrimOptions(SIGNS)
        self.clear()

    def clear(self) -> None:
        self.part: dict[str, int] = {"": 0}
        self.parts = _Table()

    def _learn_letters(self, letters: list[str]) -> None:
        """Parts that are all letters are encoded many to a text: their last ids tell where each ends."""
        for k in range(0, len(letters), 4096):
            some = letters[k : k + 4096]
            joined = [" ".join(some[i : i + 64]) for i in range(0, len(some), 64)]
            ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self.part.update(zip(some, range(len(self.part), len(self.part) + len(some))))
                self.parts.extend(ids, np.diff(np.concatenate([[0], ends])))
            else:  # a part of several pieces: one by one
                self._learn(some)

    def _learn(self, parts: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        self.part.update(zip(parts, range(len(self.part), len(self.part) + len(parts))))
        self.parts.extend(np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _rows(self, parts: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The row of each part; new ones are learnt first."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [p for p in names if p not in self.part]:
            learn(new)
        rows = np.fromiter(map(self.part.__getitem__, names), np.int64, len(names))
        return rows[coded.indices.to_numpy()]

    def _words(self, words: pa.Array) -> _Table:
        """The ids of each word; letters and the signs behind them are looked up apart, any other word as it stands."""
        stems, signs = pc.ascii_rtrim(words, options=self.signs), pc.utf8_ltrim(words, options=self.letters)
        plain = pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(signs)), pc.binary_length(words))
        at = plain.to_numpy(zero_copy_only=False)
        rows = np.zeros((len(words), 2), np.int64)
        rows[at, 0] = self._rows(stems.filter(plain), self._learn_letters)
        rows[at, 1] = self._rows(signs.filter(plain), self._learn)
        rows[~at, 0] = self._rows(words.filter(pc.invert(plain)), self._learn)
        ids, size = self.parts.gather(rows.ravel())
        out = _Table()
        out.extend(ids, size.reshape(-1, 2).sum(1))
        return out

    def encode(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.part) > CACHE_PARTS:
            self.clear()
        # The tokenizer lowers letters itself, but not within its special strings.
        split = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else t.lower() for t in texts], pa.string()))
        words = split.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary).gather(words.indices.to_numpy() + 1)
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[split.offsets.to_numpy()])


def word_ids(path: str) -> WordIds:
    return common.only_cache(f"word ids {path}", lambda: WordIds(path))


def pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2) -> DataFrame:
    """Cuts every document into pieces of at most `length` ids: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batch: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        ids, sizes = word_ids(tokenizer).encode(t or b"" for t in texts)
        rows: list[tuple] = []
        at = 0
        for doc_id, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
            own = np.append(ids[at : at + n], np.uint32(end)).astype("<u4").tobytes()
            at += n
            for s in range(0, n + 1, length):
                part = own[4 * s : 4 * (s + length)]
                rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n + 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    common.prepare(docs.sparkSession)
    return common.with_text(docs, common.doc_id()).mapInArrow(common.per_chunk(cut), PIECE)


class Tournament:
    """Bins of equal room; find(n) gives the leftmost bin with room for n and takes it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.leaves)

    def place(self, n: int) -> tuple[int, int]:
        """The bin, and the room that was left in it."""
        best, k = self.best, 1
        if best[1] < n:
            raise ValueError("no bin has room")
        while k < self.leaves:
            k *= 2
            if best[k] < n:
                k += 1
        left = best[k]
        best[k] = left - n
        slot = k - self.leaves
        while k > 1:
            k //= 2
            best[k] = max(best[2 * k], best[2 * k + 1])
        return slot, left


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; lengths are in falling order."""
    # Two neighbouring bins of first fit are over half full together, so that many bins suffice.
    tree = Tournament(min(len(lengths), 2 * sum(lengths) // room + 2), room)
    return [(slot, room - left) for slot, left in map(tree.place, lengths)]


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs all documents; one row for each piece, with its sequence and the offset there."""
    spark = docs.sparkSession
    cut = common.table(pieces(docs, tokenizer, length, end))
    groups = max(1, -(-cut.count() // group_pieces))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # Equal rows travel as one with a count, and a large count is dealt over several groups.
    counted = cut.groupBy(*key).agg(F.count("*").alias("copies"))
    dealt = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {group_pieces}"))))
    dealt = dealt.withColumn("copies", F.least(F.lit(group_pieces), F.col("copies") - F.col("part") * group_pieces))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part"), F.lit(groups)))

    def place(group: pa.Table) -> pa.Table:
        rows = sorted(group.drop_columns(["part"]).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
        rows = [r for r in rows for _ in range(r["copies"])]
        slots = first_fit_decreasing([r["length"] for r in rows], length)
        out = {k: pa.array([r[k] for r in rows], pa.int64()) for k in key}
        out["sequence_id"] = pa.array([(r["grp"] << 32) + slot for r, (slot, _) in zip(rows, slots)], pa.int64())
        out["offset"] = pa.array([offset for _, offset in slots], pa.int64())
        return pa.table(out)

    return dealt.groupBy("grp").applyInArrow(place, PACKED)
