"""Harmonic packing of tokenised documents into sequences of fixed length.

A sequence of `capacity` tokens has reciprocal classes: class k holds k pieces of at most capacity // k tokens each. Documents
may be cut freely, so whole sequences come off first (class 1) and the rest of r tokens is class k = capacity // r when it
fills that class's slot to within 1/64; else a piece of exactly capacity // (k + 1) is cut off and the remainder is treated
alike. The longest piece of class k is shorter than the shortest of class k - 1, so the class follows from the length.

Every worker fills bins of each class with exactly k pieces, with no word from the others; what it has left open at its end
(at most k - 1 pieces a class) goes to further rounds, dealt by class, which again close full bins as they fill. A class with more than
DEALT pieces (or 16 k of them) is dealt in parts, each of which leaves at most k - 1, until its rest is small enough for one task. The
last round leaves at most sum(k - 1) over the classes, a number fixed by the capacity, and one task packs these first-fit
decreasing. No round holds more than the open bins in memory. A sequence is padded to the capacity, except when its tokens
are a power of two.

Edge cases: a null or empty text has only its end id; a text longer than a sequence is cut across sequences; repeated
rows with one doc_id are packed each on their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, read

CAPACITY = 2048
END_ID = 1
SLACK = 64
#: Encoded words kept in each of two generations, of what stands between white space and of words and signs: memory against time.
KEEP_WORDS = 600_000
#: Pieces of one class that a task of a later round gets.
DEALT = 1024
#: White space to str.split, but not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters for which the word pattern and lower-casing are the same in Python and in the tokenizer.
_plain = re.compile("[\x20-;=-\x7e¡-įı-ſ]*")  # no "<", with which special tokens start
_word = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\\w\\s]|_)+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts as little-endian 32-bit words.

    No token and no step of the tokenizer reaches across white space, so what stands between is encoded once and kept. What is new
    there is taken apart into words and signs, which are kept as well.
    """

    def __init__(self, path: str, keep: int = KEEP_WORDS):
        self.keep = keep
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # batches are small, and tasks use the cores
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        self.ends[[i for token, i in self.lib.get_vocab().items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _fill(self, missing: set[str]) -> None:
        new: dict[str, list[str]] = {}
        for w in missing:
            if (kept := self.older.get(w)) is not None:
                self.words[w] = kept
            elif _plain.fullmatch(w):
                new[w] = _word.findall(w.lower())
            else:  # special tokens' strings and other scripts as the library itself takes them
                self.words[w] = self._whole(w)
        if len(self.parts) >= self.keep:
            self.parts, self.older_parts = {}, self.parts
        fresh = []
        for part in set().union(*new.values()).difference(self.parts):
            if (kept := self.older_parts.get(part)) is not None:
                self.parts[part] = kept
            else:
                fresh.append(part)
        for i in range(0, len(fresh), 512):
            self._encode_parts(fresh[i : i + 512])
        for w, made in new.items():
            self.words[w] = self.parts[made[0]] if len(made) == 1 else b"".join([self.parts[x] for x in made])

    def _encode_parts(self, parts: list[str]) -> None:
        """Encode words and signs in one text; a token that ends a word says so."""
        ids = np.array(self.lib.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(parts) and ends[-1] == len(ids):
            data, start = ids.tobytes(), 0
            for part, end in zip(parts, (4 * ends).tolist(), strict=True):
                self.parts[part] = data[start:end]
                start = end
        else:  # another kind of vocabulary
            for part in parts:
                self.parts[part] = self._whole(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) >= self.keep:
            self.words, self.older = {}, self.words
        split = [None if any(c in t for c in SEPARATORS) else t.split() for t in texts]
        self._fill(set().union(*filter(None, split)).difference(self.words))
        known = self.words.__getitem__
        return [self._whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, split, strict=True)]


def tokenizer(path: str, keep: int = KEEP_WORDS) -> WordTokenizer:
    return held((WordTokenizer, path, keep), lambda: WordTokenizer(path, keep))


@lru_cache(4096)
def cuts(rest: int, capacity: int) -> tuple[int, ...]:
    """Lengths that a remainder shorter than a sequence is cut into."""
    out = []
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slot // SLACK or capacity // (k + 1) == 0:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return tuple(out)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class Bins:
    """Open bins of one worker; a bin of class k closes with its k-th piece."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open, self.out = capacity, first, {}, []

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(self.open.pop(k))

    def close(self, held: list[tuple]) -> None:
        at = 0
        for p in held:
            self.out.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return _batch(rows)

    def rest(self) -> pa.RecordBatch:
        return _batch([(*p, None, None) for held in self.open.values() for p in held])


_NAMES = [*COLUMNS, "sequence_id", "offset"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


LAST_ROUND = 31


def _first_id(round_no: int) -> int:
    """Sequence ids of a worker: apart from those of all other workers and rounds, and the same when a task is run again."""
    return round_no << 58 | TaskContext.get().partitionId() << 34


def _tokenise_and_fill(path: str, capacity: int, keep: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and walking the words kept costs much
        try:
            yield from filled(batches)
        finally:
            gc.enable()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bins = tokenizer(path, keep), Bins(capacity, _first_id(0))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids_of = t.encode([x or "" for x in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                    ids = memoryview(ids + end)
                    n, start = len(ids) // 4, 0
                    whole, rest = divmod(n, capacity)
                    for size in (*(capacity,) * whole, *cuts(rest, capacity)):
                        bins.add((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n))
                        start += size
                if len(bins.out) > 4096:
                    yield bins.take()
        yield bins.take()
        yield bins.rest()

    return run


def _fill_again(capacity: int, round_no: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, _first_id(round_no))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                bins.add(row)
            yield bins.take()
        yield bins.rest()

    return run


def _first_fit(capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True)), key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
        bins, room = Bins(capacity, _first_id(LAST_ROUND)), np.zeros(0, np.int64)
        held: list[list[tuple]] = []
        for row in rows:
            fit = np.flatnonzero(room >= row[2])
            if len(fit):
                k = int(fit[0])
            else:
                k, room = len(held), np.append(room, capacity)
                held.append([])
            held[k].append(row)
            room[k] -= row[2]
        for h in held:
            bins.close(h)
        yield bins.take()

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str, capacity: int = CAPACITY, keep: int = KEEP_WORDS) -> DataFrame:
    """The pieces of docs (doc_id, text): PIECE columns."""
    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")
    one = scratch.save(rows.mapInArrow(_tokenise_and_fill(path, capacity, keep), PIECE), "pieces")
    done = F.col("sequence_id").isNotNull()
    k = F.floor(F.lit(capacity) / F.col("length"))
    made, rounds, several = one, [], True
    while several:
        rounds.append(made.where(done))
        open_ = made.where(~done).withColumn("class", k)
        parts = open_.groupBy("class").agg(F.ceil(F.count("*") / F.greatest(F.lit(DEALT), 16 * F.col("class"))).alias("parts"))  # a row for each class
        several = not parts.where("parts > 1").isEmpty()
        part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts"))
        dealt = open_.join(F.broadcast(parts), "class").withColumn("part", part).repartition("class", "part").select(*made.columns)
        made = scratch.save(dealt.mapInArrow(_fill_again(capacity, len(rounds)), PIECE), f"again-{len(rounds)}")
    last = made.where(~done).coalesce(1).mapInArrow(_first_fit(capacity), PIECE)
    return reduce(DataFrame.unionByName, [*rounds, made.where(done), last])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"), Scratch(spark, "packing"), default_tokenizer())
