"""SentencePiece BPE encoding and decoding with a prefix table.

The encoding of a text by merges has this property: the encoding of each prefix ends with one token, and that token is the
only vocabulary match ending there which is compatible with the last token of the prefix before it. So one pass over the
matches of an Aho-Corasick automaton fills a table of last tokens, and the ids are read off backwards: linear time, no
queue of merges.

Two tokens are compatible when encoding their concatenation gives just these two. The test takes their merges apart, latest
first, and looks whether a merge across the border would have come before.

Texts are cut before each run of spaces (no piece holds a space after another character) and at characters outside the
vocabulary, which become byte tokens. Tables of words seen are kept up to a fixed number of entries.

Edge cases: null and empty texts give the end id only and decode to the empty string; very long texts and words are encoded
whole in linear time; repeated rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, read

SPACE = "▁"
#: Words kept in each of two generations.
MOST_WORDS = 400_000
MOST_PAIRS = 800_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_runs = re.compile(f"{SPACE}+[^{SPACE}]*")


class Words(dict):
    """Encoded words by their text after the first space, in two generations of at most MOST_WORDS."""

    def __init__(self, make: Callable[[str], tuple]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> tuple:
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= 64:
            if len(self) >= MOST_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.end = lib.eos_id()
        self.unknown = lib.unk_id()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        # a merge's place in time: by falling score
        self.rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-lib.get_score(i), i)))}
        self.chars = {c for p in self.ids for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside, so words can't be encoded apart")
        self.halves: dict[int, tuple[int, int] | None] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1:
                self.halves[i] = None
            elif (made := self._last_merge(p)) is not None:
                self.halves[i] = made
            else:
                continue  # merges never make this piece
            automaton.add_word(p, i)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.left = [-1] * n
        self.right = [-1] * n
        self.size = [0] * n
        self.time = [-1] * n
        # rank of the merge of two pieces into a third
        self.across: dict[int, int] = {}
        for p, i in self.ids.items():
            self.size[i] = len(p)
            if self.halves.get(i):
                self.left[i], self.right[i] = self.halves[i]
                self.time[i] = self.rank[i]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.across[a << 32 | b] = self.rank[i]
        self.words = Words(lambda word: self._word(SPACE + word))
        self.fits: dict[int, bool] = {}

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two ids whose merge makes this piece, if merging its characters ends in it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        a, b = self.ids.get(parts[0]), self.ids.get(parts[1])
        return None if a is None or b is None else (a, b)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        across, time, left, right = self.across.get, self.time, self.left, self.right
        before = 1 << 40  # a merge across the border of a lower rank than this would have happened
        while True:
            merged = across(a << 32 | b)
            if merged is not None and merged < before:
                return False
            ta, tb = time[a], time[b]
            if ta < 0 and tb < 0:
                return True
            if ta > tb:
                before, a = ta, right[a]  # of two equal merges, the left one comes first
            else:
                before, b = tb + 1, left[b]

    def _known(self, text: str) -> list[int]:
        """Ids of characters that are all in the vocabulary."""
        n = len(text)
        last = [-1] * (n + 1)
        last[0] = -2
        known, compatible, length = self.fits.get, self.compatible, self.size
        for end, token in self.matches(text):
            end += 1
            if last[end] == -1:
                before = last[end - length[token]]
                if before >= 0:
                    fits = known(before << 32 | token)
                    if fits or fits is None and compatible(before, token):
                        last[end] = token
                elif before == -2:
                    last[end] = token
        out = []
        while n:
            out.append(token := last[n])
            n -= length[token]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[list[int], str]:
        if self.chars.issuperset(word):
            ids = self._known(word)
        else:
            ids, run = [], ""
            for c in word:
                if c in self.chars:
                    run += c
                    continue
                if run:
                    ids += self._known(run)
                    run = ""
                ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
            if run:
                ids += self._known(run)
        return ids, " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same as decimal numbers joined by one space."""
        if not text:
            return [self.end], str(self.end)
        if "  " not in text and SPACE not in text and text[0] != " ":
            words = text.split(" ")
        else:
            words = [w[1:] for w in _runs.findall(SPACE + text.replace(" ", SPACE))]
        each, said = zip(*map(self.words.__getitem__, words), strict=True)
        ids = list(chain.from_iterable(each))
        ids.append(self.end)
        return ids, f"{' '.join(said)} {self.end}"

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def codec(path: str) -> Codec:
    return held((Codec, path), lambda: Codec(path))


def encode_table(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) with ids as an array."""
    return _table(docs, path, True, decode)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _table(docs: DataFrame, path: str, with_ids: bool, decode: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        gc.disable()  # nothing here makes cycles, and walking the words kept costs more than encoding
        try:
            yield from encoded(c, batches)
        finally:
            gc.enable()

    def encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for text in part.column(1):
                    ids, said = c.encode(text.as_py() or "")
                    back = hashlib.sha256(c.decode(ids).encode()).hexdigest() if decode else None
                    rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), back, ids if with_ids else None))
                out = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text with the end id, decode, and return digests."""
    return _table(read(spark, sf_dir, "documents"), default_model(), False, True)
