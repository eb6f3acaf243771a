"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes when a string of `length` bytes that covers it also starts somewhere else, in this document or another. Sorting a suffix
for every byte is not needed for that. Of the suffixes of a text, those are kept that start at anchors: for each window of
`length` bytes, the place whose next `core` bytes have the smallest hash. Equal windows have equal anchors at equal places, so
all that has to be compared are windows with one anchor text. A window of consecutive starts with one anchor is a run; an
entry of the index is a run with the fingerprint of its core and of its whole text.

The index is a family of arrays of entries in order of fingerprint (equality of bounded prefixes is all that counts, so any order
will do). A new batch is sorted, entries that repeat in it are found between neighbours, and it is scanned against each level by
binary search; then it becomes a level, and levels of like size merge, so each entry is merged log(n) times. Tasks build
families over their own documents first: what repeats there is settled and one entry of each kind goes on; a family of more than
HELD_ENTRIES is sent on and another begun. Entries are dealt by core and a second family finds the repeats between tasks. Equal
runs are repeats whole. Where a core has runs that differ, at the ends of repeated passages, their windows are compared one by
one, by a third family over window fingerprints: the texts of these runs are fetched once, and runs of a core with more than
HOT_RUNS different ones are dealt by window, those that repeat within a task settled there, so no task gathers them.

Cores that one text in SAMPLED shows to have so many runs are dealt by core and run from the start, and go to single windows.
That decides where entries meet, not what is found: equal runs meet either way, and a core that the sample has missed is dealt by itself.

Equality is that of a 64-bit fingerprint of the text among strings whose cores have equal 64-bit fingerprints as well. Fingerprints
are sums over each eight bytes, mixed without linear structure first, so that unequal texts that share one cannot be built from
the powers of the base alone.

Edge cases: null and empty texts and those below `length` bytes lose nothing; texts of any length are read whole, in overlapping
pieces; rows with equal id and text lose all of it if it is long enough, as each starts in the other; rows with one id and
unequal texts are apart; rows without id count like others; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .common import KEPT, Scratch, make_room, mix, powers, read, text_bytes

LENGTH = 200
CORE = 100
PIECE_BYTES = 1 << 18
BATCH_ENTRIES = 1 << 15
HOT_RUNS = 4096
SAMPLED = 64
#: Cores known to be hot: the most frequent ones, as many as may be broadcast.
HOT_CORES = 200_000
HELD_ENTRIES = 1 << 21
_LOW = np.uint64((1 << 22) - 1)
_A, _B = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)


class Sizes(NamedTuple):
    """What the tasks of a run go by; hot_runs is at least 1."""

    length: int = LENGTH
    core: int = CORE
    piece: int = PIECE_BYTES
    hot_runs: int = HOT_RUNS
    held: int = HELD_ENTRIES
    sampled: int = SAMPLED


class Family:
    """Levels of entries (key, check, hit, value) sorted by key and check; add() gives the values found to repeat."""

    def __init__(self, columns: int):
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.none = np.zeros((0, columns), np.int64)

    def add(self, key: np.ndarray, check: np.ndarray, hit: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((check, key))
        key, check, hit, value = key[order], check[order], hit[order], value[order]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        out = [value[again & ~hit]]
        first = np.flatnonzero(np.concatenate(([True], ~same)))[: len(key)]
        hit = np.logical_or.reduceat(hit | again, first) if len(first) else hit
        key, check, value = key[first], check[first], value[first]
        for k, c, h, v in self.levels:
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            found = (k[at] == key) & (c[at] == check)
            old = at[found]
            fresh = old[~h[old]]
            out.append(v[fresh])
            h[old] = True
            out.append(value[found & ~hit])
            key, check, hit, value = key[~found], check[~found], hit[~found], value[~found]
        if len(key):
            self.levels.append((key, check, hit, value))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()
        return np.concatenate(out) if out else self.none

    def _merge(self) -> None:
        """The last two levels become one, column by column: no more than a column is there twice."""
        late, early = list(self.levels.pop()), list(self.levels.pop())
        to_early = np.searchsorted(late[0], early[0], "left") + np.arange(len(early[0]))
        to_late = np.searchsorted(early[0], late[0], "right") + np.arange(len(late[0]))
        for i in range(len(early)):
            both = np.empty((len(to_early) + len(to_late), *early[i].shape[1:]), early[i].dtype)
            both[to_early], both[to_late] = early[i], late[i]
            early[i], late[i] = both, None
        self.levels.append(tuple(early))

    def size(self) -> int:
        return sum(len(k) for k, _, _, _ in self.levels)

    def empty(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The entries in blocks; the family begins anew."""
        levels, self.levels = self.levels, []
        while levels:
            level = levels.pop()
            for a in range(0, len(level[0]), BATCH_ENTRIES):
                yield tuple(x[a : a + BATCH_ENTRIES] for x in level)


def _sums(data: np.ndarray, core: int) -> tuple[np.ndarray, int]:
    """Sums of the mixed words at each place of data, times powers of the base, and the bytes of a word (eight, or the core if it is less).

    A string from start to end has the words at start ... end - bytes, which cover each of its bytes.
    """
    unit = min(8, core)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = mix((np.ndarray(len(data), "<u8", padded, strides=(1,)) & KEPT[unit]) ^ _A)
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words * up[: len(data)], out=out[1:])
    return out, unit


def anchors(data: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """core fingerprint, run fingerprint, first start, number of starts and core offset of each run of a text."""
    sums, unit = _sums(data, core)
    _, down = powers(len(sums))
    n = len(data) - core + 1
    inner = core - unit + 1
    h = mix((sums[inner : inner + n] - sums[:n]) * down[:n])
    low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    width, span = length - core + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & _LOW).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    end = np.append(start[1:], len(anchor))
    run = end - start
    whole = mix((sums[end + length - unit] - sums[start]) * down[start] + run.astype(np.uint64))
    return h[anchor[start]], whole, start, run, anchor[start] - start


def _pieces(text: np.ndarray, sizes: Sizes) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(text) - sizes.length + 1, sizes.piece):
        yield at, text[at : at + sizes.piece + sizes.length - 1]


#: kind 0: bytes start to start + run + length - 1 go; kind 1: an entry. hit: whether the entry's own bytes are marked already.
ENTRY = "kind int, id long, mark long, core long, whole long, start long, run int, offset int, hit boolean, others int"
_ENTRY = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("mark", pa.int64()), ("core", pa.int64()), ("whole", pa.int64()), ("start", pa.int64()), ("run", pa.int32()), ("offset", pa.int32()), ("hit", pa.bool_()), ("others", pa.int32())])


def _out(kind: int, value: np.ndarray, core: np.ndarray | None = None, whole: np.ndarray | None = None, hit: np.ndarray | None = None, others: np.ndarray | None = None) -> pa.RecordBatch:
    """value: id, mark, start, run, offset."""
    n = len(value)
    zero = np.zeros(n, np.int64)
    if core is None:  # marks meet no other entry: dealt by where they are, not by texts, of which there may be very many copies
        core = mix(value[:, 0].astype(np.uint64) * _A + (value[:, 2] >> 16).astype(np.uint64))
    columns = [np.full(n, kind), value[:, 0], value[:, 1], core.astype(np.int64), zero if whole is None else whole.astype(np.int64), value[:, 2], value[:, 3], value[:, 4], zero.astype(bool) if hit is None else hit, zero if others is None else others]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if f.type == pa.bool_() else pa.array(c).cast(f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY)


def _key(core: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mix(core * _A + whole * _B)


def _first_family(sizes: Sizes):
    """From (id, mark, text) to marks and one entry for each different run of the task, or of so much of it as is held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        family, held, n = Family(5), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                core, whole, value = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                value = np.column_stack((value, core.astype(np.int64), whole.astype(np.int64)))
                gone = family.add(_key(core, whole), core, np.zeros(len(core), bool), value)
                if len(gone):
                    yield _out(0, gone)
            if family.size() > most:
                yield from sent()

        def sent() -> Iterator[pa.RecordBatch]:
            for _, _, hit, value in family.empty():
                yield _out(1, value, value[:, 5], value[:, 6], hit)

        most = sizes.held
        family.none = np.zeros((0, 7), np.int64)
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(2))
            for i in np.flatnonzero(np.diff(offsets) >= sizes.length):
                for at, piece in _pieces(data[offsets[i] : offsets[i + 1]], sizes):
                    core, whole, start, runs, offset = anchors(piece, sizes.length, sizes.core)
                    value = np.column_stack((np.full(len(core), ids[i]), np.full(len(core), marks[i]), start + at, runs, offset))
                    held.append((core, whole, value))
                    n += len(core)
                    if n >= min(BATCH_ENTRIES, most):
                        yield from settle()
                        n = 0
        yield from settle()
        yield from sent()

    return run


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(_ENTRY)}


def _second_family(sizes: Sizes):
    """Marks pass; entries of all tasks meet by core, or by run where `others` says that their core is hot. Left are the runs whose core
    has others that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        family, hot = Family(7), np.zeros(0, np.int64)
        for batch in batches:
            c = _columns(batch)
            mark = c["kind"] == 0
            if mark.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(mark)).columns, schema=_ENTRY)
            e = {k: v[~mark] for k, v in c.items()}
            core, whole = e["core"].astype(np.uint64), e["whole"].astype(np.uint64)
            value = np.column_stack([e[k] for k in ("id", "mark", "start", "run", "offset", "core", "whole")]).astype(np.int64)
            hot = np.union1d(hot, e["core"][e["others"] > sizes.hot_runs])
            gone = family.add(_key(core, whole), core, e["hit"].astype(bool), value)
            if len(gone):
                yield _out(0, gone)
        # how many runs each core has; only the cores are sorted, entries stay where they are
        core = np.concatenate([np.zeros(0, np.uint64), *(level[1] for level in family.levels)])
        order = np.argsort(core)
        ranked = core[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(core) else np.zeros(0, int)
        count = np.diff(np.append(first, len(core)))
        others = np.empty(len(core), np.int64)
        others[order] = np.repeat(count, count)
        del order, ranked
        others[np.isin(core.astype(np.int64), hot)] = sizes.hot_runs + 1
        begin = 0
        for _, own, hit, value in family.levels:
            open_ = np.flatnonzero(others[begin : begin + len(own)] > 1)
            for a in range(0, len(open_), BATCH_ENTRIES):
                i = open_[a : a + BATCH_ENTRIES]
                yield _out(1, value[i], own[i], value[i, 6], hit[i], others[begin + i])
            begin += len(own)

    return run


#: run 0: a window that is known to repeat
WINDOW = "deal long, core long, id long, mark long, start long, run int, offset int, hit boolean, piece binary"
_WINDOW = (*(pa.int64(),) * 5, pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def _windows_of(sizes: Sizes):
    """From (id, mark, text, runs) to the text of each run, or for runs of hot cores to single windows, each different one once."""

    def rows(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) if isinstance(c, np.ndarray) else pa.array(c, t) for c, t in zip(columns, _WINDOW, strict=True)], names=[x.split()[0] for x in WINDOW.split(", ")])

    def single(key: np.ndarray, value: np.ndarray, hit: np.ndarray, run: int) -> pa.RecordBatch:
        """Windows; value: id, mark, start, offset, core."""
        n = len(value)
        return rows([key.astype(np.int64), value[:, 4], value[:, 0], value[:, 1], value[:, 2], np.full(n, run), value[:, 3], hit, [None] * n])

    def settled(gone: np.ndarray) -> pa.RecordBatch:
        # dealt by where they are, as they meet no other
        return single(mix(gone[:, 0].astype(np.uint64) * _A + gone[:, 2].astype(np.uint64)), gone, np.ones(len(gone), bool), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(5)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = []
            for i, (id_, mark, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                held = []
                for r in runs:
                    piece = text[r["start"] : r["start"] + r["run"] + sizes.length - 1]
                    if r["others"] <= sizes.hot_runs:
                        out.append((r["core"], r["core"], id_, mark, r["start"], r["run"], r["offset"], r["hit"], piece.tobytes()))
                        if len(out) >= 4096:
                            yield rows(list(zip(*out, strict=True)))
                            out = []
                    else:
                        n = r["run"]
                        j = np.arange(n)
                        value = np.column_stack((np.full(n, id_), np.full(n, mark), r["start"] + j, r["offset"] - j, np.full(n, r["core"])))
                        held.append((_window_keys(piece, np.array([0]), np.array([n]), sizes.length, sizes.core), np.full(n, r["hit"]), value))
                if held:
                    key, hit, value = (np.concatenate(x) for x in zip(*held, strict=True))
                    gone = family.add(key, _place(value[:, 4], value[:, 3]), hit, value)
                    if len(gone):
                        yield settled(gone)
                if family.size() > sizes.held:
                    yield from (single(k, v, h, 1) for k, _, h, v in family.empty())
            if out:
                yield rows(list(zip(*out, strict=True)))
        yield from (single(k, v, h, 1) for k, _, h, v in family.empty())

    return run


def _place(core: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A check of windows beside their fingerprint: the core they hold and where."""
    return mix(core.astype(np.uint64) * _A + offset.astype(np.uint64))


def _window_keys(data: np.ndarray, at: np.ndarray, runs: np.ndarray, length: int, core: int) -> np.ndarray:
    """Fingerprints of the windows that start at at, at + 1, ... in data."""
    sums, unit = _sums(data, core)
    _, down = powers(len(sums))
    start = np.repeat(at - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
    return mix((sums[start + length - unit + 1] - sums[start]) * down[start])


def _third_family(sizes: Sizes):
    """Marks of windows that repeat, as (id, mark, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        family = Family(3)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                deal, core, ids, marks, start, runs, offset, hit = (part.column(i).to_numpy(zero_copy_only=False) for i in range(8))
                runs = runs.astype(np.int64)
                if (known := runs == 0).any():
                    yield _spans(np.column_stack((ids, marks, start))[known], sizes.length)
                pieces = part.column(8)
                whole = np.array([x.is_valid for x in pieces])
                row = np.repeat(np.arange(len(runs)), runs)
                j = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                key = deal.astype(np.uint64)[row]
                if whole.any():
                    joined = np.frombuffer(b"".join(x.as_py() for x in pieces if x.is_valid), np.uint8)
                    long = runs[whole] + sizes.length - 1
                    key[whole[row]] = _window_keys(joined, np.cumsum(long) - long, runs[whole], sizes.length, sizes.core)
                check = _place(core[row], offset[row] - j)
                value = np.column_stack((ids[row], marks[row], start[row] + j))
                gone = family.add(key, check, hit.astype(bool)[row], value)
                if len(gone):
                    yield _spans(gone, sizes.length)

    return run


def _spans(gone: np.ndarray, length: int) -> pa.RecordBatch:
    """Consecutive starts of one text as one span."""
    gone = gone[np.lexsort((gone[:, 2], gone[:, 1], gone[:, 0]))]
    new = np.concatenate(([True], (gone[1:, :2] != gone[:-1, :2]).any(1) | (gone[1:, 2] > gone[:-1, 2] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(gone)) - 1
    return pa.RecordBatch.from_arrays([pa.array(gone[first, 0]), pa.array(gone[first, 1]), pa.array(gone[first, 2]), pa.array(gone[last, 2] + length)], names=["id", "mark", "start", "end"])


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """A row's id and the hash of its text: rows that share both have one text and one result."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _hot_cores(texts: DataFrame, sizes: Sizes) -> DataFrame:
    """(core): cores that have more than hot_runs different runs, as far as one text in `sampled` shows."""
    some = texts.where(F.pmod(F.xxhash64("id", "mark", F.lit(5)), F.lit(sizes.sampled)) == 0).mapInArrow(_first_family(sizes), ENTRY)
    runs = some.where("kind = 1").select("core", "whole").distinct().groupBy("core").agg(F.count("*").alias("n"))
    return runs.where(F.col("n") > sizes.hot_runs // sizes.sampled).orderBy(F.desc("n"), "core").limit(HOT_CORES).select("core")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, core: int = CORE, sizes: Sizes = Sizes()) -> DataFrame:
    """(id, mark, start, end): byte spans to remove from the rows with these identities, with overlaps."""
    sizes = sizes._replace(length=length, core=core)
    id_, mark = _identity(docs)
    texts = docs.select(id_.alias("id"), mark.alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") >= length)
    hot = scratch.save(_hot_cores(texts, sizes), "hot").select("core", F.lit(True).alias("is_hot"))
    entries = texts.mapInArrow(_first_family(sizes), ENTRY).join(F.broadcast(hot), "core", "left")  # no more than HOT_CORES
    deal = F.when(F.col("is_hot"), F.xxhash64("core", "whole")).otherwise(F.col("core"))
    entries = entries.withColumn("others", F.when(F.col("is_hot"), F.lit(sizes.hot_runs + 1)).otherwise(F.lit(0))).repartition(deal)
    found = scratch.save(entries.select(*_ENTRY.names).mapInArrow(_second_family(sizes), ENTRY), "entries", 4000)
    scratch.release()
    open_ = found.where("kind = 1").groupBy("id", "mark").agg(F.collect_list(F.struct("core", "start", "run", "offset", "hit", "others")).alias("runs"))
    fetched = texts.join(open_.hint("shuffle_hash"), ["id", "mark"]).select("id", "mark", "text", "runs")
    # rows with one identity bring the same runs twice, and rightly match: each text starts in the other row too
    windows = fetched.mapInArrow(_windows_of(sizes), WINDOW).repartition("deal")
    spans = scratch.save(windows.mapInArrow(_third_family(sizes), "id long, mark long, start long, end long"), "spans", 2000)
    scratch.release()
    return spans.union(found.where("kind = 0").select("id", "mark", "start", (F.col("start") + F.col("run") + F.lit(length - 1)).alias("end")))


def cut(docs: DataFrame, spans: DataFrame, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes that are left), in columns of a struct named `cut`, or cut_ ...

    as_text: kept is a string, without the rest of characters that a cut went through. Spans of a row are no more than the bytes of its text, so they come to it as one list.
    """
    name = "cut"
    while name in docs.columns:
        name += "_"
    id_, mark = _identity(docs)
    lists = spans.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    rows = docs.withColumn("__key", F.struct(id_.alias("id"), mark.alias("mark"))).join(lists.hint("shuffle_hash"), (F.col("__key.id") == F.col("__id")) & (F.col("__key.mark") == F.col("__mark")), "left")
    rows = rows.select(*docs.columns, "__spans")
    columns = list(docs.columns)
    text = columns.index("text")
    fields = StructType().add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()).add("kept", StringType() if as_text else BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                data, offsets = text_bytes(part.column(text))
                out = []
                for i, spans in enumerate(part.column(part.num_columns - 1)):
                    own = data[offsets[i] : offsets[i + 1]]
                    if not spans.is_valid:
                        out.append((len(own), 0, 0, own.tobytes()))
                        continue
                    s = spans.values
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, s.field(0).to_numpy(), 1)
                    np.add.at(change, s.field(1).to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    starts = gone & ~np.concatenate(([False], gone[:-1]))
                    out.append((len(own), int(gone.sum()), int(starts.sum()), own[~gone].tobytes()))
                if as_text:
                    out = [(*o[:3], o[3].decode("utf-8", "ignore")) for o in out]
                made = pa.StructArray.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))], names=["n_bytes", "n_removed", "n_spans", "kept"])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*columns, name])

    return rows.mapInArrow(run, StructType([*docs.schema.fields]).add(name, fields))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = cut(docs, repeated_spans(docs, Scratch(spark, "suffix")))
    return made.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))
