"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersections.

A document's set is its distinct 3-word shingles, as 64-bit hashes. Equal sets are one class. Two sets of similarity t or more share
one of the first n - ceil(t n) + 1 shingles of either in any common order, so documents meet in tiles by such a shingle. The
order puts shingles by how often their hash bucket occurs in the corpus (counted over all documents), so frequent ones come
last and tiles stay small. Nothing is lost: any order will do.

A document stays in a tile only if another of like size is there, and of tiles with the same documents one stays.
Only components are asked for, so a tile need not compare what is already linked. First each tile and size band compares its
smallest document with the others, which links groups of copies in as many comparisons as members. Then tiles that hold more than
one component compare the rest across components: first a few tiles of each document, of whose pairs a spanning forest is verified, and then all that still do. Small ones name their pairs of like size, and each distinct pair is
bounded once; in large ones documents of a size band meet those of the same and the next band (a band's
sizes differ by the factor t at most), block by block. Both bound the intersection from above by bit counts of signatures: a signature has the parity
of the shingles in each of as many bits as the set has members, so the bits in which two differ are no more than
the shingles they don't share. Pairs that the bound lets pass are verified on the sorted arrays of hashes, and those that pass
this on the shingles' words themselves, so no link rests on a hash. Sets are taken for equal (one class) by size and 128 bits of digest.

Edge cases: null and empty texts and texts without words have an empty set and link with nothing; texts of one or two words have
one shingle, the whole; texts are read whole; repeated doc_ids are separate rows, and what links one links all of that id; ties
take the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, components, joined_components, make_room, mix, read, sided, slices, text_bytes, word_hashes

WORDS = 3
PERCENT = 90
HEAT_BITS = 16
BLOCK = 256
#: Tiles of at most so many documents name their pairs; signatures go to larger ones.
SMALL_TILE = 32
#: Documents of a size band of a tile that a task compares with as many others; larger bands are cut into blocks of about so many.
TILE_BLOCK = 1024
#: Tiles of each document that are looked at before all others.
FEW_TILES = 4
_LOWER = bytes(LOWER)
_MULTIPLIERS = [np.uint64(x) for x in (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of the rows, sorted by both."""
    h, row, _, _ = word_hashes(LOWER[data], bounds)
    n = len(bounds) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    # a row of fewer words has one shingle of them all
    short = np.flatnonzero((count > 0) & (count < words))
    out_r, out_h = [], []
    if len(h) >= words:
        m = len(h) - words + 1
        made = reduce(np.add, (h[k : k + m] * _MULTIPLIERS[k] for k in range(words)))
        same = row[:m] == row[words - 1 :]
        out_r.append(row[:m][same])
        out_h.append(mix(made[same]))
    for s in short:
        w = h[first[s] : first[s] + count[s]]
        out_r.append(np.array([s]))
        out_h.append(mix((w * np.array(_MULTIPLIERS[: len(w)])).sum(keepdims=True) * _MULTIPLIERS[7] + np.uint64(len(w))))
    if not out_r:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, v = np.concatenate(out_r), np.concatenate(out_h)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    keep = np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))) if len(r) else np.zeros(0, bool)
    return r[keep], v[keep]


def sets_of(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows a to b: a, b, places of each row's shingles, row and hash of the shingles."""
    make_room()
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        r, v = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        yield a, b, np.searchsorted(r, np.arange(b - a + 1)), r, v


def heat(docs: DataFrame, words: int) -> np.ndarray:
    """For each of 2**HEAT_BITS hash buckets, how often it occurs: 0, or the power of two above eight times the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HEAT_BITS, np.int64)
        for batch in batches:
            for _, _, _, _, v in sets_of(batch.column(0), words):
                total += np.bincount((v >> np.uint64(64 - HEAT_BITS)).astype(np.int64), minlength=len(total))
        # one row a task, of fixed length
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HEAT_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "counts binary")
    n = docs.rdd.getNumPartitions()
    while n > 32:  # level by level, so that no task and not the driver adds up more than a few dozen
        n = -(-n // 32)
        parts = parts.repartition(n).mapInArrow(add, "counts binary")
    total = np.zeros(1 << HEAT_BITS, np.int64)
    for row in parts.collect():
        total += np.frombuffer(row.counts, np.int64)
    mean = max(1.0, total.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(total / mean, 1))) - 2).astype(np.uint8)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def bits_of(n: np.ndarray) -> np.ndarray:
    """Bits of a set's signature: a power of two, at least 64 and the size."""
    return 64 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 64))).astype(np.int64)


SIGNATURE = "doc_id long, n long, s1 long, s2 long, bitmap binary, keys array<long>"


def signatures(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """Size, digest, parity bitmap and prefix of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, at, r, v in sets_of(batch.column(1), words):
                n = np.diff(at)
                sums = np.zeros((2, b - a), np.uint64)
                some = np.flatnonzero(n)
                if len(v):
                    sums[0, some] = np.add.reduceat(mix(v ^ _MULTIPLIERS[3]), at[some])
                    sums[1, some] = np.bitwise_xor.reduceat(mix(v ^ _MULTIPLIERS[4]), at[some])
                # parity of the shingles in each bit
                bits = bits_of(n)
                start = np.concatenate(([0], np.cumsum(bits // 8)))
                place = start[r] * 8 + (mix(v ^ _MULTIPLIERS[5]) & (bits[r] - 1).astype(np.uint64)).astype(np.int64)
                flat = np.zeros(int(start[-1]) * 8, np.uint8)
                odd, times = np.unique(place, return_counts=True)
                flat[odd] = times & 1
                packed = np.packbits(flat, bitorder="little").tobytes()
                # the first shingles by heat, then hash
                order_key = (levels[(v >> np.uint64(64 - HEAT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(59)) | (v & np.uint64((1 << 59) - 1))
                order = np.lexsort((order_key, r))
                rank = np.arange(len(r)) - at[:-1][r]
                chosen = rank < prefix_length(n, percent)[r]
                keys = v[order][chosen].astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, prefix_length(n, percent), 0))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1].astype(np.int64)),
                        pa.array([packed[s:e] for s, e in zip(start[:-1], start[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)),
                    ],
                    names=["doc_id", "n", "s1", "s2", "bitmap", "keys"],
                )

    return docs.mapInArrow(run, SIGNATURE)


def words_of(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The set of a text, as tuples of its words; bytes.split() without arguments knows the same six separators."""
    own = text.translate(_LOWER).split()
    if len(own) < words:
        return {tuple(own)} if own else set()
    return set(zip(*[own[k:] for k in range(words)], strict=False))


def verify(docs: DataFrame, pairs: DataFrame, scratch: Scratch, tag: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: by intersection of sorted arrays of hashes, and those that pass by their words."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).dictionary_encode()
            place = texts.indices.to_numpy().reshape(2, -1)
            arrays: list[np.ndarray] = []
            for _, _, at, _, v in sets_of(texts.dictionary, words):
                arrays += [v[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
            exact: dict[int, set] = {}

            def exactly(i: int) -> set:
                if i not in exact:
                    if len(exact) == 64:
                        exact.clear()
                    exact[i] = words_of(texts.dictionary[i].as_buffer().to_pybytes(), words)
                return exact[i]

            keep = []
            for i, j in place.T.tolist():
                x, y = arrays[i], arrays[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                may = 100 * both >= percent * (len(x) + len(y) - both)
                if may:
                    p, q = exactly(i), exactly(j)
                    may = 100 * len(p & q) >= percent * len(p | q)
                keep.append(may)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = scratch.save(docs.join(sided(scratch.save(ids, f"ids-{tag}")), "doc_id", "left_semi"), f"texts-{tag}")
    # rows that share an id and have unlike texts are all compared
    side = lambda id_, text: texts.select(F.col("doc_id").alias(id_), F.coalesce("text", F.lit("")).alias(text))
    found = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    links = scratch.save(found.mapInArrow(check, "a long, b long").distinct(), f"links-{tag}", 256)
    scratch.drop(f"texts-{tag}")
    scratch.drop(f"ids-{tag}")
    return links


def screen(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that signatures let pass; maps has (id, n, bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(3), batch.column(5), strict=True)
            keep = [_may(p, q, x.as_buffer(), y.as_buffer(), percent) for p, q, x, y in sizes]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda id_, n, bitmap: maps.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("bitmap").alias(bitmap))
    both = pairs.join(side("a", "p", "x"), "a").join(side("b", "q", "y"), "b")
    return both.select("a", "b", "p", "x", "q", "y").mapInArrow(run, "a long, b long").distinct()


def folded(bitmap: bytes, words: int) -> np.ndarray:
    """A signature with fewer bits: halves laid over each other keep the parity."""
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _may(p: int, q: int, x: bytes, y: bytes, percent: int) -> bool:
    """intersection <= (sum of sizes - bits apart) / 2, and similarity >= t needs (100 + t) x it >= t x sum."""
    if 100 * min(p, q) < percent * max(p, q):
        return False
    words = min(len(x), len(y)) // 8
    apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return (100 + percent) * (p + q - apart) >= 2 * percent * (p + q)


def _shared(percent: int) -> Callable:
    """Of rows sorted by key and n, those with a neighbour of the same key and a size near enough; others have no partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        kept = False  # whether the row held back has a partner before it

        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            near = False
            if last is not None:
                near = bool(last.column(0)[0].as_py() == key[0] and 100 * last.column(2)[0].as_py() >= percent * n[0])
                if kept or near:
                    yield last
            same = np.concatenate(([near], (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])))
            keep = same.copy()
            keep[:-1] |= same[1:]
            keep[-1] = False
            yield batch.filter(pa.array(keep))
            last, kept = batch.slice(batch.num_rows - 1, 1), bool(same[-1])
        if last is not None and kept:
            yield last

    return run


def _pairs_of_small(percent: int) -> Callable:
    """Pairs of unlike components and like sizes in tiles of at most SMALL_TILE rows, from rows (key, n, id, component) sorted by key and n."""

    def pairs(key: np.ndarray, n: np.ndarray, i: np.ndarray, component: np.ndarray) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, SMALL_TILE):
            same = key[d:] == key[:-d]
            if not same.any():
                break
            a = np.flatnonzero(same & (component[d:] != component[:-d]) & (100 * n[:-d] >= percent * n[d:]))
            found.append(np.sort(np.column_stack((i[a], i[a + d])), axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last tile may go on
            if cut:
                yield pairs(*[x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield pairs(*held)

    return run


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones have not joined: no more than there are documents."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[y] = x
            kept.append((a, b))
    return kept


def _tiles(percent: int, forest: bool) -> Callable:
    """Candidate pairs (or with `forest` a spanning forest of each tile's) of rows (key, band, i, j, role, n, id, component, bitmap), sorted.

    Role 0: block i of the band, 1: its block j, 2: block j of the next band's members.
    """

    def compare(a: list[tuple], b: list[tuple], same: bool) -> list[tuple[int, int]]:
        out = []
        for i in range(0, len(a), BLOCK):
            for j in range(i if same else 0, len(b), BLOCK):
                p, q = a[i : i + BLOCK], b[j : j + BLOCK]
                np_, nq = np.array([x[0] for x in p]), np.array([x[0] for x in q])
                small, large = np.minimum(np_[:, None], nq), np.maximum(np_[:, None], nq)
                may = (100 * small >= percent * large) & (np.array([x[2] for x in p])[:, None] != np.array([x[2] for x in q]))
                if same and i == j:
                    may = np.triu(may, 1)
                if not may.any():
                    continue
                size = min(len(x[3]) // 8 for x in p + q)
                sp, sq = np.array([folded(x[3], size) for x in p]), np.array([folded(x[3], size) for x in q])
                apart = np.bitwise_count(sp[:, None] ^ sq).sum(2, dtype=np.int64)
                total = np_[:, None] + nq
                may &= (100 + percent) * (total - apart) >= 2 * percent * total
                out += [(min(p[x][1], q[y][1]), max(p[x][1], q[y][1])) for x, y in zip(*np.nonzero(may), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple | None = None
        left: list[tuple] = []
        others: list[tuple] = []  # of the other block or of the next band, a few at a time

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = sorted({p for p in pairs if p[0] != p[1]})
            if forest:
                pairs = _forest(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        def rest() -> list[tuple[int, int]]:
            return (compare(left, left, True) if tile[2] == tile[3] else []) + compare(left, others, False)

        for batch in batches:
            for key, band, i, j, role, n, id_, component, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, band, i, j) != tile:
                    if left:
                        yield batch_of(rest())
                    tile, left, others = (key, band, i, j), [], []
                if role == 0:
                    left.append((n, id_, component, bitmap))
                elif left:
                    others.append((n, id_, component, bitmap))
                    if len(others) == 4 * BLOCK:
                        yield batch_of(compare(left, others, False))
                        others = []
        if left:
            yield batch_of(rest())

    return run


def _meeting(i: str, j: str, role: int) -> Column:
    return F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(role).alias("role"))


def _unlinked(posts: DataFrame, labels: DataFrame, maps: DataFrame, scratch: Scratch, turn: str, tiles_of_each: int | None, percent: int) -> DataFrame:
    """Pairs (a, b) of unlike components that share a tile and that signatures let pass."""
    if tiles_of_each:
        # the same tiles for like documents: first by hash
        place = F.row_number().over(Window.partitionBy("id", "n").orderBy(F.xxhash64("key"), "key"))
        posts = posts.withColumn("place", place).where(F.col("place") <= tiles_of_each).drop("place")
    named = posts.join(labels, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    unlike = scratch.save(named.join(mixed, "key"), f"unlike-{turn}")
    scratch.release()
    size = unlike.groupBy("key").agg(F.count("*").alias("size"))
    unlike = unlike.join(size, "key")
    small = unlike.where(F.col("size") <= SMALL_TILE).select("key", "n", "id", "component")
    small = small.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(_pairs_of_small(percent), "a long, b long").distinct()
    large = unlike.where(F.col("size") > SMALL_TILE)
    # a band of a tile is cut into blocks, and each pair of blocks is a task's: no task holds more than a block
    blocks = large.groupBy("key", "band").agg(F.ceil(F.count("*") / TILE_BLOCK).cast("int").alias("blocks"))
    members = large.select("key", "band", F.lit(False).alias("visitor"), "n", "id", "component").union(large.where("band > 0").select("key", F.col("band") - 1, F.lit(True), "n", "id", "component"))
    members = members.join(blocks, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("id", "n"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = F.when(F.col("visitor"), F.array(_meeting("other", "own", 2))).when(F.col("other") < F.col("own"), F.array(_meeting("own", "other", 0), _meeting("other", "own", 1))).otherwise(F.array(_meeting("own", "other", 0)))
    members = members.withColumn("m", F.explode(meets)).select("key", "band", "m.i", "m.j", "m.role", "n", "id", "component").join(maps, ["id", "n"])
    tiles = members.select("key", "band", "i", "j", "role", "n", "id", "component", "bitmap").repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "role", "n", "id")
    found = tiles.mapInArrow(_tiles(percent, bool(tiles_of_each)), "a long, b long").distinct()
    return found.union(screen(small, maps, percent))


def join(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = scratch.save(signatures(docs, heat(docs, words), words, percent), "signatures", 2000)
    digest = ["n", "s1", "s2"]
    classes = scratch.save(marks.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("id")), "classes")
    reps = marks.where("n > 0").join(classes.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), [*digest, "doc_id"], "left_semi")
    posts = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "n")
    posts = scratch.save(posts.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_shared(percent), "key long, id long, n long"), "posts")
    scratch.release()
    # tiles of the same documents find the same pairs: one of them is enough
    print_ = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("id", "n")).alias("x"), F.sum(F.xxhash64("n", "id").cast("decimal(38,0)")).alias("s")]
    chosen = posts.groupBy("key").agg(*print_).groupBy("c", "x", "s").agg(F.min("key").alias("key")).select("key")
    posts = scratch.save(posts.join(chosen, "key", "left_semi"), "tiles")
    scratch.drop("posts")
    scratch.release()
    step = float(np.log(100 / percent))
    # the first of each band of n, so that a band's sizes differ by the factor percent / 100 at most
    posts = posts.withColumn("band", F.floor(F.log("n") / F.lit(step)).cast("int"))
    star = posts.groupBy("key", "band").agg(F.min(F.struct("n", "id")).alias("pivot"), F.count("*").alias("c")).where("c > 1")
    pairs = posts.join(star.select("key", "band", "pivot"), ["key", "band"]).select(F.col("pivot.id").alias("p"), "id").where("p <> id").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
    maps = reps.select(F.col("doc_id").alias("id"), "n", "bitmap").dropDuplicates(["id", "n"])
    pairs = scratch.save(screen(pairs, maps, percent), "pairs")
    scratch.release()
    labels, checked = components(scratch, verify(docs, pairs, scratch, "star", words, percent), "star"), pairs
    scratch.release()
    # a few tiles of each document find most of what is left to link; then all tiles that still hold unlike components
    for turn, tiles_of_each in (("few", FEW_TILES), ("all", None)):
        more = _unlinked(posts, labels, maps, scratch, turn, tiles_of_each, percent)
        more = scratch.save(more.join(checked, ["a", "b"], "left_anti").distinct(), f"more-{turn}")
        scratch.release()
        if not more.isEmpty():
            labels = joined_components(scratch, labels, verify(docs, more, scratch, turn, words, percent), turn)
            checked = checked.union(more)
        scratch.release()
    grouped = classes.join(labels, "id", "left").select(*digest, F.col("id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
    linked = marks.where("n > 0").select("doc_id", *digest).join(grouped, digest)
    alone = marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    result = scratch.save(linked.select("doc_id", "n", "component_id", "class_id").union(alone).withColumnRenamed("n", "n_shingles"), "result")
    for table in ("signatures", "classes", "tiles", "pairs", "unlike-few", "unlike-all", "more-few", "more-all"):
        scratch.drop(table)
    return result


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set and its component at similarity 0.9."""
    return join(read(spark, sf_dir, "documents"), Scratch(spark, "jaccard")).select("doc_id", "n_shingles", "component_id")
