"""Groups of records with nearly the same set of words: a join by signature trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.cluster import write_table
from readloom.llm.duplicates import fold_copies
from readloom.llm.windows import concat, distinct, mix, window_hashes, window_starts
from readloom.operators.components import connected_components

#: Bits of a bitmap for each word of a set of average size: enough that sets without a word in common share far fewer bits than alike ones.
BITS_PER_WORD = 1.9
#: Bits of the bitmap of a node, and how many words the records below one have together for each of its bits: so few that a set without a word in common with them still finds less than half of its own there.
WIDE, LOAD = 1 << 16, 0.6
#: Rows of a level compared with all of another at once.
BUNCH = 64
#: Tiles whose summaries meet in one task.
SUMMARIES = 1024
SEPARATOR = "\0"
#: A word set's elements are 44-bit hashes; the rest of 64 bits numbers the set within a batch.
_WORD = np.uint64(44)
_LOW = np.uint64((1 << 44) - 1)


class Level:
    """Nodes of one level of a tree: OR of the bitmaps below each (one row for each 64 bits, one column for each node), the range of set sizes, and the largest surplus (words of a set beyond the number of its bits).

    Two sets x and y share at most popcount(X & Y) + min(surplus(x), surplus(y)) words, and so do all sets below two
    nodes, with the OR of the bitmaps and the largest surplus.
    """

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, surplus: np.ndarray):
        self.bits, self.low, self.high, self.surplus = np.ascontiguousarray(bits), low, high, surplus

    def __len__(self) -> int:
        return len(self.low)

    def above(self, first: np.ndarray) -> Level:
        """The level of nodes that begin at ``first`` of this one's."""
        return Level(np.bitwise_or.reduceat(self.bits, first, axis=1), np.minimum.reduceat(self.low, first), np.maximum.reduceat(self.high, first), np.maximum.reduceat(self.surplus, first))


def _overlaps(x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
    """popcount(X & Y) of every column of x with every column of y."""
    shape = x.shape[1], y.shape[1]
    both, count, part, total = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.zeros(shape, np.uint8), np.zeros(shape, kind)
    for w in range(len(x)):
        np.bitwise_and(x[w][:, None], y[w][None, :], out=both)
        np.bitwise_count(both, out=count)
        np.add(part, count, out=part)
        if w % 3 == 2 or w == len(x) - 1:  # three words count 192 at most
            np.add(total, part, out=total)
            part[:] = 0
    return total


def meeting(x: Level, y: Level, least: float, i: np.ndarray, j: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the nodes i of x and j of y (null: all) may have sets of a Jaccard similarity of ``least`` below them.

    Alike sets of sizes p and q share at least least / (1 + least) * (p + q) words, and their sizes differ by a factor of
    at most 1 / least.
    """
    c = least / (1 + least)
    yb = y.bits if j is None else y.bits[:, j]
    low, high, surplus = (v if j is None else v[j] for v in (y.low, y.high, y.surplus))
    big = max(64 * len(x.bits), c * x.low.max(initial=0), c * low.max(initial=0), x.surplus.max(initial=0))
    kind = np.int16 if big < 16_000 else np.int64
    overlap = _overlaps(x.bits[:, i], yb, kind)
    # a bound that is a sum of two numbers first; the exact one for the few that pass it
    floor = (np.floor(c * x.low[i]) - x.surplus[i] - 1).astype(kind)[:, None] + np.floor(c * low).astype(kind)[None, :]
    a, b = np.divmod(np.flatnonzero(overlap >= floor), max(len(low), 1))
    k = i[a]
    keep = overlap[a, b] + np.minimum(x.surplus[k], surplus[b]) >= c * (x.low[k] + low[b]) - 0.01
    keep &= (x.high[k] >= least * low[b] - 1e-9) & (high[b] >= least * x.low[k] - 1e-9)
    b = b[keep]
    return k[keep], b if j is None else j[b]


class Tree:
    """The word sets of one block. Leaves are records, nodes are runs of neighbouring ones with about LOAD * WIDE words (some hundred sequences, or one long text), and the root is all.

    A leaf has a small bitmap; a node has the OR of the bitmaps of its records, with WIDE bits, and the range of their sizes.
    """

    def __init__(self, ids: np.ndarray, size: np.ndarray, bits: np.ndarray, texts: list[str], width: int):
        self.ids, self.texts, self.width, self.size = ids, texts, width, size
        self.leaf = Level(bits.T, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))
        self.root = self.leaf.above(np.zeros(1, np.int64))
        codes, ends = concat(texts)
        starts, owner = window_starts(ends, width)
        self.word = (mix(window_hashes(codes, width)[starts] >> np.uint64(20)) & np.uint64(WIDE - 1)).astype(np.intp)
        self.first = np.searchsorted(owner, np.arange(len(ids)))  # every text has a word
        run = (self.first // (LOAD * WIDE)).astype(np.int64)
        self.start = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(ids))
        self.low, self.high = np.minimum.reduceat(size, self.start[:-1]), np.maximum.reduceat(size, self.start[:-1])
        self.wide = np.zeros((len(self.start) - 1, WIDE), np.uint8)
        self.wide[np.repeat(np.arange(len(self.wide)), np.diff(self.start))[owner], self.word] = 1
        self._sets: dict[int, np.ndarray] = {}

    def set_of(self, i: int) -> np.ndarray:
        """The words of record i; only those of candidates are ever looked at."""
        if i not in self._sets:
            codes, ends = concat([self.texts[i]])
            self._sets[i] = distinct(window_hashes(codes, self.width) >> np.uint64(20))
        return self._sets[i]


def candidates(x: Tree, y: Tree, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that bitmaps and sizes can't rule out, in bunches: both trees are traversed at once, root against root, the nodes of y against the leaves of x, and leaves against leaves only where a node may hold something alike.

    No set below a node shares more words with a leaf than the leaf has words whose bit is set in the node's bitmap.
    """
    c = least / (1 + least)
    if not len(meeting(x.root, y.root, least, np.zeros(1, np.int64), None)[0]):
        return
    for j, wide in enumerate(y.wide):
        shared = np.add.reduceat(wide[x.word], x.first, dtype=np.int32)
        keep = (shared >= c * (x.size + y.low[j]) - 0.01) & (x.size >= least * y.low[j] - 1e-9) & (y.high[j] >= least * x.size - 1e-9)
        below = np.arange(y.start[j], y.start[j + 1])
        i = np.flatnonzero(keep[: below[-1]] if same else keep)
        for at in range(0, len(i), BUNCH):
            left, right = meeting(x.leaf, y.leaf, least, i[at : at + BUNCH], below)
            if same:
                keep_ = left < right
                left, right = left[keep_], right[keep_]
            yield left, right


class Forest:
    """Union-find over the records of two blocks."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        """Roots of many; their paths are cut short."""
        r = self.up[i]
        while True:
            higher = self.up[r]
            if (higher == r).all():
                self.up[i] = r
                return r
            r = higher

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


def links(x: Tree, y: Tree, least: float, same: bool) -> Iterator[tuple[int, int]]:
    """Links that connect all records of two blocks that are connected by alike pairs between them: a spanning forest, not all pairs.

    A pair already connected needs no test. Of the others, at first one and then ever more pairs between the same two
    parts are tested, so a large group of lookalikes costs about as many tests as it has members.
    """
    offset = 0 if same else len(x.ids)
    forest = Forest(len(x.ids) + (0 if same else len(y.ids)))
    for i, j in candidates(x, y, least, same):
        take = 1
        while len(i):
            ri, rj = forest.roots(i), forest.roots(j + offset)
            open_ = ri != rj
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            if not len(i):
                break
            code = np.minimum(ri, rj) * len(forest.up) + np.maximum(ri, rj)
            order = np.argsort(code, kind="stable")
            code = code[order]
            rank = np.arange(len(code)) - np.searchsorted(code, code)
            test = order[rank < take]
            for k in test:
                a, b = forest.root(i[k]), forest.root(j[k] + offset)
                if a == b:
                    continue
                p, q = x.set_of(i[k]), y.set_of(j[k])
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if shared >= least * (len(p) + len(q) - shared) - 1e-9 and shared:
                    forest.join(a, b)
                    yield int(x.ids[i[k]]), int(y.ids[j[k]])
            rest = np.ones(len(i), bool)
            rest[test] = False
            i, j, take = i[rest], j[rest], take * 4


def _sketch(width: int, n_bits: int):
    """(id, text, size, m1, m2, bits): the number of different words, two minima of hashed words, by which lookalikes become neighbours, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                n = b.num_rows
                codes, ends = concat(b.column(1).to_pylist())
                starts, owner = window_starts(ends, width)
                words = window_hashes(codes, width)[starts] >> np.uint64(20)
                both = distinct((owner.astype(np.uint64) << _WORD) | words)
                of, words = (both >> _WORD).astype(np.int64), both & _LOW
                first = np.searchsorted(of, np.arange(n))  # every text has a word
                h = mix(words)
                bit = (h >> np.uint64(1)) % np.uint64(n_bits)
                bits = np.zeros((n, n_bits), bool)
                bits[of, bit.astype(np.int64)] = True
                packed = np.packbits(bits, axis=1)
                minima = [pa.array(np.minimum.reduceat(mix(words + np.uint64(seed)), first).view(np.int64)) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.bincount(of, minlength=n)), *minima, pa.array([row.tobytes() for row in packed], pa.binary())], ["id", "text", "size", "m1", "m2", "bits"])

    return run


def _zip(values: np.ndarray | str) -> bytes:
    return zlib.compress(values.encode() if isinstance(values, str) else np.ascontiguousarray(values).tobytes(), 1)


def _pack(block: int, per_tile: int):
    """Blocks of at most ``block`` records that follow one another, at most ``per_tile`` of them to a tile, each with the size range, the largest surplus and the OR of the bitmaps: (tile, low, high, surplus, bits, ids, sizes, leaves, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            size = t.column("size").to_numpy()
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(size), -1)
            surplus = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
            texts = SEPARATOR.join(t.column("text").to_pylist())
            return pa.RecordBatch.from_pylist(
                [{"tile": (part << 24) + number // per_tile, "low": int(size.min()), "high": int(size.max()), "surplus": int(surplus.max()), "bits": np.bitwise_or.reduce(bits).tobytes(), "ids": _zip(t.column("id").to_numpy()), "sizes": _zip(size), "leaves": bits.tobytes(), "texts": _zip(texts)}],
                schema=pa.schema([("tile", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("surplus", pa.int64()), *((c, pa.binary()) for c in ("bits", "ids", "sizes", "leaves", "texts"))]),
            )

        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, block - n)
                held.append(piece)
                n += piece.num_rows
                at += piece.num_rows
                if n == block:
                    yield out()
                    held, n, number = [], 0, number + 1
        if n:
            yield out()

    return run


def _level(table: pa.Table) -> Level:
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    return Level(bits.T, *(table.column(c).to_numpy() for c in ("low", "high", "surplus")))


def tile_pairs(summaries: DataFrame, least: float, n: int) -> DataFrame:
    """(lo, hi): tiles of which at least one pair of blocks may have alike records. summaries: one row for each block (tile, low, high, surplus, bits).

    The upper levels of the trees: summaries are put in groups of about SUMMARIES blocks, and each pair of groups is a
    task that traverses tiles against tiles, then blocks against blocks. Only pairs of numbers come out.
    """
    groups = max(1, -(-n // SUMMARIES))
    g = F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")
    sent = summaries.withColumn("g", g).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.least("g", "j").alias("a"), F.greatest("g", "j").alias("b"), "g", "tile", "low", "high", "surplus", "bits")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("tile")
        g = t.column("g").to_numpy()
        sides = []
        for side in (g.min(), g.max()):
            mine = t.filter(pa.array(g == side))
            blocks, tile = _level(mine), mine.column("tile").to_numpy()
            first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            sides.append((blocks, blocks.above(first), tile[first], np.append(first, len(tile))))
        (bx, tx, nx, fx), (by, ty, ny, fy) = sides
        lo, hi = [], []
        for at in range(0, len(tx), BUNCH):
            for i, j in zip(*meeting(tx, ty, least, np.arange(at, min(at + BUNCH, len(tx))), None), strict=True):
                if len(meeting(bx, by, least, np.arange(fx[i], fx[i + 1]), np.arange(fy[j], fy[j + 1]))[0]):
                    lo.append(min(nx[i], ny[j]))
                    hi.append(max(nx[i], ny[j]))
        return pa.table({"lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    return sent.groupBy("a", "b").applyInArrow(meet, "lo long, hi long").distinct()


def similar_groups(df: DataFrame, id_col: str, text: Column, least: float, width: int, block: int = 4096, most_blocks: int = 8) -> DataFrame:
    """(id, group_id) of every row that is connected, through rows whose sets of ``width``-letter words have a Jaccard similarity of ``least`` or more, with a row of different text. group_id is the smallest id of the group.

    Exact copies of a text are folded first (``fold_copies``) and expanded at the end; the join sees each text once.
    Signature trees: texts are put in order of a band of their set's size and of two minima of their hashed words, so that
    lookalikes become neighbours, and cut into blocks of at most ``block``; each block is a tree of bitmaps and size
    ranges, and up to ``most_blocks`` of them are a tile (fewer where the tiles would be too few for all tasks). The trees
    are traversed in pairs from the top: pairs of tiles and of blocks by their summaries alone (``tile_pairs``), and only
    what they leave is sent to meet; there nodes and leaves follow, by the largest overlap that the bitmaps allow and by
    size ranges. What is left is checked exactly, and a spanning forest of the links comes out. No link between
    different texts is lost: what is left out is implied.

    Where few records look alike and sizes are alike, summaries rule out nothing; then the comparisons, of leaves with
    nodes of some hundred records, grow with the square of the number of different texts, and each text is sent to as
    many meetings as there are tiles.

    Texts shorter than ``width`` and nulls have no words and are in no group. Texts without a partner give no row, and
    neither do groups of copies of one text. Ties don't exist; an empty table gives no rows.
    """
    copies = fold_copies(df, id_col, text, text=True)
    spark = df.sparkSession
    texts = copies.groups.where(F.length("text") >= width).select(F.col("first_id").alias("id"), F.regexp_replace("text", "\\x00", " ").alias("text"))  # the sign that parts texts in a block
    n, mean = texts.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.length("text")), F.lit(width))).first()
    n_bits = 64 * int(max(2, -(-BITS_PER_WORD * (mean - width + 1) // 64)))
    cores = spark.sparkContext.defaultParallelism
    # tiles by which there are a few pairs for each core, and of about most_blocks blocks at most
    rows = int(min(block * most_blocks, max(1024, -(-n // max(1, round((6 * cores) ** 0.5))))))
    block = -(-rows // -(-rows // block))
    sketched = write_table(texts.mapInArrow(_sketch(width, n_bits), "id long, text string, size long, m1 long, m2 long, bits binary"), "sketched")
    band = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(least)))
    order = [band.alias("band"), "m1", "m2", "id"]
    ranged = sketched.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order).select("id", "text", "size", "bits")
    blocks = write_table(ranged.mapInArrow(_pack(block, 2 * -(-rows // block)), "tile long, low long, high long, surplus long, bits binary, ids binary, sizes binary, leaves binary, texts binary"), "blocks")
    summaries = blocks.select("tile", "low", "high", "surplus", "bits")
    pairs = write_table(tile_pairs(summaries, least, blocks.count()), "tile-pairs")
    n_pairs = pairs.count()
    both = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("tile"))
    sent = both.join(blocks.select("tile", "ids", "sizes", "leaves", "texts"), "tile")

    def meet(table: pa.Table) -> pa.Table:
        trees: dict[int, list[Tree]] = {}
        for tile, ids, sizes, leaves, texts in zip(*(table.column(c).to_pylist() for c in ("tile", "ids", "sizes", "leaves", "texts")), strict=True):
            ids = np.frombuffer(zlib.decompress(ids), np.int64)
            tree = Tree(ids, np.frombuffer(zlib.decompress(sizes), np.int64), np.frombuffer(leaves, np.uint64).reshape(len(ids), -1), zlib.decompress(texts).decode().split(SEPARATOR), width)
            trees.setdefault(tile, []).append(tree)
        lo, hi = trees[min(trees)], trees[max(trees)]
        one = len(trees) == 1
        found = [link for i, x in enumerate(lo) for j, y in enumerate(hi) if not one or i <= j for link in links(x, y, least, one and i == j)]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # about one meeting for a partition, as hashing puts some together; beyond 20,000 partitions each has several
    edges = write_table(sent.repartition(int(min(max(1, 4 * n_pairs), 20_000)), "lo", "hi").groupBy("lo", "hi").applyInArrow(meet, "a long, b long"), "similar")
    groups = connected_components(edges, "a", "b")
    return copies.expand(copies.groups.drop("text").join(groups.withColumnRenamed("node", "first_id"), "first_id").select("k1", "k2", "n", F.col("root").alias("group_id")))
