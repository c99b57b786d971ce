"""Exact Jaccard self-join of documents on word shingles with an R-tree over group counts.

A document is the set of its distinct shingles; equal sets are one node (a group of copies costs one
node, however large). Shingles are hashed into groups; the counts per group are the set's point, and
the summed minima of two points bound the overlap of their sets from above.

One tree over a corpus would have to visit nearly every node: in so many dimensions the corners of
unrelated points all reach one another. So the upper levels of the index deal the sets into cells. All
shingles have one order, those that no other text has first, then the rarest groups; a set of n lies in the cells of its first n - ceil(t n)
+ 1 shingles, and two sets of Jaccard t or more share a cell. A passage that many documents share is
frequent, so it comes last and makes no cells but for texts that hold little else. Of cells with the same
members only one is kept. How many sets hold each of ``GROUPS`` groups is counted over all texts; the
order needs no more than their logarithms (one byte each); whether a shingle is a text's own is known by ``FINE`` groups (one bit
each). So what is broadcast has a fixed size, 32 MB. Beyond some 10^8 shingles the fine groups fill up, and only counts order what they hold.

So most sets are settled before: of n shingles, a link needs ceil(t n) that the other set has too, so a set with n - ceil(t n) + 1 of its
own has no link. A part of all shingles, cut out by their hashes, is dealt by hash, and which of them one text alone has is found exactly,
however large the corpus (``unsettled``). Only the other sets, mostly near copies, are counted, ordered and dealt into cells.

Within a cell an R-tree is packed by the widest coordinates, and a pair of nodes is left when the summed
minima of their upper corners can't reach the overlap that their smallest sizes need. Surviving pairs
pass the bound of their own points, and then the exact test on their sets.

Work follows connectivity: each member is first tested against the first member of the cells with whose
first members it shares most cells; then, for a few rounds, each component against the other
components' first members in its cells. After that, only pairs of different components meet in the
trees, each pair in the first cell that it shares, so a group of near copies doesn't make all its pairs.
The rounds only save work: whatever they leave apart is compared in the end, and no link between
components is lost. Cells above ``split`` members or ``SET_BYTES`` are dealt into chunks, and each pair
of chunks is searched apart.

``n_links`` counts all links of a set, tested or not on the way to the components: every link lies in a
component, so the sets of each component of more than two are compared all with all, in pairs of such
chunks. Only counts leave these tasks, no pairs.

Defined results: texts without words have no set and link with nothing; fewer words than ``size`` are
one shingle. A null doc_id takes part but is never a component's id unless all are null. Repeated rows
are equal sets. Component ids of rows with repeated doc_ids follow their texts. An empty table gives no
rows. Other columns are ignored or carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashedWords, Scratch, distinct, docs_of, windows
from .components import components, labels

GROUPS, BLOCK = 1 << 24, 1 << 16  # groups that are counted, in blocks
FINE = 1 << 27  # finer groups, of which it is known whether one text or more hold them: a bit each
LEAF, SET_BYTES = 32, 8 << 20


COUNTED = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def fine(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit in it) of the fine groups of shingles."""
    g = (s >> np.uint64(30)).astype(np.int64) % FINE
    return g >> 3, np.left_shift(1, g & 7).astype(np.uint8)


def order(docs: DataFrame, size: int) -> bytes:
    """One byte per group: the higher, the more texts hold a shingle of it; then a bit per fine group: whether several texts do.

    A task counts in one byte a group, up to 255, and marks fine groups as seen once and again; it sends the blocks that it has touched, compressed.
    """
    words = HashedWords()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, once, again = np.zeros(GROUPS, np.uint8), np.zeros(FINE >> 3, np.uint8), np.zeros(FINE >> 3, np.uint8)
        for batch in batches:
            for h in words(batch.column("text")):
                s = distinct(windows(h, size))
                g = (s % np.uint64(GROUPS)).astype(np.int64)
                c = held[g]
                held[g] = c + (c < 255)  # shingles of one group count once a text
                at, bit = fine(s)
                np.bitwise_or.at(again, at, once[at] & bit)
                np.bitwise_or.at(once, at, bit)
        blocks = held.reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": [zlib.compress(blocks[i].tobytes(), 1)]})
        once, again = once.reshape(-1, BLOCK), again.reshape(-1, BLOCK)
        for i in np.flatnonzero(once.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([len(blocks) + i], pa.int32()), "counts": [zlib.compress(once[i].tobytes() + again[i].tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(x), np.uint8)
                if i < GROUPS // BLOCK:
                    held.setdefault(i, np.zeros(BLOCK, np.uint32))[:] += x
                else:
                    own = held.setdefault(i, np.zeros(2 * BLOCK, np.uint8))
                    own[BLOCK:] |= x[BLOCK:] | own[:BLOCK] & x[:BLOCK]
                    own[:BLOCK] |= x[:BLOCK]
        for i, own in held.items():
            told = (2 * np.log2(1.0 + own)).astype(np.uint8) if i < GROUPS // BLOCK else own[BLOCK:]
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": [zlib.compress(told.tobytes(), 1)]})

    out = np.zeros(((GROUPS + (FINE >> 3)) // BLOCK, BLOCK), np.uint8)
    for row in docs.select("text").mapInArrow(count, COUNTED).repartition("block").mapInArrow(add, COUNTED).toArrow().to_pylist():  # at most 512 rows
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.tobytes()


#: Shingles that a shard is made for.
SHARD = 1 << 22
DEALT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("held", T.BinaryType()), T.StructField("at", T.BinaryType())])
SUMS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("texts", T.BinaryType()), T.StructField("own", T.BinaryType())])
_PRINT = np.dtype([("print", np.uint64), ("need", np.uint32)])


def unsettled(docs: DataFrame, size: int, percent: int) -> bytes:
    """``marks`` of the prints ``_f1`` of texts that may link: all but those with so many shingles of their own that they can't.

    Twice the part of shingles that must be a text's own is looked at, and some more. A shingle goes as 4 bytes (others of its shard that share them
    make it look shared, which settles less) and its text as a place in its batch; shards are as many as the texts ask for.
    """
    part = min(1.0, 2 * (1 - percent / 100) + 0.05)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(total * part / 6) // SHARD + 1  # some six bytes a word
    words = HashedWords()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1 << 15) for b in batches for i in range(0, b.num_rows, 1 << 15)):
            texts = np.zeros(batch.num_rows, _PRINT)
            texts["print"] = batch.column("_f1").to_numpy().view(np.uint64)
            # A task that runs again names its batches as before. Batches of one name have the same texts, so no shingles of their own.
            name = int.from_bytes(hashlib.blake2b(texts["print"].tobytes(), digest_size=8).digest()) >> 1
            held, at = [], []
            for i, h in enumerate(words(batch.column("text"))):
                s = distinct(windows(h, size))
                if len(s):
                    texts["need"][i] = len(s) - -(-percent * len(s) // 100) + 1
                    held.append(s[: np.searchsorted(s, np.uint64(min(int(part * 2**64), 2**64 - 1)))])
                    at.append(np.full(len(held[-1]), i, np.uint16))
            rows = [(name % shards, texts.tobytes(), None)]
            if held:
                s, at = np.concatenate(held), np.concatenate(at)
                s = s * np.uint64(0x9E3779B97F4A7C15)  # they all have small first bits
                shard = (s >> np.uint64(32)) % np.uint64(shards)
                order_ = np.argsort(shard, kind="stable")
                s, at, cuts = s[order_].astype(np.uint32), at[order_], np.searchsorted(shard[order_], np.arange(shards + 1))
                rows += [(i, s[lo:hi].tobytes(), at[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo]
            for i in range(0, len(rows), 256):
                shard, s, at = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([name] * len(s)), pa.array(s, pa.binary()), pa.array(at, pa.binary())], DEALT.names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 1):
            dealt = list(zip(*(rows.column(c).to_pylist() for c in ("batch", "held", "at")), strict=True))
            out = [(name, texts, None) for name, texts, at in dealt if at is None]
            s = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x, np.uint32) for _, x, at in dealt if at is not None)])
            place = np.argsort(s, kind="stable")
            s = s[place]
            differs = np.concatenate([[True], s[1:] != s[:-1], [True]]) if len(s) else np.empty(1, bool)
            alone = np.empty(len(s), bool)
            alone[place] = differs[1:] & differs[:-1]
            lo = 0
            for name, _, at in dealt:
                if at is not None:
                    at = np.frombuffer(at, np.uint16)
                    own = np.bincount(at[alone[lo : lo + len(at)]]).astype(np.uint32)
                    out.append((name, None, zlib.compress(own.tobytes(), 1)))
                    lo += len(at)
            for i in range(0, len(out), 256):
                name, texts, own = zip(*out[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(texts, pa.binary()), pa.array(own, pa.binary())], SUMS.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 1):
            texts, own = None, None
            for x, y in zip(rows.column("texts").to_pylist(), rows.column("own").to_pylist(), strict=True):
                if x is not None:
                    texts = np.frombuffer(x, _PRINT)
                    own = np.zeros(len(texts), np.int64)
                else:
                    y = np.frombuffer(zlib.decompress(y), np.uint32)
                    own[: len(y)] += y
            left = texts["print"][(texts["need"] > 0) & (own < texts["need"])]
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64))], ["print"])

    shared = docs.select("_f1", "text").mapInArrow(deal, DEALT).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(settle, SUMS)
    return marks(shared.repartition("batch").sortWithinPartitions("batch", F.col("texts").desc_nulls_last()).mapInArrow(add, "print long"))


def _bit(prints: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit in it) of prints among ``FINE``."""
    g = prints.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FINE)
    return (g >> np.uint64(3)).astype(np.int64), np.left_shift(1, (g & np.uint64(7)).astype(np.int64)).astype(np.uint8)


def marks(prints: DataFrame) -> bytes:
    """A bit for each of ``FINE`` groups of prints (one column of long): whether it has any of them."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _bit(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK * 256 + bit).astype(np.int32))], ["block", "at"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
            for i in np.unique(blocks).tolist():
                x = at[blocks == i]
                np.bitwise_or.at(held.setdefault(i, np.zeros(BLOCK, np.uint8)), x // 256, (x % 256).astype(np.uint8))
        for i, own in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": [zlib.compress(own.tobytes(), 1)]})

    out = np.zeros((-(-(FINE >> 3) // BLOCK), BLOCK), np.uint8)
    for row in prints.mapInArrow(block, "block int, at int").repartition("block").mapInArrow(gather, COUNTED).toArrow().to_pylist():  # at most 256 rows
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.tobytes()


def marked(prints: pa.Array, bits: bytes) -> np.ndarray:
    """Which prints are of a group that ``bits`` marks."""
    at, bit = _bit(prints)
    return np.frombuffer(bits, np.uint8)[at] & bit > 0


def _marked(bits: Broadcast):
    @F.arrow_udf(T.BooleanType())
    def of(prints: pa.Array) -> pa.Array:
        return pa.array(marked(prints, bits.value))

    return of


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sizes a and b link."""
    return -(-(a + b) * percent // (100 + percent))


def first_keys(s: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The cells of a set: its first shingles in the common order."""
    n = len(s)
    rank = rarity[(s % np.uint64(GROUPS)).astype(np.int64)].astype(np.uint64)
    at, bit = fine(s)
    rank[rarity[GROUPS + at] & bit == 0] = 0  # no other text has it: such shingles come first
    place = (rank << np.uint64(57)) | (s >> np.uint64(7))
    # Shingles of one place come together, so the order is the same for every set.
    return s[place <= np.partition(place, n - -(-percent * n // 100))[n - -(-percent * n // 100)]]


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Counts in groups, some four times as many as the largest set has shingles (128 to 8192)."""
    groups = min(8192, max(128, 1 << (4 * max(map(len, sets)) - 1).bit_length()))
    out = np.empty((len(sets), groups), np.uint16 if groups * 8 > max(map(len, sets)) else np.uint32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(33)).astype(np.int64) % groups, minlength=groups)
    return out


SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("h", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def _signature(size: int, percent: int, rarity: Broadcast, left: Broadcast):
    words = HashedWords()

    @F.arrow_udf(SIGNATURE)
    def signature(text: pa.Array, prints: pa.Array) -> pa.Array:
        own, rows = np.frombuffer(rarity.value, np.uint8), []
        for h, open_ in zip(words(text), marked(prints, left.value).tolist(), strict=True):
            s = distinct(windows(h, size))
            if len(s) and not open_:  # it links with none, so it makes no cells
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), None))
            elif len(s):
                keys = first_keys(s, own, percent)
                at, bit = fine(keys)
                keys = keys[own[GROUPS + at] & bit > 0]  # a shingle of one text makes a cell of one
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys.view(np.int64)))
            else:
                rows.append((0, None, None))
        n, prints, k = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(k, pa.list_(pa.int64()))], SIGNATURE.names)

    return signature


def _sets(size: int):
    words = HashedWords()

    @F.arrow_udf(T.BinaryType())
    def sets(text: pa.Array) -> pa.Array:
        return pa.array([distinct(windows(h, size)).tobytes() for h in words(text)], pa.binary())

    return sets


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


#: Rows of a few numbers that are broadcast.
FEW = 500_000


def _few(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be joined: broadcast up to ``FEW`` rows, shuffled beyond."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test of two sets, both sorted."""
    least = int(needed(len(a), len(b), percent))
    if min(len(a), len(b)) < least:
        return False
    s = np.concatenate([a, b])
    s.sort(kind="stable")
    return int((s[1:] == s[:-1]).sum()) >= least


def _array(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, split: int, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b), those that link. The sets of all a of one b go where b's set is, ``split`` at a time."""
    pairs = scratch.gathered(pairs, f"{name}_pairs")
    chunks = pairs.groupBy("b").agg(F.ceil(F.count("*") / split).alias("chunks"))
    placed = _few(scratch.gathered(pairs.join(chunks, "b").select("a", "b", "chunks", F.pmod(F.xxhash64("a"), "chunks").alias("c")), f"{name}_placed"))
    members = sets.join(placed, sets["rid"] == placed["a"]).select("b", "c", "a", "s")
    centers = sets.join(placed.select("b", "chunks").distinct(), sets["rid"] == F.col("b")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.lit(None).cast("long").alias("a"), "s")
    both = members.union(centers).repartition("b", "c").sortWithinPartitions("b", "c", F.col("a").asc_nulls_first())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, None
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for i, (b, a, s) in enumerate(zip(x.column("b").to_pylist(), x.column("a").to_pylist(), x.column("s"), strict=True)):
                if a is None:
                    center, own = b, _array(s.as_py())
                else:
                    assert center == b
                    keep[i] = linked(own, _array(s.as_py()), percent)
            yield x.select(["a", "b"]).filter(pa.array(keep))

    return scratch.gathered(both.mapInArrow(test, PAIR).distinct(), f"{name}_links")


def beyond(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n don't make cells."""
    return -(-percent * n // 100) - 1


def unmet(keys: list[np.ndarray], key: int, n: np.ndarray, root: np.ndarray, side: np.ndarray, percent: int, both: bool) -> np.ndarray:
    """Which pairs of a cell's members are to be searched in it.

    They are of different components (and sides, if ``both``), share no smaller key, and share so many
    keys that with all other shingles of the one whose keys end later the overlap could be reached.
    """
    rows, out = len(keys), np.zeros((len(keys), len(keys)), bool)
    flat, at = np.concatenate(keys), np.repeat(np.arange(rows), [len(k) for k in keys])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    smaller = int((values[shared] < key).sum())  # their columns come first
    at, column = at[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    met, both_have, columns = np.zeros((rows, rows), bool), np.zeros((rows, rows), np.float32), int(shared.sum())
    for i in range(0, columns, 1024):
        own = (column >= i) & (column < i + 1024)
        held = np.zeros((rows, min(1024, columns - i)), np.float32)
        held[at[own], column[own] - i] = 1
        if i < smaller:
            first = held[:, : smaller - i]
            met |= first @ first.T > 0.5
        both_have += held @ held.T
    rest = beyond(n, percent)
    for i in range(0, rows, 128):
        x = slice(i, i + 128)
        out[x] = (root[x, None] != root[None, :]) & ~met[x] & (both_have[x] + np.maximum(rest[x, None], rest[None, :]) >= needed(n[x, None], n[None, :], percent))
        if both:
            out[x] &= side[x, None] != side[None, :]
    return out


def tree_pairs(allowed: np.ndarray, side: np.ndarray, n: np.ndarray, p: np.ndarray, percent: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``allowed`` pairs (places) of one cell whose points allow a link; of different sides if ``both``."""

    def pack(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= LEAF:
            return [rows]
        own = p[rows]
        widest = int((own.max(axis=0).astype(np.int64) - own.min(axis=0)).argmax())
        order = rows[np.lexsort((n[rows], own[:, widest]))]
        return pack(order[: len(order) // 2]) + pack(order[len(order) // 2 :])

    leaves = [x for s in ((0, 1) if both else (0,)) for x in pack(np.flatnonzero(side == s)) if len(x)]
    high = np.stack([p[x].max(axis=0) for x in leaves])
    least, sides = np.array([n[x].min() for x in leaves]), np.array([side[x[0]] for x in leaves])
    fan = 16  # upper nodes: corners of runs of leaves, which are neighbours in the packing
    tops = [np.arange(i, min(i + fan, len(leaves))) for i in range(0, len(leaves), fan)]
    top_high, top_least = np.stack([high[t].max(axis=0) for t in tops]), np.array([least[t].min() for t in tops])
    for i, x in enumerate(leaves):
        near = np.flatnonzero(np.minimum(high[i], top_high).sum(axis=1, dtype=np.int64) >= needed(least[i], top_least, percent))
        if not len(near):
            continue
        j = np.concatenate([tops[k] for k in near])
        j = j[(j >= i) & ((sides[j] != sides[i]) if both else True)]
        j = j[np.minimum(high[i], high[j]).sum(axis=1, dtype=np.int64) >= needed(least[i], least[j], percent)]
        for k in j.tolist():
            y = leaves[k]
            ok = allowed[np.ix_(x, y)]
            r, c = np.nonzero(np.triu(ok, 1) if k == i else ok)
            r, c = x[r], y[c]
            if len(r):
                ok = np.minimum(p[r], p[c]).sum(axis=1, dtype=np.int64) >= needed(n[r], n[c], percent)
                if ok.any():
                    yield r[ok], c[ok]


def _open(members: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, rid, root, k, shingles, center, center_root) of cells that hold more than one component."""
    held = members.select("key", "rid", "n", "weight").join(_few(roots.withColumnRenamed("id", "rid")), "rid", "left").select("key", "rid", "n", "weight", F.coalesce("root", "rid").alias("root"))
    mixed = held.groupBy("key").agg(F.min(F.struct("root", "rid")).alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("shingles")).where("lo.root <> hi")
    return scratch.gathered(held.join(mixed.select("key", "k", "shingles", F.col("lo.rid").alias("center"), F.col("lo.root").alias("center_root")), "key"), name)


def _possible(votes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of votes (a, b, c), those whose c shared keys allow a link: see ``unmet``."""
    of = lambda x: _few(rows.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}")))
    rest = lambda x: F.expr(f"({percent} * n{x} + 99) div 100 - 1")
    return votes.join(of("a"), "a").join(of("b"), "b").where((F.col("c") + F.greatest(rest("a"), rest("b"))) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def _between(open_: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) per component: the member and the first member of another component that share most keys."""
    votes = open_.where("root <> center_root").groupBy(F.col("rid").alias("a"), F.col("center").alias("b"), "root").agg(F.sum("weight").alias("c"))
    return _possible(votes, rows, percent).groupBy("root").agg(F.max(F.struct("c", (-F.col("b")).alias("m"), "a")).alias("x")).select("x.a", (-F.col("x.m")).alias("b"))


def _chunks(k: str, shingles_: str, split: int):
    """How many chunks a group of k sets with so many shingles is dealt into."""
    return F.ceil(F.greatest(F.col(k) / split, F.col(shingles_) * 8 / SET_BYTES))


MEMBER = T.StructType([*(T.StructField(c, T.LongType()) for c in ("key", "c1", "c2", "side", "rid", "root"))])


def _residual(open_: DataFrame, keys: DataFrame, sets: DataFrame, rarity: Broadcast, percent: int, split: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of different components that meet in a cell, as many as join what links there.

    First the cells are looked at with the members' keys alone: what has met all others of the cell in
    smaller keys already needn't bring its set.
    """
    # In a cell of several chunks a member goes to each pair of chunks that has its own.
    own = open_.select("key", "rid", "root", _chunks("k", "shingles", split).alias("chunks")).withColumn("mine", F.pmod(F.xxhash64("rid"), "chunks"))
    own = _few(own).join(keys, "rid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    own = own.select("key", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), (F.col("mine") > F.col("other")).cast("long").alias("side"), "rid", "root", "n", "keys")
    own = own.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, c1, c2), cell in _runs(batches, 3):
            root, side, n = (cell.column(c).to_numpy() for c in ("root", "side", "n"))
            flat, ends = cell.column("keys").chunk(0).flatten().to_numpy(), np.concatenate([[0], np.cumsum(cell.column("keys").chunk(0).value_lengths().to_numpy())])
            some = unmet([flat[ends[i] : ends[i + 1]] for i in range(len(root))], key, n, root, side, percent, c1 != c2).any(axis=1)
            if some.any():
                yield from cell.select(MEMBER.names).filter(pa.array(some)).to_batches()

    left = scratch.gathered(own.mapInArrow(look, MEMBER), "to_search")
    left = _few(left).join(sets, "rid").select(*MEMBER.names, "s").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(rarity.value, np.uint8)
        for (key, c1, c2), cell in _runs(batches, 3):
            ids, root, side = (cell.column(c).to_numpy() for c in ("rid", "root", "side"))
            s = [_array(x) for x in cell.column("s").to_pylist()]
            n = np.array([len(x) for x in s])
            allowed = unmet([first_keys(x, rare, percent).view(np.int64) for x in s], key, n, root, side, percent, c1 != c2)
            parent: dict[int, int] = {}
            out = []

            def find(x: int, parent=parent) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for a, b in tree_pairs(allowed, side, n, points(s), percent, c1 != c2):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = find(int(root[i])), find(int(root[j]))
                    if x != y and linked(s[i], s[j], percent):
                        parent[max(x, y)] = min(x, y)
                        out.append((int(ids[i]), int(ids[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in out]), pa.array([min(x) for x in out])], ["a", "b"])

    return left.mapInArrow(search, PAIR).distinct()


def common(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``rows`` has in common with each of ``others``; all are sets."""
    flat = np.concatenate([*rows, *others])
    at = np.repeat(np.arange(len(rows) + len(others)), [len(x) for x in (*rows, *others)])
    order = np.argsort(flat, kind="stable")
    flat, at = flat[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    k = np.diff(np.append(first, len(flat)))  # holders of each element, those in rows first
    left = np.add.reduceat((at < len(rows)).astype(np.int64), first)
    out = np.zeros((len(rows), len(others)), np.int64)
    heavy = left * (k - left) * 256 > len(rows) * len(others)
    columns = np.flatnonzero(heavy)
    for c in (columns[i : i + 1024] for i in range(0, len(columns), 1024)):  # frequent elements as a product of matrices
        has = np.zeros((len(rows) + len(others), len(c)), np.float32)
        places = np.repeat(first[c] - np.concatenate([[0], np.cumsum(k[c])[:-1]]), k[c]) + np.arange(k[c].sum())
        has[at[places], np.repeat(np.arange(len(c)), k[c])] = 1
        out += (has[: len(rows)] @ has[len(rows) :].T).astype(np.int64)
    columns = np.flatnonzero(~heavy & (left > 0) & (left < k))
    made = np.cumsum(left[columns] * (k - left)[columns])
    for c in np.split(columns, np.searchsorted(made, np.arange(1 << 20, made[-1], 1 << 20))) if len(columns) else []:  # others as their pairs
        n, m = left[c], (k - left)[c]
        i = np.arange((n * m).sum()) - np.repeat(np.concatenate([[0], np.cumsum(n * m)[:-1]]), n * m)
        start, m, n = np.repeat(first[c], n * m), np.repeat(m, n * m), np.repeat(n, n * m)
        cells = at[start + i // m] * len(others) + at[start + n + i % m] - len(rows)
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    return out


DEGREE = T.StructType([T.StructField("id", T.LongType()), T.StructField("c", T.LongType())])


def degrees(roots: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int, split: int, scratch: Scratch) -> DataFrame:
    """(id, n_links) of the nodes of components: with how many sets of its component each links."""
    own = scratch.table(nodes.select(F.col("rid").alias("id"), "n").join(_few(roots), "id"), "sized")
    groups = own.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    own = scratch.gathered(own.join(groups, "root"), "grouped")
    large = own.where("k > 2").select("id", "root", _chunks("k", "shingles", split).alias("chunks")).withColumn("mine", F.pmod(F.xxhash64("id"), "chunks"))
    large = _few(scratch.table(large, "dealt")).join(sets.withColumnRenamed("rid", "id"), "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    large = large.select("root", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), (F.col("mine") > F.col("other")).alias("side"), "id", "s")
    large = large.repartition("root", "c1", "c2").sortWithinPartitions("root", "c1", "c2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _runs(batches, 3):
            ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
            s = [_array(x) for x in group.column("s").to_pylist()]
            one = key[1] == key[2]
            rows = np.arange(len(s)) if one else np.flatnonzero(~side)
            others = rows if one else np.flatnonzero(side)
            if not len(rows) or not len(others):
                continue
            n = np.array([len(x) for x in s])
            for i in range(0, len(rows), 256):
                r = rows[i : i + 256]
                both = common([s[x] for x in r], [s[x] for x in others])
                link = 100 * both >= percent * (n[r][:, None] + n[others][None, :] - both)
                if one:
                    link[np.arange(len(r)), np.arange(i, i + len(r))] = False
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[others]), pa.array(link.sum(axis=0))], DEGREE.names)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(link.sum(axis=1))], DEGREE.names)

    counted = large.mapInArrow(count, DEGREE).union(own.where("k = 2").select("id", F.lit(1).cast("long").alias("c")))
    return scratch.gathered(counted.groupBy("id").agg(F.sum("c").alias("n_links")), "degrees")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal first columns, in order, as tables; runs are bounded by the caller."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            now = tuple(c[lo] for c in cols)
            if now != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def join(documents: DataFrame, size: int = 5, percent: int = 80, split: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, n_equal (rows of the same set), n_links (other sets that its set links with) of every row."""
    with Scratch(documents.sparkSession, "jaccard") as scratch:
        out = _join(docs_of(documents), size, percent, split, scratch, counted=True)
        own = F.when(F.col("n_equal").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        n_equal = F.coalesce("n_equal", (F.col("n") > 0).cast("long"))
        return scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), n_equal.alias("n_equal"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def filter_documents(documents: DataFrame, size: int = 5, percent: int = 80, split: int = 1024) -> DataFrame:
    """``documents`` with one row of each component (the smallest doc_id; any one of rows that repeat it)."""
    with Scratch(documents.sparkSession, "jaccard") as scratch:
        out = scratch.table(_join(docs_of(documents), size, percent, split, scratch), "joined").withColumn("id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
        grouped = out.where("root is not null")
        stays = scratch.gathered(grouped.groupBy("root").agg(F.min("id").alias("first")), "stay")
        marked = grouped.join(_few(stays), "root").select("doc_id", "_f1", "_f2", (F.col("id.rid") == F.col("first.rid")).alias("stays"))
        # Rows of one doc_id and text share a verdict: what goes is what has no row that stays.
        by_text = marked.groupBy("doc_id", "_f1", "_f2").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
        by_text = scratch.keep(scratch.narrow(by_text.where("not stays or rows > 1")), "verdicts")
        gone = scratch.keep(by_text.where("not stays").select(F.col("doc_id").alias("_gone"), F.col("_f1").alias("_g1"), F.col("_f2").alias("_g2")), "gone")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_f1"), F.xxhash64(F.lit("2"), text).alias("_f2"))
    gone, stay = _few(gone), lambda x: x.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_f1") == F.col("_g1")) & (F.col("_f2") == F.col("_g2")), "left_anti")
    if gone.count() <= FEW:
        rows = stay(rows)
    else:  # rows are whole texts, so only those that may go are shuffled
        may = _marked(documents.sparkSession.sparkContext.broadcast(marks(gone.select(F.xxhash64("_gone", "_g1", "_g2").alias("print")))))(F.xxhash64("_id", "_f1", "_f2"))
        rows = rows.where(~may).union(stay(rows.where(may)))
    if by_text.where("stays").limit(1).count():  # rows that repeat both doc_id and text
        rows = rows.dropDuplicates(["_id", "_f1", "_f2"])
    return rows.select("_row.*")


def _join(docs: DataFrame, size: int, percent: int, split: int, scratch: Scratch, rounds: int = 3, counted: bool = False) -> DataFrame:
    """Every row's rid, doc_id, two prints of its text, n and h; root, component_id, n_equal and, if ``counted``, n_links if it isn't alone."""
    docs = docs.withColumns({"_f1": F.xxhash64("text"), "_f2": F.xxhash64(F.lit("2"), F.col("text"))})
    held_by = docs.sparkSession.sparkContext.broadcast
    left = held_by(unsettled(docs, size, percent))
    rarity = held_by(order(docs.where(_marked(left)("_f1")), size))
    signature = _signature(size, percent, rarity, left)
    full = scratch.table(docs.select("doc_id", "_f1", "_f2", signature("text", "_f1").alias("x")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "_f1", "_f2", "x.*"), "signatures", "uncompressed")
    # The row with the smallest doc_id stands for its set.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("f")
    nodes = scratch.gathered(full.where("h is not null").groupBy("h").agg(first, F.count("*").alias("n_equal")).select("h", "n_equal", "f.doc_id", "f.rid"), "distinct")
    left.destroy()
    rows = full.drop("keys")
    cells = full.where("keys is not null").select("rid", "n", "keys").join(_few(nodes.select("rid")), "rid").select("rid", "n", F.explode("keys").alias("key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("k"), F.min("rid").alias("center")).where("k > 1")
    members = scratch.gathered(cells.join(shared, "key"), "all_members")
    # What a set brings to the search: keys that some other set has too, exactly, however full the fine groups are.
    keys = scratch.gathered(members.groupBy("rid", "n").agg(F.collect_list("key").alias("keys")), "shared_keys", "uncompressed")
    # Of cells with the same members (two prints of 64 bits), that of the smallest key stays, with the weight of all.
    lists = members.groupBy("key", "k", "center").agg(F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), F.col("rid"))).alias("y"))
    lists = lists.groupBy("k", "center", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "weight")
    members = scratch.table(members.join(scratch.gathered(lists, "lists"), "key"), "members")
    scratch.drop("all_members")
    # The sets of what shares a cell are kept; nothing else is compared.
    asked = rows.join(_few(scratch.gathered(members.select("rid").distinct(), "candidates")), "rid").select("rid", F.col("doc_id").alias("_id"), F.col("_f1").alias("_g1"), F.col("_f2").alias("_g2"))
    asked = scratch.table(asked, "asked")
    # No other text is shuffled where the join isn't a broadcast.
    wanted = held_by(marks(asked.select(F.xxhash64("_id", "_g1", "_g2").alias("print"))))
    found = docs.where(_marked(wanted)(F.xxhash64("doc_id", "_f1", "_f2"))).join(_few(asked), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_f1") == F.col("_g1")) & (F.col("_f2") == F.col("_g2")))
    found = found.select("rid", _sets(size)("text").alias("s"))
    if rows.groupBy("doc_id", "_f1", "_f2").count().where("count > 1").limit(1).count():  # rows that repeat doc_id and text
        found = found.dropDuplicates(["rid"])
    sets = scratch.table(found, "sets", "uncompressed")
    wanted.destroy()
    # First links: each member with the center it shares most cells with (the smaller on ties).
    votes = members.where("rid <> center").groupBy(F.col("rid").alias("a"), F.col("center").alias("b")).agg(F.sum("weight").alias("c"))
    best = _possible(votes, rows, percent).groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("m"))).alias("x")).select("a", (-F.col("x.m")).alias("b"))
    links = verified(best, sets, percent, split, scratch, "first")
    roots = scratch.gathered(labels(links, scratch, "labels0"), "roots0")
    open_ = _open(members, roots, scratch, "open0")
    for i in range(1, rounds + 1):
        more = verified(_between(open_, rows, percent), sets, percent, split, scratch, f"round{i}")
        links = links.union(more)
        if more.count() * 50 <= roots.count():  # too few; the trees find what is left
            break
        roots = scratch.gathered(labels(links, scratch, f"labels{i}"), f"roots{i}")
        scratch.drop(f"open{i - 1}")
        open_ = _open(members, roots, scratch, f"open{i}")
    links = links.union(scratch.gathered(_residual(open_, keys, sets, rarity, percent, split, scratch), "rest"))
    rarity.destroy()  # 32 MB of the driver and each executor; all that read it is written
    roots = scratch.gathered(components(links, scratch, "all"), "roots")
    held = nodes.join(_few(roots.withColumnRenamed("id", "rid")), "rid", "left").where("root is not null or n_equal > 1").withColumn("root", F.coalesce("root", "rid"))
    own = ["h", "root", "component_id", "n_equal"]
    if counted:
        own.append("n_links")
        held = held.join(_few(degrees(roots, sets, rows, percent, split, scratch).withColumnRenamed("id", "rid")), "rid", "left")
    held = scratch.table(held, "held")
    smallest = scratch.gathered(held.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    found = scratch.table(held.join(_few(smallest), "root").select(*own), "found")
    return rows.join(_few(found), "h", "left")
