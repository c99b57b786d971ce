"""The prefix trie of conversations, by an LCP-aware external mergesort.

A turn is the digest of its role and text, a conversation the sequence of its turns. Equal conversations are summed
first (number, smallest conv_id, checksum of the ids), so copies are one sequence. Tasks sort what they hold into
runs. A sorted run carries the number of turns (LCP) that each sequence shares with the one before, and only the turns beyond
those are shuffled. Each task then merges the runs of one range of sequences by a loser tree: of two heads the one that
shares more with the last winner is smaller, and only where both share alike turns are compared, from there on. The
merged stream goes through the stack of the nodes on the open path: a node is finished when a sequence leaves it, and
its sums go to its parent.

Nodes on the first and last path of a range may go on in the next range. Their sums so far are edge rows, two paths a range;
one task runs these through the same stack. They are as many as ranges times turns of a conversation, not as the input.

What stays in a task: a run of ``per_range`` sequences, then a range of about as many (ranges are at most ``most``; beyond
``per_range * most`` distinct conversations they grow), at 16 bytes a turn and not its text. A conversation's turns are one
row, so one of ten million turns takes some 250 MB of a task; ids of equal conversations are sorted by Spark and hashed as a stream.

Defined results: null role or text is empty; rows of one turn are ordered by their digest, so repeated rows are repeated
turns. Rows without a conv_id belong to no conversation and are left out. A conversation that has no turn left ends at the
root. Without any conversation there is no root and no row. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITESPACE, Scratch

NODE = "id binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EDGE = "range int, path int, depth int, turn binary, words long, conv_id long, n long, children long, leaves long, saved long, ends string"
_ROWS = pa.schema([("node", pa.struct([("id", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])), ("edge", pa.struct([("range", pa.int32()), ("path", pa.int32()), ("depth", pa.int32()), ("turn", pa.binary()), ("words", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]))])
_RUN = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("i", pa.int32()), ("lcp", pa.int32()), ("turns", pa.list_(pa.binary())), ("words", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
_ROOT = b"\0" * 16
NOTHING = hashlib.sha256(b"").hexdigest()


def heads(conv_id: Column) -> tuple[Column, Column]:
    """(how many turns come from another conversation, which one): crc32 of the decimal id mod 4, the id less its remainder by 20."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4, conv_id - F.pmod(conv_id, F.lit(20))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, words): the digests and word counts of each conversation's turns, its first ones replaced (``heads``)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.filter(F.split(text, WHITESPACE), lambda w: w != "")).cast("long")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_digest"), words.alias("n_words"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    n, other = heads(F.col("conv_id"))
    own = turns.select("conv_id", (F.row_number().over(w) - 1).alias("at"), "turn_digest", "n_words")
    first = own.where((F.pmod("conv_id", F.lit(20)) == 0) & (F.col("at") < 3)).select(F.col("conv_id").alias("other"), "at", "turn_digest", "n_words")
    every = turns.select("conv_id").distinct()
    lent = every.select("conv_id", n.alias("h"), other.alias("other")).join(first, "other").where("at < h").select("conv_id", "at", "turn_digest", "n_words")
    none = every.select("conv_id", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_words"))
    rows = own.where(F.col("at") >= n).union(lent).union(none)
    held = F.filter(F.sort_array(F.collect_list(F.struct("at", "turn_digest", "n_words"))), lambda t: t["at"] >= 0)
    rows = rows.groupBy("conv_id").agg(held.alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: t["turn_digest"]).alias("turns"), F.transform("t", lambda t: t["n_words"]).alias("words"))


def _checksums(ids: DataFrame, piece: int = 50_000) -> DataFrame:
    """(key, ends): SHA-256 of a key's conv_ids in order, comma-joined. Ranges of sorted ids are made text in many tasks; one stream a key hashes it."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) >= piece):
                    yield flush()
                    held = []
                key = k
                held.append(c)
        if held:
            yield flush()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(text.encode())
            if len(out) >= 5000:
                yield _ends(out)
                out = []
        if sha:
            out.append((key, sha.hexdigest()))
        yield _ends(out)

    pieces = ids.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(texts, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(sums, "key binary, ends string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends"])


def lcp(a: list[bytes], b: list[bytes], start: int = 0) -> int:
    """How many turns two sequences share, given that they share ``start``."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def sorted_run(rows: list[tuple], cuts: list[list[bytes]]) -> list[tuple]:
    """(range, lcp, turns beyond it, their words, *rest) of rows (turns, words, *rest), sorted; a range's first row is whole."""
    out, before, was = [], [], -1
    for turns, words, *rest in sorted(rows, key=lambda r: r[0]):
        at = bisect.bisect_right(cuts, turns)
        n = lcp(before, turns) if at == was else 0
        out.append((at, n, turns[n:], words[n:], *rest))
        before, was = turns, at
    return out


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(lcp with the row before, row) of rows (turns, lcp in its run, ...) of sorted runs, in order, by a loser tree."""
    k = len(runs)
    at, shares = [0] * k, [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's share is then the one with the winner."""
        if at[a] >= len(runs[a]):
            return b, a
        if at[b] >= len(runs[b]):
            return a, b
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = runs[a][at[a]][0], runs[b][at[b]][0]
        n = lcp(x, y, shares[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    def first(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    winner = first(1) if k > 1 else 0
    while at[winner] < len(runs[winner]):
        yield shares[winner], runs[winner][at[winner]]
        at[winner] += 1
        if at[winner] < len(runs[winner]):
            shares[winner] = runs[winner][at[winner]][1]
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Node:
    __slots__ = ("id", "turn", "words", "conv_id", "n", "children", "leaves", "saved", "ends", "first")

    def __init__(self, id: bytes, turn: bytes | None, words: int, first: bool):
        self.id, self.turn, self.words, self.first = id, turn, words, first
        self.conv_id, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None

    def add(self, conv_id: int | None, n: int, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None) -> None:
        if conv_id is not None:
            self.conv_id = conv_id if self.conv_id is None else min(conv_id, self.conv_id)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = ends or self.ends


class Path:
    """The stack of open nodes; ``finished`` gets the nodes that are whole, ``edges`` those that may go on elsewhere."""

    def __init__(self, at: int | None = None):
        self.range, self.open, self.finished, self.edges = at, [], [], []

    def push(self, turn: bytes | None, words: int, first: bool = False) -> None:
        id = hashlib.md5(self.open[-1].id + turn).digest() if self.open else _ROOT
        self.open.append(_Node(id, turn, words, first))

    def close(self, depth: int, last: bool = False) -> None:
        """Finish the nodes deeper than ``depth``; at the end of a range (``last``) all that are open are edges."""
        while len(self.open) > depth + 1:
            node, d = self.open.pop(), len(self.open)
            if last or node.first:
                self.edges.append((self.range, 0 if node.first else 1, d, node.turn, node.words, node.conv_id, node.n, node.children, node.leaves, node.saved, node.ends))
                continue
            leaves, saved = node.leaves or 1, node.saved + max(0, node.n - 1) * node.words
            parent = self.open[-1] if self.open else None
            self.finished.append((node.id, parent and parent.id, node.conv_id, d, node.n, node.children, leaves, saved, node.ends or NOTHING))
            if parent:
                parent.add(node.conv_id, node.n, 1, leaves, saved)

    def take(self, rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple[list, list]]:
        """Put merged sequences through the stack; (finished, edges) by and by."""
        for n, (turns, _, words, conv_id, count, ends) in rows:
            first = not self.open
            if first:
                self.push(None, 0, True)
            self.close(n)
            for i in range(n, len(turns)):
                self.push(turns[i], words[i], first)
            self.open[-1].add(conv_id, count, ends=ends)
            if len(self.finished) >= 5000:
                yield self._out()
        self.close(-1, last=True)
        yield self._out()

    def join(self, edges: Iterator[tuple]) -> Iterator[tuple[list, list]]:
        """Put edge rows in order of range, path and depth through the stack."""
        for _, _, depth, turn, words, *sums in edges:
            if not (len(self.open) > depth and self.open[depth].turn == turn):
                self.close(depth - 1)
                self.push(turn, words)
            self.open[depth].add(*sums)
            if len(self.finished) >= 5000:
                yield self._out()
        self.close(-1)
        yield self._out()

    def _out(self) -> tuple[list, list]:
        out = self.finished, self.edges
        self.finished, self.edges = [], []
        return out


def _batch(finished: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    node = [dict(zip((f.name for f in _ROWS[0].type), x, strict=True)) for x in finished]
    edge = [dict(zip((f.name for f in _ROWS[1].type), x, strict=True)) for x in edges]
    return pa.RecordBatch.from_arrays([pa.array(node + [None] * len(edge), _ROWS[0].type), pa.array([None] * len(node) + edge, _ROWS[1].type)], schema=_ROWS)


def nodes(sequences: DataFrame, scratch: Scratch, per_range: int = 20_000, most: int = 8192, turns_of_cut: int = 64) -> DataFrame:
    """The nodes (``NODE``) of the trie of distinct sequences (key, turns, words, conv_id, n, ends)."""
    total = sequences.count()
    ranges = max(1, min(most, math.ceil(total / per_range)))
    cuts: list[list[bytes]] = []
    if ranges > 1:
        # The sample that cuts the ranges: some eight sequences a range, at most ``turns_of_cut`` turns of each.
        rate = int(min(1.0, 8 * ranges / total) * (1 << 30))
        drawn = sequences.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rate).select(F.slice("turns", 1, turns_of_cut).alias("turns"))
        sample = sorted([bytes(t) for t in r["turns"]] for r in drawn.collect())
        cuts = sorted({tuple(sample[i * len(sample) // ranges]) for i in range(1, ranges)}) if sample else []
        cuts = [list(c) for c in cuts]
    held = sequences.sparkSession.sparkContext.broadcast(cuts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def run() -> Iterator[pa.RecordBatch]:
            out = [(at, (part << 32) + made, i, *rest) for i, (at, *rest) in enumerate(sorted_run(rows, held.value))]
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 5000], strict=True), _RUN, strict=True)], schema=_RUN)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[0])
                if len(rows) >= per_range or size >= 1_000_000:
                    yield from run()
                    rows, size, made = [], 0, made + 1
        yield from run()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, parts, before, told = None, None, [], ([], []), 0

        def close() -> Iterator[pa.RecordBatch]:
            for out in Path(at).take(merged(parts)):
                yield _batch(*out)

        for batch in batches:
            for r, own, _, n, turns, words, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    if parts:
                        yield from close()
                    at, run, parts = r, None, []
                if own != run:
                    run, before = own, ([], [])
                    parts.append([])
                before = (before[0][:n] + turns, before[1][:n] + words)
                parts[-1].append((before[0], n, before[1], *rest))
        if parts:
            yield from close()

    kind = "range int, run long, i int, lcp int, turns array<binary>, words array<long>, conv_id long, n long, ends string"
    sorted_runs = sequences.select("turns", "words", "conv_id", "n", "ends").mapInArrow(runs, kind)
    dealt = sorted_runs.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "run", "i")
    out = scratch.table(dealt.mapInArrow(merge, f"node struct<{_fields(NODE)}>, edge struct<{_fields(EDGE)}>"), "ranges")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for finished, _ in Path().join(rows):
            yield pa.RecordBatch.from_struct_array(_batch(finished, []).column(0))

    edges = out.where("edge is not null").select("edge.*").repartition(1).sortWithinPartitions("range", "path", "depth")
    return out.where("node is not null").select("node.*").union(edges.mapInArrow(join, NODE))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split() for x in schema.split(", ")))


def trie(conversations: DataFrame, **parameters) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with Scratch(conversations.sparkSession, "trie") as scratch:
        rows = rebuilt(conversations)
        key = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t)), "")))
        rows = scratch.table(rows.select("conv_id", key.alias("key"), "turns", "words"), "rebuilt")
        distinct = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.any_value(F.struct("turns", "words")).alias("s"))
        distinct = distinct.join(_checksums(rows), "key").select("key", "s.turns", "s.words", "conv_id", "n", "ends")
        own = scratch.table(nodes(scratch.table(distinct, "distinct"), scratch, **parameters), "nodes")
        parents = own.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = own.join(parents, "parent", "left")
        return scratch.keep(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
