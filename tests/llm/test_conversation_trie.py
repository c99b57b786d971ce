"""The prefix trie of conversations against brute force, its mergesort against sorted(), and against SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import conversation_trie as ct
from lexispark.llm import queries


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(x)] for c, x in turns.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.defaultdict(list)
    for x in members:
        if x:
            kids[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(members, key=len, reverse=True):
        w = len(x[-1][1].encode().split()) if x else 0
        leaves[x] = sum(leaves[k] for k in kids[x]) or 1
        saved[x] = (len(members[x]) - 1) * w + sum(saved[k] for k in kids[x])
    out = []
    for x, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(x))))
        out.append((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(kids[x]), leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 2 else None, rng.choice(["hello there", "hi", None, "a b  c\td", "Ünï code"])))
    rows += [(c, t, "user", f"the same {t}") for c in range(n, n + 60) for t in range(6)]
    rows += [(7, None, "user", "null turn"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "bot", "tie"), (None, 0, "user", "nobody"), (-3, 0, "user", "negative"), (-20, 0, "user", "negative base")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, n string, parent long")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parameters", [{}, {"per_range": 7}, {"per_range": 1, "most": 40, "turns_of_cut": 2}])
def test_trie_equals_brute_force(spark, parameters):
    rows = some(1, 300)
    assert rows_of(ct.trie(frame(spark, rows).repartition(6), **parameters)) == plain(rows)


def test_few_rows(spark):
    assert rows_of(ct.trie(frame(spark, []))) == []
    assert rows_of(ct.trie(frame(spark, [(None, 1, "a", "b")]))) == []
    # 2 lends its own (none), crc32("2") % 4 turns go: the conversation may end at the root
    for rows in ([(2, 0, "user", "x")], [(0, 0, None, None)], [(c, 0, "user", "x") for c in range(40)]):
        assert rows_of(ct.trie(frame(spark, rows))) == plain(rows)


def test_long_conversations_and_many_copies(spark):
    rows = [(c, t, "user", f"t {t}") for c in (1, 21, 41) for t in range(3000)] + [(c, 0, "user", "copy") for c in range(100, 700)]
    assert rows_of(ct.trie(frame(spark, rows), per_range=2)) == plain(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=6), max_size=40, unique_by=tuple), st.integers(1, 7), st.integers(0, 3))
def test_mergesort(sequences, k, n_cuts):
    cuts = sorted(sequences)[:: max(1, len(sequences) // (n_cuts + 1))][1 : n_cuts + 1]
    ranges = collections.defaultdict(list)
    for i in range(k):
        before, was = [], None
        for at, n, tail, words in ct.sorted_run([(s, [1] * len(s)) for s in sequences[i::k]], cuts):
            whole = before[:n] + tail
            assert len(words) == len(tail)
            if was != at:
                assert n == 0
                ranges[at].append([])
            ranges[at][-1].append((whole, n))
            before, was = whole, at
    out = []
    for at in sorted(ranges):
        before = []
        for n, (s, _) in ct.merged(ranges[at]):
            assert n == ct.lcp(before, s)
            out.append(s)
            before = s
    assert out == sorted(sequences)


def test_heads_are_compared_only_beyond_what_they_share():
    class Counted(bytes):
        n = 0

        def __eq__(self, other):
            Counted.n += 1
            return bytes.__eq__(self, other)

        __hash__ = bytes.__hash__

    runs = [[([Counted(b"x")] * 50 + [Counted(bytes([i])), Counted(bytes([j]))], 0 if not j else 51) for j in range(20)] for i in range(8)]
    total = sum(len(r) for r in runs)
    assert len(list(ct.merged(runs))) == total
    assert Counted.n < 8 * 60 + total * 4  # the shared fifty turns are compared once a run, not once a row


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op13_conversation_trie"]).fetchall(), key=repr)
    assert rows_of(queries.op13_conversation_trie(spark, "/root/testdata/sf0.01")) == want
