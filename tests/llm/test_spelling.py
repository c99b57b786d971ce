"""Spelling variants against brute force over all pairs, and against SQL."""

import collections
import itertools
import random
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import queries, spelling

from .helpers import empty, frame, odd_rows


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=5, occurrences=3, ratio=2, every=97):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    v = {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(sorted(v), 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= ratio * v[w] else None
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(near[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["colour", "straße", "theatre", "ööööö", "aaaab", "aaaaa", "baaaa", "×÷×÷×", "ÀÉÎÕÜ"]
    rows = []
    for i in range(400):
        ws = []
        for _ in range(40):
            w = rng.choice(stems[: rng.choice([2, 4, 9])])
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "ö", "A"]) + w[at + rng.choice([0, 1]) :]
            ws.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(ws)))
    rows += [(None, "colour colours colours"), (3, None), (4, ""), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.variants(df)) == plain(rows)
    assert rows_of(spelling.variants(df, least=2, occurrences=1, ratio=1 + 1, every=3)) == plain(rows, 2, 1, 2, 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=2, max_size=7), min_size=2, max_size=12, unique=True))
def test_partitions_and_tries_find_each_pair_once(words):
    parts = collections.defaultdict(list)
    for w in words:
        n = len(w)
        for back, at in {(False, n // 2), (False, (n - 1) // 2), (True, n // 2), (True, (n + 1) // 2)}:
            path = w[::-1] if back else w
            parts[back, path[:at]].append(path[at:])
    found = [frozenset((p[0], p[2])) for key, rest in parts.items() for p in spelling._of(key, sorted(rest), [1] * len(rest))]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_apart(*p)}
    assert len(found) == len(set(found)) and set(found) == want


def test_long_runs_odd_rows_and_none(spark):
    long = "x" * 30_000
    rows = [(i, f"{long} {long}y") for i in range(4)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows) and len(got) == 2
    assert rows_of(spelling.variants(frame(spark))) == plain(odd_rows())
    assert rows_of(spelling.variants(empty(spark))) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op11_spelling"]).fetchall(), key=repr)
    assert rows_of(queries.op11_spelling(spark, "/root/testdata/sf0.001")) == want
