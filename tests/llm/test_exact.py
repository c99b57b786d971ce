"""Operators with exact results, against brute force, round trips or SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm import decontamination, jaccard_join, packing, queries, token_counts, token_files, tokens, warc
from lexispark.llm.common import HashedWords, WordHashes, shingles, windows

from .helpers import by_row, empty, frame, odd_rows, words

PATH = tokens.vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens -------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == tokens.encoder(PATH).whole.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_but_stays_right(tokenizer):
    own = tokens.Encoder(PATH, most=5)
    for text in ["The cat's hat, the CAT.", "a1b2 <|endoftext|>x don't", "ÄÖ straße naïve 12½"] * 3:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_encoder_leaves_other_vocabularies_to_the_library(tmp_path):
    import json

    stated = json.load(open(PATH, encoding="utf-8"))
    stated["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(stated), encoding="utf-8")
    own = tokens.Encoder(str(tmp_path / "cased.json"))
    assert tokens.encoder(PATH).known and not own.known
    for text in ("The CAT's hat", "a\tb  c\nÄ", "don't 12"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


# --- Simple-8b ----------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    packed, escapes = token_files.pack(ids)
    out = token_files.unpack(packed)
    out[escapes] = ids[escapes]
    assert out.tolist() == values and set(escapes.tolist()) == {i for i, x in enumerate(values) if x >> 60}


def test_token_files(spark, tokenizer, tmp_path):
    rows = odd_rows()
    token_files.write_files(frame(spark).repartition(5), str(tmp_path))
    got = token_files.read_files(spark, str(tmp_path)).orderBy("start").collect()
    place = {r["t"]: r["h"] for r in frame(spark).select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1] or ""]))
    start = 0
    for r, g in zip(order, got, strict=True):
        ids = [*ids_of(tokenizer, r[1]), 2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"], list(g["ids"])) == (r[0], start, len(ids), crc(ids), ids)
        start += len(ids)
    assert [p for p in tmp_path.iterdir() if p.suffix == ".s8b"]


def test_token_files_empty_and_broken(spark, tmp_path):
    token_files.write_files(empty(spark), str(tmp_path / "e"))
    assert token_files.read_files(spark, str(tmp_path / "e")).count() == 0
    token_files.write_files(frame(spark), str(tmp_path / "b"))
    file = next((tmp_path / "b").glob("*.s8b"))
    file.write_bytes(file.read_bytes()[:-30])
    with pytest.raises(Exception, match="not a whole token file"):
        token_files.read_files(spark, str(tmp_path / "b")).collect()


# --- token counts -------------------------------------------------------------------------------


def test_token_counts(spark, tokenizer):
    lengths = np.array([len(ids_of(tokenizer, r[1])) for r in odd_rows()])
    h = token_counts.histogram(frame(spark))
    got = token_counts.profile(h, width=16).collect()
    assert sorted(r["length"] for r in got) == sorted(set(lengths.tolist()))
    for r in got:
        x = r["length"]
        assert (r["n_docs"], r["docs_over"], r["truncated_total"], r["total_tokens"], r["tokens_up_to"], r["docs_up_to"]) == ((lengths == x).sum(), (lengths > x).sum(), np.minimum(lengths, x).sum(), lengths.sum(), lengths[lengths <= x].sum(), (lengths <= x).sum())
    for r in token_counts.at_limits(h, [0, 7, 100, 10**6]).collect():
        assert (r["docs_over"], r["truncated_total"]) == ((lengths > r["context_limit"]).sum(), np.minimum(lengths, r["context_limit"]).sum())
    assert [r["length"] for r in token_counts.quantiles(h, [0.25, 0.5, 1.0]).collect()] == np.quantile(lengths, [0.25, 0.5, 1.0], method="inverted_cdf").tolist()
    assert token_counts.profile(token_counts.histogram(empty(spark))).count() == 0
    assert [tuple(r) for r in token_counts.at_limits(token_counts.histogram(empty(spark)), [5]).collect()] == [(5, 0, 0)]


# --- packing ------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    runs = packing.plan(counts, 40)
    bins = {}
    for length, lo, n, first, offset in runs.tolist():
        for i in range(n):
            bins.setdefault(first + i, []).append((offset, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 40
    for length, n in counts.items():
        ranks = sorted((lo, k) for x, lo, k, _, _ in runs.tolist() if x == length)
        assert [lo for lo, _ in ranks] == [0, *itertools.accumulate(k for _, k in ranks)][:-1] and sum(k for _, k in ranks) == n
    rooms = []  # one piece at a time
    for length in sorted(itertools.chain.from_iterable([x] * n for x, n in counts.items()), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(40 - length)
    assert len(bins) == len(rooms)


def test_packing(spark, tokenizer):
    got = packing.best_fit(frame(spark).repartition(6), size=128).toPandas()
    want = []
    for r in odd_rows():
        ids = [*ids_of(tokenizer, r[1]), 0]
        want += [(r[0], i // 128, i, len(ids[i : i + 128]), crc(ids[i : i + 128])) for i in range(0, len(ids), 128)]
    ids = got["doc_id"].astype(object).where(got["doc_id"].notna(), None)
    assert by_row((None if i is None else int(i), *map(int, r)) for i, r in zip(ids, got[["piece", "start", "length", "ids_crc32"]].itertuples(index=False), strict=True)) == by_row(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 128
    assert packing.best_fit(empty(spark)).count() == 0


# --- WARC ---------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, size string")


PAGES = [(1, "http://a/é b", "x" * 1500), (2, None, None), (3, "http://c\nd", "x" * 1500), (4, "u", "short"), (5, "v", "short"), (6, "w", "é" * 500), (7, "w", "é" * 500), (3, "again", "x" * 1500), (None, "n", "x" * 1500), (8, "z", "q" * 999), (9, "z", "q" * 999), (10, "t", "\r\n\r\nWARC/1.1\r\n" * 200)]


def test_warc_round_trip(spark, tmp_path):
    warc.write_archives(pages(spark, PAGES), str(tmp_path), shard_bytes=3000, file_bytes=900)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        refers = max(same) if len(data) >= 1000 and (page_id is None or page_id < max(same)) else None
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers, data if refers is None else None))
    assert by_row((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == by_row(want)


def test_warc_is_deterministic_and_verified(spark, tmp_path):
    for name, n in (("a", 1), ("b", 5)):
        warc.write_archives(pages(spark, PAGES).repartition(n), str(tmp_path / name), shard_bytes=3000, file_bytes=900)
    files = sorted(p.name for p in (tmp_path / "a").glob("*.gz"))
    assert len(files) > 3 and files == sorted(p.name for p in (tmp_path / "b").glob("*.gz"))
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    assert not list((tmp_path / "a" / "_temporary").iterdir())
    (tmp_path / "a" / files[0]).write_bytes((tmp_path / "a" / files[1]).read_bytes() * 2)
    with pytest.raises(Exception, match="manifest says"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


def test_warc_spreads_null_and_repeated_ids(spark, tmp_path):
    same = "s" * 1200
    rows = [(None if i % 2 else i % 3 and i or 4, f"http://h/{i}", same if i % 5 == 0 else f"{i} " * 100) for i in range(4000)] + [(5000, "big", "é" * 2_000_000)]
    for name, n in (("a", 3), ("b", 7)):
        warc.write_archives(pages(spark, rows).repartition(n), str(tmp_path / name), shard_bytes=60_000)
    manifest = spark.read.parquet(str(tmp_path / "a" / "manifest"))
    sizes = sorted(r[0] for r in manifest.groupBy("shard").sum("records").select("sum(records)").collect())
    assert len(sizes) > 30 and sizes[-1] <= 2.5 * sizes[len(sizes) // 2]
    files = sorted(p.name for p in (tmp_path / "a").glob("*.gz"))
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    ids = []
    for f in files:
        with open(tmp_path / "a" / f, "rb") as stream:
            ids += [h["WARC-Record-ID"] for h, _ in warc.records(stream)]
    assert len(ids) == len(set(ids))
    first = max(p for p, _, h in rows if h == same and p is not None)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    want = [(p, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), first if h == same and p != first else None) for p, _, h in rows]
    assert by_row((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got) == by_row(want)
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)


def test_warc_empty(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path)).count() == 0


def test_warc_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.op2_warc(spark, sf).orderBy("page_id").collect()
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.oracle_sql()['op2_warc']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in got] == want


# --- Jaccard join -------------------------------------------------------------------------------


def brute_components(rows, size=5, percent=80):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)], [find(i) for i in range(len(rows))]


def near_copies(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    rows, base_rows = [], odd_rows()
    for n in (1, 2, 3, 9, 12, 20, 35, 60, 150, 400):
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((1000 + len(rows), " ".join(w), "en", "s", 0, *(["x"] * 10)))
    line = " ".join(rng.choice(vocab) for _ in range(14))
    rows += [(3000 + i, line + " " + rng.choice(vocab), "en", "s", 0, *(["x"] * 10)) for i in range(60)]
    return base_rows + rows


@pytest.mark.parametrize(("split", "size", "percent"), ((1024, 3, 90), (8, 5, 80), (8, 1, 50)))
def test_jaccard_join_equals_brute_force(spark, split, size, percent):
    rows = near_copies(split)
    got = jaccard_join.join(frame(spark, rows), size, percent, split)
    assert by_row((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == by_row(brute_components(rows, size, percent)[0])


def test_jaccard_filter_keeps_one_of_each_group(spark):
    rows = near_copies(3)
    docs = frame(spark, rows)
    kept = jaccard_join.filter_documents(docs)
    want, group = brute_components(rows)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {c for _, n, c in want if n and c is not None}
    assert jaccard_join.join(empty(spark)).count() == 0 and jaccard_join.filter_documents(empty(spark)).count() == 0


def test_jaccard_settles_texts_of_their_own_and_joins_the_same_with_full_groups(spark, monkeypatch):
    """With few fine groups, all of them hold several texts: only what is settled before keeps cells away."""
    monkeypatch.setattr(jaccard_join, "SHARD", 1 << 9)
    monkeypatch.setattr(jaccard_join, "FEW", 3)  # nothing is broadcast
    rng = random.Random(8)
    rows = near_copies(3) + [(5000 + i, " ".join(str(rng.randrange(10**9)) for _ in range(90)), "en", "s", 0, *(["x"] * 10)) for i in range(300)]
    docs = frame(spark, rows).repartition(3).withColumn("_f1", F.xxhash64(F.coalesce("text", F.lit(""))))
    asked = docs.select("doc_id", "_f1").collect()
    left = jaccard_join.marked(pa.array([r["_f1"] for r in asked]), jaccard_join.unsettled(docs.select("_f1", F.coalesce("text", F.lit("")).alias("text")), 5, 80))
    open_ = {r["doc_id"] for r, x in zip(asked, left.tolist(), strict=True) if x}
    want, group = brute_components(rows)
    linked = {c for c, k in Counter(group).items() if k > 1}
    assert open_ >= {w[0] for w, c in zip(want, group, strict=True) if c in linked and w[1]} and len(open_ & set(range(5000, 5300))) < 30
    got = jaccard_join.join(docs.drop("_f1"), 5, 80)
    assert by_row((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == by_row(want)
    kept = jaccard_join.filter_documents(docs.drop("_f1"))
    assert kept.count() == len(set(group)) and kept.columns == docs.drop("_f1").columns


def test_jaccard_join_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ("doc_id", "n_shingles", "component_id", "n_equal", "n_links")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op3_jaccard_join']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in queries.op3_jaccard_join(spark, sf).select(*names).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize(("split", "parts"), ((1024, 1), (8, 7)))
def test_jaccard_join_counts_all_links(spark, split, parts):
    rows = near_copies(split + 1)
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w := words(r[1])) >= 3 else frozenset([tuple(w)] if w else []) for r in rows]
    distinct = [x for x in set(sets) if x]
    links = {x: sum(x != y and 100 * len(x & y) >= 90 * len(x | y) for y in distinct) for x in distinct}
    got = jaccard_join.join(frame(spark, rows).repartition(parts), 3, 90, split).collect()
    assert by_row((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == by_row((r[0], len(x), links.get(x, 0)) for r, x in zip(rows, sets, strict=True))
    assert max(links.values()) > 5


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 40))
def test_common_elements(seed, n, m):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, rng.choice((5, 60, 2000)), rng.integers(1, 80)).astype(np.uint64)) for _ in range(n + m)]
    want = [[len(np.intersect1d(a, b)) for b in sets[n:]] for a in sets[:n]]
    assert jaccard_join.common(sets[:n], sets[n:]).tolist() == want


RARITY = np.concatenate([np.random.default_rng(5).integers(0, n, size).astype(np.uint8) for n, size in ((20, jaccard_join.GROUPS), (256, jaccard_join.FINE >> 3))])


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32), st.floats(0, 0.4), st.floats(0, 0.4), st.sampled_from((50, 80, 90, 100)))
def test_linked_sets_share_a_cell_and_pass_the_bound(n, seed, gone, new, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[int(gone * len(a)) :], rng.integers(0, 2**63, int(new * len(a))).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    link = 100 * common >= percent * (len(a) + len(b) - common)
    assert jaccard_join.linked(a, b, percent) == link
    if link:
        keys = [jaccard_join.first_keys(x, RARITY, percent).view(np.int64) for x in (a, b)]
        first = int(np.intersect1d(*keys)[0])
        assert jaccard_join.unmet(keys, first, np.array([len(a), len(b)]), np.array([0, 1]), np.zeros(2), percent, False).tolist() == [[False, True], [True, False]]
        p, q = jaccard_join.points([a, b])
        assert np.minimum(p, q).sum() >= common >= jaccard_join.needed(len(a), len(b), percent)


@pytest.mark.parametrize("both", (False, True))
def test_pairs_meet_once(both):
    rng = np.random.default_rng(6)
    n = 70
    keys = [rng.permutation(40)[: rng.integers(1, 12)] for _ in range(n)]
    root, side = rng.integers(0, 50, n), rng.integers(0, 2, n)
    met = np.zeros((n, n), int)
    for key in range(40):
        rows = np.array([i for i in range(n) if key in keys[i]])
        if len(rows):
            met[np.ix_(rows, rows)] += jaccard_join.unmet([keys[i] for i in rows], key, np.ones(len(rows), int), root[rows], side[rows], 50, both)
    for i, j in itertools.product(range(n), range(n)):
        assert met[i, j] == (bool(set(keys[i].tolist()) & set(keys[j].tolist())) and root[i] != root[j] and (side[i] != side[j] or not both))


@pytest.mark.parametrize("both", (False, True))
def test_tree_loses_no_pair_that_the_bound_allows(both):
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 40])[: rng.integers(40, 60)], rng.integers(0, 2**63, 4).astype(np.uint64)])) for i in range(300)]
    n, group, side, p = np.array([len(x) for x in sets]), rng.integers(0, 200, 300), rng.integers(0, 2, 300), jaccard_join.points(sets)
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if group[i] != group[j] and (side[i] != side[j] or not both) and np.minimum(p[i], p[j]).sum() >= jaccard_join.needed(n[i], n[j], 80)}
    got = [(min(i, j), max(i, j)) for a, b in jaccard_join.tree_pairs(group[:, None] != group[None, :], side if both else np.zeros(300, int), n, p, 80, both) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_order_puts_frequent_shingles_last(spark):
    rows = [(i, f"a b c d e f g x{i}", "en", "s", 0, *(["x"] * 10)) for i in range(64)]
    rarity = np.frombuffer(jaccard_join.order(frame(spark, rows), 3), np.uint8)
    h = windows(next(HashedWords()(pa.array(["a b c D E f\tg\n x3"]))), 3) % np.uint64(jaccard_join.GROUPS)
    assert (rarity[h[:5].astype(int)] == 12).all() and rarity[int(h[5])] == 2
    at, bit = jaccard_join.fine(windows(next(HashedWords()(pa.array(["a b c D E f\tg\n x3"]))), 3))
    assert (rarity[jaccard_join.GROUPS + at] & bit > 0).tolist() == [True] * 5 + [False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZ é\t\n\x0b\x0c\r\x1c\xa0你"), max_size=30), max_size=8), st.sampled_from((1, 7, 1 << 19)), st.integers(0, 2))
def test_hashed_words(rows, piece, skip):
    got = [x.tolist() for x in HashedWords(piece)(pa.array(["x y"] * skip + rows).slice(skip))]
    want = [r.encode().lower().split() for r in rows]
    assert [len(x) for x in got] == [len(x) for x in want]
    pairs = {(w, h) for x, y in zip(want, got, strict=True) for w, h in zip(x, y, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert got == [x.tolist() for x in HashedWords()(pa.array(rows, pa.string()))]


def test_shingle_hashes_tell_sizes_apart():
    h = WordHashes(most=2)
    assert len(np.unique(np.concatenate([shingles(w, h, 3) for w in ([b"a"], [b"a", b"a"], [b"a"] * 3, [b"a", b"b", b"a"])]))) == 4
    assert shingles([], h, 3).size == 0


# --- decontamination ----------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(6, 130))) + ". The answer " + rng.choice(vocab)) for i in range(60)] + [(60, None), (61, ""), (None, items_text := "q " * 9)]
    rows = odd_rows()
    fill = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    for k, (i, text) in enumerate(items[:60]):
        w = text.split()
        w = w if k % 3 == 0 else w[: len(w) - len(w) // 10] if k % 3 == 1 else [x if rng.random() > 0.3 else rng.choice(vocab) for x in w]
        rows.append((500 + k, fill(rng.randrange(150)) + "\n" + " ".join(w).upper() + " " + fill(rng.randrange(150)), "en", "s", 0, *(["x"] * 10)))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")

    def sh(w, n=5):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}

    want = set()
    for r in rows:
        w = words(r[1])
        for i, text in items:
            own = words(text)
            if own:
                s = sh(own)
                if len(s & sh(w, min(5, len(own)))) >= 0.8 * len(s):
                    want.add((r[0], i))
    answers = [(r["doc_id"], r["item_id"]) for r in decontamination.find(frame(spark, rows), bench).collect()]
    assert set(answers) == want and len(want) >= 35
    cut = decontamination.Settings(index_bytes=3000)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(frame(spark, rows), bench, cut).collect()} == want
    kept = decontamination.filter_documents(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r[0] not in {d for d, _ in want} for r in rows)
    assert decontamination.find(frame(spark), bench.where("item_id > 1000")).count() == 0
    assert decontamination.find(empty(spark), bench).count() == 0
    assert items_text


def test_decontamination_of_scattered_copies(spark):
    """Items in pieces far apart, interrupted, and questions alone, against brute force over whole documents."""
    rng = random.Random(11)
    vocab = [f"u{i}" for i in range(4000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice((3, 8, 20, 40, 90)))) + ". " + " ".join(some(rng.choice((1, 3, 8, 20))))) for i in range(60)]
    items.append((60, " ".join(vocab[:40])))
    rows = []

    def add(*pieces):
        text = some(rng.randrange(1, 90))
        for x in pieces:
            text += [*x, *some(100)]
        rows.append((len(rows), " ".join(text), "en", "s", 0, *(["x"] * 10)))

    for _, text in items:
        w = text.split()
        cut = next((i + 1 for i, x in enumerate(w) if x.endswith(".")), len(w))
        add(w[:cut], w[cut:])  # question and answer apart
        add(w[: len(w) // 2], w[len(w) // 2 :])
        add(*(w[i : i + 21] for i in range(0, len(w), 21)))  # interrupted
        add(*(w[i : i + 7] for i in range(0, len(w), 3)))  # overlapping pieces of seven words
        add(w[:cut])
        add(w[cut:])
    bench = spark.createDataFrame(items, "item_id long, text string")

    def sh(w, n=5):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def share(w, doc):
        own = sh(w, min(5, len(w)))
        return len(own & sh(doc, min(5, len(w)))) / len(own)

    want = set()
    for r in rows:
        doc = words(r[1])
        for i, text in items:
            w = words(text)
            cut = next((k + 1 for k, x in enumerate(w) if x.endswith(b".")), len(w))
            q, a = w[:cut], w[cut:]
            if share(w, doc) >= 0.8 or (len(q) >= 5 and share(q, doc) >= 0.8) or (len(q) < 5 <= len(a) and share(a, doc) >= 0.8 and share(q, doc) == 1):
                want.add((r[0], i))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(frame(spark, rows), bench).collect()} == want
    assert len(want) > 200 and (60 * 6 + 1, 60) in want
    kept = {r["doc_id"] for r in decontamination.filter_documents(frame(spark, rows), bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_plain_text_is_split_at_once_as_the_library_splits_it():
    """Every plain character beside the others of the split, in text with odd chunks between; few calls for texts that repeat no chunk."""
    own = tokens.Encoder(tokens.vocabulary())
    plain = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x130), *range(0x131, 0x17F))]
    rng = random.Random(5)
    some = ["'s", "'S", "'ll", "'re", "'d", "x's", "1", "23", "_", "-", "É", " ", "\n", " ", " ", "<|endoftext|>", "<|", "’", "é", "你", "İ", "ſ", "²"]
    texts = ["".join(rng.choice(plain if rng.random() < 0.6 else some) for _ in range(60)) for _ in range(3000)]
    texts += [f"{a}{b}{a} {b}'{a}" for a in plain for b in ("a", "1", "'", "-", "Ü", "×")]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(own.encode("ab" * 500_000 + " é’")) > 4  # a long chunk beside an odd one
    own, made = tokens.Encoder(tokens.vocabulary()), []
    own.pretokens.make = lambda x, make=own.pretokens.make: made.append(x) or make(x)
    own.encode(" ".join(f"{a}word{b}{a}" for a in "(\"-" for b in ".,;:!?"))
    assert len(made) == len(set(made)) and not own.chunks
