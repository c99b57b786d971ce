"""The fingerprints against a plain version in Python."""

import hashlib
import math
import re

import xxhash

from lexispark.llm import i_match
from lexispark.llm.i_match import GROUPS

from .helpers import empty, frame, odd_rows

LOWEST = -(1 << 63)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h64(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def terms_of(text, least):
    own = {h64(w) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}
    doubled = math.log2(max(len(own), 1) / least)
    return {h for h in own if (h >> 5) % (1 << 40) < 2.0 ** (40 - max(0, math.floor(doubled + h % GROUPS / GROUPS)))}


def fingerprint(text, lexicon, least):
    own = terms_of(text, least)
    own = own & lexicon or own
    out = []
    for g in range(GROUPS):
        a, state = sorted(signed(h) for h in own if h % GROUPS == g), 42
        for h in a:  # Spark hashes an array by seeding each element with the hash of those before
            state = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed=state)
        out.append(f"{state:016x}"[8:] if a else "." * 8)
    return out


def alike(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("." * 8,) * 2]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def plain(rows, band=(0.2, 0.9), least=32):
    docs = [(r[0], r[1] or "") for r in rows]
    docs.sort(key=lambda d: (LOWEST if d[0] is None else d[0], signed(h64(d[1]))))
    df = {}
    for _, t in docs:
        for h in {h64(w) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}:
            df[h] = df.get(h, 0) + 1
    n = len(docs)
    lexicon = {h for h, k in df.items() if band[0] <= math.log(n / k) / math.log(max(n, 2)) <= band[1]}
    out = []
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % n][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, e, x = (fingerprint(t, lexicon, least) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(e), round(alike(a, e), 9), round(alike(a, x), 9)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


def test_fingerprints_equal_the_plain_version(spark):
    rows = [r for r in odd_rows(n=80) if r[0] != 108]  # lower() of special capitals differs between Java and Python
    assert rows_of(i_match.fingerprints(frame(spark, rows))) == plain(rows)


def test_long_texts_are_thinned_and_near_copies_agree(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 40, 700, 4000])))
        rows += [(2 * i, text), (2 * i + 1, text + " and a few words more")]
    rows = [(*r, "en", "src0", 0, *(["x"] * 10)) for r in rows]
    got = rows_of(i_match.fingerprints(frame(spark, rows)))
    assert got == plain(rows)
    assert all(r[6] > 0.3 for r in got if r[0] % 2 == 0 and r[1] > 500)
    assert len(terms_of(" ".join(f"w{i}" for i in range(100_000)), 32)) < 128


def test_order_over_many_buckets_repeated_and_hot_ids(spark):
    rows = [(i // 2 if i % 3 else None if i % 2 else 7, f"text number {i}") for i in range(900)]
    rows += [(7, "text number 1")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = i_match.with_next(docs, per_bucket=10, per_bound=8).collect()
    order = sorted(rows, key=lambda r: (LOWEST if r[0] is None else r[0], signed(h64(r[1]))))
    want = sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got), key=repr) == want
    text = {r["rid"]: r["text"] for r in got}
    assert len(text) == len(rows) and all(text[r["next_rid"]] == r["next_text"] for r in got)
    assert len({r["rid"] >> 40 for r in got if r["doc_id"] == 7}) > 8  # a hot id is split


def test_few_and_no_rows(spark):
    assert i_match.fingerprints(empty(spark)).collect() == []
    one = i_match.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in one] == [(1, 8, 1.0)]
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    none = i_match.fingerprints(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect()
    assert {(r["fingerprint"], r["near_edited"], r["near_next"]) for r in none} == {("." * 8 * GROUPS, 1.0, 1.0)}
