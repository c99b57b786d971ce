"""Operators that learn: language model, language identification, quality classifier, quality rules."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import brown_lm, language_id, quality_classifier, quality_rules
from lexispark.llm.common import fold

from .helpers import by_row, empty, frame, odd_rows, remainder, words

SMALL = brown_lm.Settings(units=6, forms=4, head=8, classes=5, rounds=4)


def base_scores(rows):
    train = [r for r in rows if remainder(r[0], 10)]
    c = collections.Counter(w for r in train for w in words(r[1]))
    c[b""] = len(train)
    n, v = sum(c.values()), sum(1 for x in c.values() if x)
    out = []
    for r in rows:
        t = [*words(r[1]), b""]
        out.append((r[0], not remainder(r[0], 10), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)))
    return out


def test_brown_base_is_exact_with_a_small_head(spark):
    got = brown_lm.score(frame(spark), fold("doc_id", 10) == 0, SMALL).collect()
    assert by_row((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == by_row(base_scores(odd_rows()))
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)


def test_brown_score_equals_brute_force_and_sums_to_one(spark):
    """Scores from the classes alone: class pairs and words are counted anew here, and every distribution sums to 1."""
    rows = odd_rows()
    train = [r for r in rows if remainder(r[0], 10)]
    docs = frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with brown_lm.Scratch(spark, "brown-test") as scratch:
        model, vocabulary = brown_lm.fit(docs.where(fold("doc_id", 10) != 0), SMALL, scratch)
        own = {bytes(r["word"]): r["cls"] for r in vocabulary.collect()}
        tagged = brown_lm.tagged(docs.withColumn("held_out", fold("doc_id", 10) == 0), model, vocabulary, scratch)
        transition = brown_lm.transitions(tagged.where(~F.col("held_out")), SMALL)
    other = len(model.head) + len(model.forms)
    assert set(own) == {w for r in train for w in words(r[1])} and len(own) > SMALL.head > SMALL.units
    assert all(own[w] == model.cls[i] for w, i in model.head.items())

    def cls(w):
        return 0 if w == b"" else own[w] if w in own else int(model.cls[model.forms.get(w[-3:], other)])

    pairs, count, k = np.zeros((SMALL.classes,) * 2), collections.Counter(), SMALL.classes
    for r in train:
        w = [b"", *words(r[1]), b""]
        count.update(w[1:])
        for a, b in zip(w, w[1:], strict=False):
            pairs[cls(a), cls(b)] += 1
    prior = (pairs.sum(axis=0) + 1) / (pairs.sum() + k)
    move = (pairs + SMALL.mu * prior) / (pairs.sum(axis=1, keepdims=True) + SMALL.mu)
    n_c, v_c = np.zeros(k), np.zeros(k)
    for w, n in count.items():
        n_c[cls(w)] += n
        v_c[cls(w)] += 1
    emit = lambda w: (count[w] + 0.1) / (n_c[cls(w)] + 0.1 * (v_c[cls(w)] + 1))
    assert np.allclose(move.sum(axis=1), 1) and np.allclose(10**transition, move)
    for c in range(k):
        assert math.isclose(sum(emit(w) for w in count if cls(w) == c) + 0.1 / (n_c[c] + 0.1 * (v_c[c] + 1)), 1)
    got = brown_lm.score(frame(spark), fold("doc_id", 10) == 0, SMALL)
    want = []
    for r in rows:
        w = [b"", *words(r[1]), b""]
        want.append((r[0], round(sum(math.log10(move[cls(a), cls(b)] * emit(b)) for a, b in zip(w, w[1:], strict=False)), 4)))
    assert by_row((r["doc_id"], round(r["score"], 4)) for r in got.collect()) == by_row(want)
    frame_ = got.toPandas()
    assert np.allclose(frame_["perplexity"], 10 ** (-frame_["score"] / frame_["n_tokens"])) and frame_["score"].sum() > frame_["base_score"].sum()
    held = frame_[frame_["held_out"]]
    both = {r["held_out"]: r for r in brown_lm.perplexity(got).collect()}
    assert math.isclose(both[True]["perplexity"], 10 ** (-held["score"].sum() / held["n_tokens"].sum()))


def test_exchange_gains_are_exact():
    """The gain by which a unit moves equals the change of the likelihood."""
    rng = np.random.default_rng(3)
    size, classes = 14, 4
    pairs = rng.integers(0, 6, (size, size)).astype(float)
    cls = np.concatenate([[0], rng.integers(1, classes, size - 1)])

    def counts(c):
        hot = np.eye(classes)[c]
        return pairs @ hot, pairs.T @ hot

    right, left = counts(cls)
    for u in range(1, size):
        moved = brown_lm.exchange(right, left, np.diag(pairs).copy(), cls, np.array([u]))
        best = max(range(1, classes), key=lambda b: brown_lm.likelihood(brown_lm.bigrams(counts(np.where(np.arange(size) == u, b, cls))[0], np.where(np.arange(size) == u, b, cls))))
        value = lambda c: brown_lm.likelihood(brown_lm.bigrams(counts(c)[0], c))
        assert math.isclose(value(moved), value(np.where(np.arange(size) == u, best, cls)), abs_tol=1e-6)


def test_words_beyond_the_units_move_as_exchange_moves_them():
    """From the entries that aren't zero, every class comes out as from whole rows, words that follow themselves too."""
    rng = np.random.default_rng(5)
    for classes, size in ((4, 30), (7, 40)):
        pairs = rng.integers(0, 9, (size, size)) * (rng.random((size, size)) < 0.15)
        pairs[np.arange(1, size, 3), np.arange(1, size, 3)] += 2
        cls = np.concatenate([[0], rng.integers(1, classes, size - 1)])
        pairs[0, 1:] += 1
        hot = np.eye(classes)[cls]
        right, left = pairs @ hot, pairs.T @ hot
        every = np.arange(1, size)
        want = brown_lm.exchange(right, left, np.diag(pairs).astype(float), cls, every)[1:]
        rows = [np.concatenate([left[u], right[u], [pairs[u, u]]]) for u in every]
        codes = [np.flatnonzero(x) for x in rows]
        got = brown_lm.place(np.array([len(c) for c in codes]), np.concatenate(codes), np.concatenate([x[c] for x, c in zip(rows, codes, strict=True)]), cls[1:], brown_lm.bigrams(right, cls))
        assert (got == want).all() and (got != cls[1:]).any()


def test_profiles_count_the_classes_of_neighbours(spark):
    """Classes before and after each word beyond the units, and words after themselves, against a plain count."""
    rows = odd_rows()
    units = {w: 1 + i for i, w in enumerate((b"the", b"of", b"lang"))}
    forms = {b"ord": 4, b"ter": 5}
    classes, of = 4, np.array([0, 1, 2, 3, 1, 2, 3])
    code = lambda w: 0 if w == b"" else units.get(w, forms.get(w[-3:], 6))
    want = collections.Counter()
    for r in rows:
        w = [b"", *words(r[1]), b""]
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            if code(b) > 3:
                h = int(brown_lm.hashes_of([b])[0].view(np.int64)[0])
                want.update([(h, of[code(b)], of[code(a)]), (h, of[code(b)], classes + of[code(c)])] + [(h, of[code(b)], 2 * classes)] * (b == c))
    got = brown_lm.profiles(frame(spark).select(F.coalesce("text", F.lit("")).alias("text")), units, forms, of, classes, buffer=50)
    assert {(r["h"], r["present"], r["code"]): r["n"] for r in got.collect()} == dict(want)


def test_brown_without_training_rows_and_empty(spark):
    one = frame(spark).withColumn("text", F.lit("a b"))
    got = brown_lm.score(one, F.lit(True), SMALL).first()
    assert got["train_tokens"] == 0 and got["n_known"] == 0 and got["base_score"] == 0
    assert brown_lm.score(empty(spark), F.lit(False), SMALL).count() == 0


def test_language_id(spark):
    docs = frame(spark)
    got = language_id.identify(docs, docs.where(fold("doc_id", 4) != 2)).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], r[2]) for r in rows[:60])
    assert sum(want[(r["doc_id"], r["lang_pred"])] > 0 for r in got) >= 60
    for r in got:
        assert 0 <= r["score"] <= 1
    nothing = {r["doc_id"]: r for r in got if r["doc_id"] in (100, 101, 102, 107)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in nothing.values())
    assert {r["lang_pred"] for r in language_id.identify(docs, empty(spark)).collect()} == {"und"}
    assert language_id.identify(empty(spark), docs).count() == 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_classifier_learns_and_takes_odd_rows(spark):
    junk = [(1000 + i, " | ".join(f"x{i + j}### %%%" for j in range(80)), "en", "src0", 0, *(["x"] * 10)) for i in range(30)]
    docs = frame(spark, odd_rows() + junk)
    marks = labels(spark, [(i, 1, 0) for i in range(40)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 0, 0), (41, 0, 0), (41, 1, 0), (42, None, 0)])
    got = quality_classifier.classify(docs, docs, marks, sample=20).collect()
    assert len(got) == len(odd_rows()) + 30 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] and r["doc_id"] >= 1020)
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in range(43, 60))
    kept = quality_classifier.filter_documents(docs, docs, marks, sample=20)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1020").count() == 0 and kept.where("doc_id between 43 and 59").count() == 17
    assert {r["score"] for r in quality_classifier.classify(docs, docs, labels(spark, [])).collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), empty(spark), marks).count() == 0


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    model = quality_classifier.Model(np.eye(8), v, (np.arange(50) % 2).astype(float), 7, 4.0)
    x = rng.standard_normal((9, 8))
    for row, got in zip(x, quality_classifier.votes(x, model), strict=True):
        sims = v @ (row / np.linalg.norm(row))
        top = np.flatnonzero(sims >= np.sort(sims)[-7] - quality_classifier.TIE)
        w = np.maximum(sims[top], 1e-6) ** 4
        assert math.isclose(got, (w * model.labels[top]).sum() / w.sum(), abs_tol=1e-6)


def plain_counts(text):
    w = text.encode().split()
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] >= 2 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_rules_counts(spark):
    rows = odd_rows() + [(200 + i, t, "en", "s", 0, *(["x"] * 10)) for i, t in enumerate(["a b c a b c a", "x\nx\n \ny\nx\n", "#é $% <b>|", "a b\x0bc\x0cd\r\ne", "one two"])]
    got = quality_rules.measure(frame(spark, rows)).collect()
    names = quality_rules.COUNTS[:5]
    assert by_row((r["doc_id"], *(r[c] for c in names)) for r in got) == by_row((r[0], *plain_counts(r[1] or "")) for r in rows)


def test_quality_rules_certify_only_what_labels_show(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 0, *(["x"] * 10)) for i in range(2500)]
    bad = [(5000 + i, " ".join(f"w{i}$$ x{j}%%" for j in range(40)), "en", "s", 0, *(["x"] * 10)) for i in range(300)]
    few = [(9000 + i, " ".join(f"v{i}$$ x{j}%%" for j in range(40)), "fr", "s", 0, *(["x"] * 10)) for i in range(5)]
    docs = frame(spark, good + bad + few + odd_rows())
    marks = labels(spark, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad[:200] + few])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, marks).where("doc_id >= 5000").collect()}
    assert all(not got[r[0]]["kept"] and got[r[0]]["broken_rules"] == ["symbols"] for r in bad)
    assert all(got[r[0]]["kept"] for r in few)  # nothing can be certified on five rows
    kept = quality_rules.filter_documents(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id between 1000 and 2499").count() == 1500
    assert quality_rules.quality_rules(empty(spark), marks).count() == 0
    assert quality_rules.quality_rules(docs, labels(spark, [])).where("not base_failed and not kept").count() == 0


def test_quality_rules_verdict_equals_a_plain_version(spark):
    """Halves, cutoffs, order, tests and verdicts of every row, computed without Spark."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang = ("en", "de", None)[i % 3]
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(45, 90))]
        bad = rng.random() < 0.2
        if bad or rng.random() < 0.02:
            w = [x + rng.choice(("$", "", "##")) for x in w]
        if bad and rng.random() < 0.5:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w), lang, "s", 0, *(["x"] * 10)))
    rows += [(900 + i, *rows[i % 40][1:]) for i in range(600)]  # copies count once, contradicting ones not at all
    marks = {r[0]: int(not any(c in r[1] for c in "$#")) if rng.random() < 0.97 else 1 for r in rows if r[0] % 7}
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels(spark, [(k, q, 0) for k, q in marks.items()])).collect()}
    counts, text = {r[0]: quality_rules.count(r[1].encode()) for r in rows}, {r[0]: r[1] for r in rows}

    def ratios(c):
        n, chars, symbols, dup, repeat, lines, upper = c
        return {"symbols": symbols / n, "dup_lines": dup / max(lines, 1), "repeats": repeat / n, "upper": upper / max(chars, 1), "word_length": chars / n}

    def passes(c):
        return c[0] >= 50 and 100 * c[4] <= 50 * c[0]

    want, certified = {}, 0
    strata = {r[2] for r in rows}
    for lang in strata:
        own = [r[0] for r in rows if r[2] == lang]
        labelled: dict[str, set] = {}
        for i in own:
            if i in marks and passes(counts[i]):
                labelled.setdefault(text[i], set()).add(marks[i])
        halves = [[(ratios(quality_rules.count(t.encode())), *q) for t, q in labelled.items() if len(q) == 1 and xxhash.xxh64_intdigest(t, seed=42) % 2 == h] for h in (0, 1)]
        clean, bad = (max(1, sum(q == v for _, q in halves[0])) for v in (1, 0))
        best = {}
        for at, (rule, (_, cutoffs)) in enumerate(quality_rules.RULES.items()):
            for c in cutoffs:
                gain = sum(x[rule] > c and q == 0 for x, q in halves[0]) / bad - 10 * sum(x[rule] > c and q == 1 for x, q in halves[0]) / clean
                if gain > best.get(rule, (0,))[0]:
                    best[rule] = (gain, -at, c)
        stay = []
        for rule in sorted(best, key=lambda r: best[r][:2], reverse=True):
            n = sum(q for _, q in halves[1])
            k = sum(q and any(x[r] > best[r][2] for r in [*stay, rule]) for x, q in halves[1])
            if sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) > 0.05 / len(strata):
                break
            stay.append(rule)
        certified += len(stay)
        for i in own:
            want[i] = passes(counts[i]) and not any(ratios(counts[i])[r] > best[r][2] for r in stay)
    assert got == want and certified >= 3 and any(passes(counts[i]) and not k for i, k in want.items())


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.01), (10, 10, 0.5)):
        assert math.isclose(quality_rules.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_quality_classifier_learns_ids_that_repeat(spark):
    """The sample is of ids: forty bad ids of 500 rows each are all learned, beside more clean ones than the sample takes."""
    rows = [(i, "clean") for i in range(2000)] + [(10_000 + i % 40, f"bad {i % 3}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_classifier.fit(docs, labels(spark, [(i, int(i < 10_000), 0) for i in [*range(2000), *range(10_000, 10_040)]]))
    assert collections.Counter(model.labels) == {1.0: 1500, 0.0: 40}


def test_words_of_a_batch_are_looked_up_together(spark, monkeypatch):
    """Each word gets the code that ``_Codes`` gives it, in one look-up for all texts of a batch, whatever its bucket."""
    calls, look = [], brown_lm._Lookup.__call__
    monkeypatch.setattr(brown_lm._Lookup, "__call__", lambda self, *a: calls.append(1) or look(self, *a))
    head, forms = {f"w{i}".encode(): i for i in range(3000)}, {b"w7": 3000, b"123": 3001, b"z": 3002}
    model = brown_lm.Model(head, forms, np.log10(np.arange(3000) + 1.1), np.arange(3003 + 1) % 63 + 1, np.zeros(64), 1.0, 5, 9)
    rows = [" ".join(f"W{i * j}" for j in range(i % 7)) + " z x123 y" * (i % 3) for i in range(400)]
    out = brown_lm._parts(spark, model).func(pa.array(rows))
    codes = brown_lm._Codes(head, forms, 3003)
    assert out.field("cls").to_pylist() == [bytes(int(model.cls[codes[w]]) for w in words(x)) for x in rows]
    assert out.field("n_tokens").to_pylist() == [len(words(x)) + 1 for x in rows] and len(calls) == 1
    assert brown_lm._parts(spark, model).func(pa.array([], pa.string())).to_pylist() == []
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 50, 500).astype(np.uint64))  # all in one bucket
    at, found = brown_lm._Places(h)(np.concatenate([h, h + np.uint64(1)]))
    assert (at[:500] == np.arange(500)).all() and (found == np.isin(np.concatenate([h, h + np.uint64(1)]), h)).all()
    assert not brown_lm._Places(h[:0])(h)[1].any()
