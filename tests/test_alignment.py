"""Alignment from distributed sums, against whole matrices."""

import numpy as np
import pytest

from lexispark.operators import alignment


def frame(spark, rows):
    return spark.createDataFrame([(y, w, [float(x) for x in v]) for y, w, v in rows], "year int, word string, vec array<float>")


@pytest.fixture(scope="module")
def yearly():
    rng = np.random.default_rng(2)
    rows = []
    for year, n in ((1900, 40), (1910, 333), (1990, 300), (2000, 7)):
        rows += [(year, f"w{i}", v) for i, v in enumerate(rng.standard_normal((n, 6)).astype(np.float32))]
    return rows + [(1900, "alone", np.ones(6, np.float32)), (1800, "other", np.ones(6, np.float32))]


def whole(rows, year, anchor):
    ref = {w: v.astype(float) for y, w, v in rows if y == anchor}
    own = {w: v.astype(float) for y, w, v in rows if y == year and w in ref}
    a, b = np.stack([own[w] for w in own]), np.stack([ref[w] for w in own])
    u, _, vt = np.linalg.svd(a.T @ b)
    return list(own), a, b, u @ vt


@pytest.mark.parametrize("slices", [1, 3, 32])
def test_rotations_and_reports_equal_whole_matrices(spark, yearly, slices):
    df = frame(spark, yearly).repartition(5)
    got = {(r["year"], r["word"]): np.array(r["vec"]) for r in alignment.align(df, 1990, slices).collect()}
    said = {r["year"]: r for r in alignment.report(df, 1990, slices=slices).collect()}
    assert set(said) == {1900, 1910, 1990, 2000}  # 1800 shares no word
    assert len(got) == 40 + 300 + 300 + 7
    for year in said:
        words, a, b, r = whole(yearly, year, 1990)
        want = a if year == 1990 else a @ r
        assert max(np.abs(got[year, w] - want[i]).max() for i, w in enumerate(words)) < 1e-5
        x = said[year]
        assert x["shared"] == len(words) and x["norm_mean"] == pytest.approx(np.linalg.norm(a, axis=1).mean(), abs=1e-9)
        assert x["r_minus_i"] == pytest.approx(np.linalg.norm(r - np.eye(6)), abs=1e-6)
        assert x["residual_before"] == pytest.approx(np.linalg.norm(a - b), abs=1e-6)
        assert x["residual_after"] == pytest.approx(np.linalg.norm(a @ r - b), abs=2e-6)
        assert x["vocab_match"] == (year == 1990) and x["is_aligned"] == (year == 1990)


def test_a_known_rotation_is_found(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 5)).astype(np.float32)
    q = np.linalg.qr(rng.standard_normal((5, 5)))[0]
    rows = [(2000, f"w{i}", r) for i, r in enumerate(x)] + [(1900, f"w{i}", r) for i, r in enumerate(x @ q)]
    out = {r["word"]: np.array(r["vec"]) for r in alignment.align(frame(spark, rows), 2000).where("year = 1900").collect()}
    assert max(np.abs(out[f"w{i}"] - x[i]).max() for i in range(30)) < 1e-5
    said = {r["year"]: r["message"] for r in alignment.report(frame(spark, [(y, w, v + (y == 1900) * 1e-7) for y, w, v in rows[:30]] + [(1900, w, v) for _, w, v in rows[:30]]), 2000).collect()}
    assert said == {1900: "aligned", 2000: "aligned"}


def test_bad_and_no_vectors(spark):
    assert alignment.align(frame(spark, []), 2000).count() == 0
    assert alignment.report(frame(spark, [(1900, "a", [1.0])]), 2000).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        alignment.align(frame(spark, [(2000, "a", [1.0, 2.0]), (1900, "a", [1.0])]), 2000).collect()
