"""The corpus pipeline on the smallest tables, on odd rows and on empty tables."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexispark.llm import components, decontamination, jaccard_join, quality_classifier, quality_rules
from lexispark.llm.common import Scratch

from .helpers import empty, frame, words
from .test_exact import brute_components, near_copies

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    """Whether a text has 80 % of the five-word shingles of an item or of its question (its last sentence is the answer)."""
    doc = words(text)

    def share(own):
        n = min(5, len(own))
        cut = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return len(cut(own) & cut(doc)) / len(cut(own))

    for item in items:
        w, cut = decontamination._split((item or "").encode())
        q, a = w[:cut], w[cut:]
        if w and (share(w) >= 0.8 or (len(q) >= 5 and share(q) >= 0.8) or (len(q) < 5 <= len(a) and share(a) >= 0.8 and share(q) == 1)):
            return True
    return False


def check(spark, sf):
    """Every stage by a plain version or its operator's verdicts; rows are told apart by doc_id and text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, columns = spark.read.parquet(f"{sf}/labels.parquet"), docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()), key=repr)

    def scored(d):
        score = quality_classifier.scorer(spark, quality_classifier.fit(d, labels))
        return d.select("doc_id", "text").withColumn("s", score("text")).where("s >= 0.3")

    def ruled(d):
        measured = quality_rules.measure(d)
        cut = quality_rules.calibrate(measured, labels)
        own = d.select("doc_id", "text", "lang", quality_rules.metrics(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", "text", "lang", "c.*")
        return quality_rules.verdict(own, cut).where("kept")

    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns, name
        had, got = rows(docs), rows(out)
        if i < 2:
            assert got == rows((scored, ruled)[i](docs)), name
        elif i == 2:
            named, group = brute_components(had)
            least = {g: c for (_, _, c), g in zip(named, group, strict=True)}
            assert len(got) == len(least) and sorted((r[0] for r in got if r[0] is not None)) == sorted(c for g, c in least.items() if c is not None), name
        else:
            assert got == [r for r in had if not contaminated(r[1], items)], name
        docs = out
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert sorted((r["doc_id"] for r in packed.where("piece = 0").collect()), key=repr) == sorted((r[0] for r in rows(docs)), key=repr)
    return packed


def test_stages_filter_rows_and_pass_columns(spark):
    packed = check(spark, SF)
    order = ["doc_id", "piece"]
    assert [r["ids_crc32"] for r in corpus_pipeline.run(spark, SF).orderBy(*order).collect()] == [r["ids_crc32"] for r in packed.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, null, empty and very long texts, copies, clashing columns, repeated labels and items."""
    sf = str(tmp_path_factory.mktemp("odd"))
    text = next(r[1] for r in near_copies(2) if r[0] == 1110)
    rows = near_copies(2) + [(5000, "before " + "q w e r t y u i o p " * 2 + text, "en", "s", 0, *(["x"] * 10))]
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0, "x") for i in range(60)] + [(None, 0, 0, "x"), (3, 1, 0, "x"), (4, 0, 1, "x"), (5, None, None, None)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "q w e r t y u i o p q w e r. t y"), (1, "q w e r t y u i o p q w e r. t y"), (2, None), (None, ""), (3, text)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages_take_odd_rows(spark, odd):
    assert check(spark, odd).count() > 0


def test_empty_tables(spark, odd, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_label_rounds_are_written(spark):
    """The driver plans one star at a time: the plan of what is returned doesn't grow with the rounds, and no marker is written."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "a long, b long")
    with Scratch(spark, "test") as scratch:
        out = components.labels(edges, scratch, "labels")
        assert {r["id"]: r["root"] for r in out.collect()} == {2: 1, 3: 1, 4: 1, 9: 8}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan
        written = out.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert not os.path.exists(f"{written}/_SUCCESS")


def test_a_join_does_not_write_a_file_for_each_partition_of_its_shuffles(spark, monkeypatch):
    files, write = {}, Scratch._write

    def counted(self, df, name, compression=None):
        path, out = write(self, df, name, compression)
        files[name] = len(out.inputFiles())
        return path, out

    rows = [(i, " ".join(f"w{i // 3}_{j}" for j in range(40)) + " end" * (i % 3), "en", "s", 0, *["x"] * 10) for i in range(600)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(Scratch, "_write", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(r["doc_id"] for r in jaccard_join.filter_documents(frame(spark, rows)).select("doc_id").collect()) == list(range(0, 600, 3))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 20 and max(files.values()) <= max(spark.sparkContext.defaultParallelism, 64 // 16) * 2, files
