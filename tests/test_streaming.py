"""Totals as a stream: keyed state, changed rows by version, compaction."""

import pytest

from lexispark.operators import corpus
from lexispark.schema import CORPUS
from lexispark.streaming import incremental

BATCHES = [[("a", 1999, 1, 1), ("b", 1999, 2, 1), ("a", 1999, 1, 0)], [("a", 1999, 4, 2), ("a", 2000, 1, 1)], [("c", 2001, 9, 9)]]


@pytest.fixture
def run(spark, tmp_path):
    folders = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]

    def go(rows):
        spark.createDataFrame(rows, CORPUS).coalesce(1).write.mode("append").parquet(folders[0])
        stream = spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", 1).parquet(folders[0])
        query = incremental.run_stream(stream, folders[1], folders[2])
        query.awaitTermination(180)
        return query.exception()

    go.out = folders[1]
    return go


def rows_of(df):
    return sorted(map(tuple, df.select("ngram", "year", "freq", "doc").collect()))


def whole(spark, n):
    return rows_of(corpus.consolidate(spark.createDataFrame([r for b in BATCHES[:n] for r in b], CORPUS)))


def test_stream_equals_batch_and_writes_what_changed(spark, run):
    for i, rows in enumerate(BATCHES):
        assert run(rows) is None
        assert rows_of(incremental.current(spark, run.out)) == whole(spark, i + 1)
    assert [spark.read.parquet(f"{run.out}/changes/v={v}").count() for v in range(3)] == [2, 2, 1]


def test_a_query_that_fails_goes_on_where_it_was(spark, run, monkeypatch):
    assert run(BATCHES[0]) is None
    from pyspark.sql import DataFrameWriter

    write = DataFrameWriter.parquet

    def fails_after(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        if path.endswith("v=1"):
            raise RuntimeError("the driver stops here")

    monkeypatch.setattr(DataFrameWriter, "parquet", fails_after)
    with pytest.raises(Exception, match="stops here"):
        run(BATCHES[1])
    monkeypatch.undo()
    assert run(BATCHES[2]) is None
    assert rows_of(incremental.current(spark, run.out)) == whole(spark, 3)


def test_compaction_keeps_the_table_and_drops_versions(spark, run):
    assert run(BATCHES[0]) is None and run(BATCHES[1]) is None
    before = rows_of(incremental.current(spark, run.out))
    assert incremental.compact(spark, run.out) == 1 and incremental.versions(spark, run.out) == (1, [])
    assert rows_of(incremental.current(spark, run.out)) == before
    assert incremental.compact(spark, run.out) == 1
    assert run(BATCHES[2]) is None
    assert incremental.versions(spark, run.out) == (1, [2])
    assert rows_of(incremental.current(spark, run.out)) == whole(spark, 3)


def test_no_table_yet(spark, tmp_path):
    assert incremental.current(spark, str(tmp_path / "none")).count() == 0
    assert incremental.compact(spark, str(tmp_path / "none")) == -1
