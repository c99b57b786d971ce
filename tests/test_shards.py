"""The source and sink of shard files."""

import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.schema import CORPUS, NESTED
from lexispark.sources import shards
from lexispark.streaming import incremental


def lz4(path, *frames):
    with open(path, "wb") as f:
        for frame in frames:
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "lz4") as out:
                out.write(frame)
            f.write(sink.getvalue().to_pybytes())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "1-00000-of-00005.gz").write_bytes(gzip.compress(b"a_X\t1999,1,1\nb_X\t1999,2,1\na_X\t1999,7,2\n") + gzip.compress(b"c_X\t2000,1,1"))
    lz4(tmp_path / "1-00001-of-00005.lz4", b"a_X\t1999,5,1\tbad\n\xff\xfe\t1999,1,1\n", "ü_X\t1999,1,1\r\n".encode())
    (tmp_path / "1-00002-of-00005.txt").write_bytes(b"")
    whole = gzip.compress(b"".join(b"d%d_X\t1999,1,1\n" % (i * 7919 % 100_003) for i in range(50_000)), 1)
    (tmp_path / "1-00003-of-00005.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "1-00004-of-00005.gz").write_bytes(b"no gzip")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    return tmp_path


def test_lines_have_numbers_and_broken_ones_come_back(spark, folder):
    df = shards.read_shards(spark, str(folder))
    assert df.rdd.getNumPartitions() == 5
    got = {}
    for r in df.collect():
        got.setdefault(r["file"][2:7], []).append(r)
    assert [(r["line"], r["value"]) for r in got["00000"]] == [(1, "a_X\t1999,1,1"), (2, "b_X\t1999,2,1"), (3, "a_X\t1999,7,2"), (4, "c_X\t2000,1,1")]
    assert [(r["line"], r["value"], bool(r["error"])) for r in got["00001"]] == [(1, "a_X\t1999,5,1\tbad", False), (2, None, True), (3, "ü_X\t1999,1,1", False)]
    assert "00002" not in got and "breaks off" in got["00003"][-1]["error"] and len(got["00003"]) > 1000
    assert [r["value"] for r in got["00004"]] == [None]


def test_last_line_wins_within_a_shard_and_shards_are_summed(spark, folder):
    none = spark.createDataFrame([], CORPUS)
    files = spark.createDataFrame([("1-00003-of-00005.gz",), ("1-00004-of-00005.gz",)], "file string")
    corpus, manifest, report = incremental.ingest_shards(spark, str(folder), files, none)
    assert sorted(map(tuple, corpus.select("ngram", "year", "freq", "doc").collect())) == [("a_X", 1999, 12, 3), ("b_X", 1999, 2, 1), ("c_X", 2000, 1, 1), ("ü_X", 1999, 1, 1)]
    assert sorted(map(tuple, report.collect())) == [("1-00000-of-00005.gz", 4, 3, 0), ("1-00001-of-00005.lz4", 2, 2, 1)]
    again, _, nothing = incremental.ingest_shards(spark, str(folder), manifest, corpus, pattern=r".*(gz|lz4)")
    assert nothing.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, corpus.select(again.columns).collect()))


def test_ranges_orders_and_single_files(folder):
    names = [x.rsplit("/")[-1][2:7] for x in shards.list_shards(str(folder), file_range=(1, 3))]
    assert names == ["00001", "00002", "00003"]
    assert sorted(shards.list_shards(str(folder), seed=1)) == shards.list_shards(str(folder)) != shards.list_shards(str(folder), seed=1)
    assert shards.list_shards(str(folder), seed=1) == shards.list_shards(str(folder), seed=1)
    with pytest.raises(ValueError, match="file range"):
        shards.list_shards(str(folder), file_range=(2, 5))
    assert shards.find_one(str(folder), r".*\.lz4").endswith("1-00001-of-00005.lz4")
    with pytest.raises(ValueError, match="3 files"):
        shards.find_one(str(folder), r".*\.gz")


@pytest.mark.parametrize("codec", ["lz4", "gzip"])
def test_round_trip_and_modes(spark, tmp_path, codec):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select(F.concat(F.lit("ngram ü "), F.col("id")).alias("ngram"), F.col("id").alias("freq_tot"), F.lit(1).cast("long").alias("doc_tot"), F.array(F.struct(F.lit(1999).alias("year"), F.col("id").alias("freq"), F.lit(1).cast("long").alias("doc"))).alias("frequencies"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, None)], NESTED))
    back = lambda: sorted(map(repr, shards.read_jsonl_shards(spark, path, NESTED).collect()))
    want = sorted(map(repr, rows.collect()))
    shards.write_jsonl_shards(rows.repartition(3), path, codec)
    assert back() == want and len(list((tmp_path / "out").glob("part-*"))) == 3
    shards.write_jsonl_shards(rows.repartition(2), path, codec)
    assert back() == want and len(list((tmp_path / "out").glob("part-*"))) == 2
    shards.write_jsonl_shards(rows.limit(10), path, codec, mode="append")
    assert len(back()) == 1011
    assert not list((tmp_path / "out").glob("_temporary*")) and (tmp_path / "out" / "_SUCCESS").exists()


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    shards.write_shards(spark.createDataFrame([("a",), (None,)], "value string"), path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    failing = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="stop"):
        shards.write_shards(failing, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    assert sorted(r["value"] for r in shards.read_shards(spark, path).collect()) == ["", "a"]
