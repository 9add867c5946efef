"""Sources, sinks and incremental ingest."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import indexing, records
from quillspark.sources import readers, writers
from quillspark.streaming import ingest


def test_matrix_market(spark, tmp_path):
    path = str(tmp_path / "m.mtx.gz")
    with gzip.open(path, "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n% note\n3 2 3\n1 1 2.5\n3 2 1\n3 2 3\n")
    assert sorted(map(tuple, readers.matrix_market(spark, path).collect())) == [(0, 0, 2.5), (2, 1, 1.0), (2, 1, 3.0)]


def test_line_list_and_metadata(spark, tmp_path):
    (tmp_path / "g.txt").write_text("b \n\n a\nc\n")
    assert [(r["idx"], r["line"]) for r in readers.line_list(spark, str(tmp_path / "g.txt")).orderBy("idx").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    (tmp_path / "m.txt").write_text("Time point; fate\n2;x\n6;y\n")
    df = readers.metadata(spark, str(tmp_path / "m.txt"))
    assert df.columns == ["Time point", "fate"] and df.count() == 2
    assert readers.resolve(df.columns, ["day", "time POINT"]) == "Time point"
    assert readers.resolve(df.columns, ["zzz"], required=False) is None
    with pytest.raises(KeyError):
        readers.resolve(df.columns, ["zzz"])


def test_archives(spark, tmp_path):
    def add(archive, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "train_0.tar", "w") as t:
        add(t, "a.b.json", json.dumps({"key": "a.b", "caption_type": "tag", "caption": " hi "}).encode())
        add(t, "a.b.jpg", b"1")
        add(t, "c.jpg", b"2")
        add(t, "c.json", b"{broken")
        add(t, "lonely.json", b"{}")
    rows = sorted(((r["key"], r["caption_type"], r["caption"], bytes(r["image"])) for r in readers.archives(spark, str(tmp_path), ["train"]).collect()), key=str)
    assert rows == [("a.b", "tag", "hi", b"1"), (None, None, None, b"2")]
    with pytest.raises(FileNotFoundError):
        readers.archives(spark, str(tmp_path), ["val"])


def test_reasons(spark):
    df = spark.createDataFrame([(None, "x", "y"), ("a", "x", "c"), ("a", "x", ""), ("a", "tag", ""), ("a", "tag", "c")], "key string, kind string, caption string")
    got = [r[0] for r in df.select(records.reason(F.col("key"), F.col("kind"), F.col("caption"))).collect()]
    assert got == ["bad_record", "bad_caption_type", "empty_caption", "empty_caption", None]


def test_prefix_percent_nests(spark):
    df = spark.createDataFrame([(s,) for s, n in ((0, 4), (1, 3), (2, 3)) for _ in range(n)], "shard int")
    want = {0: set(), 10: {0}, 40: {0}, 41: {0, 1}, 70: {0, 1}, 100: {0, 1, 2}}
    for pct, shards in want.items():
        assert {r["shard"] for r in indexing.prefix_percent(df, "shard", F.lit(True), pct).collect()} == shards


def test_crop_geometry(spark):
    g = records.crop_geometry(F.lit(300), F.lit(200), 256)
    assert spark.range(1).select(*[c.alias(k) for k, c in g.items()]).first().asDict() == {"new_w": 384, "new_h": 256, "left": 64, "top": 0}


def test_config_guard(spark, tmp_path):
    writers.guard(str(tmp_path), spark, {"preset": "sd", "batch_size": 1})
    writers.guard(str(tmp_path), spark, {"preset": "sd", "batch_size": 9})
    with pytest.raises(ValueError):
        writers.guard(str(tmp_path), spark, {"preset": "flux"})


def test_prepared_dataset(spark, tmp_path):
    latents = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "compact_cell_id long, latent array<double>")
    pairs = spark.createDataFrame([(0, 0, 1, 0), (1, 1, 0, 2)], "pair_idx long, early_idx long, late_idx long, split long")
    writers.prepared(latents.select("compact_cell_id"), latents, pairs, str(tmp_path / "p"))
    r = writers.pair_dataset(spark, str(tmp_path / "p"), "train").collect()
    assert [(x["x_0"], x["x_1"]) for x in r] == [([1.0], [2.0])]
    with pytest.raises(ValueError):
        writers.pair_dataset(spark, str(tmp_path / "p"), "test")
    with pytest.raises(KeyError):
        writers.pair_dataset(spark, str(tmp_path / "p"), "reserved")


def test_ingest_resumes(spark, tmp_path):
    schema = "key string, caption string"
    prepare = lambda b: b.withColumn("reason", records.reason(F.col("key"), F.lit("tag"), F.col("caption")))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), schema, prepare, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "at"))
    count = lambda p: spark.read.parquet(str(tmp_path / p)).count()
    spark.createDataFrame([("a", "x"), ("b", "")], schema).write.parquet(str(tmp_path / "in"))
    run()
    run()
    assert (count("out"), count("bad")) == (1, 1)
    spark.createDataFrame([("c", "y")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert (count("out"), count("bad")) == (2, 1)


def test_sidecar_fill(spark, tmp_path):
    source = spark.range(5).select(F.col("id").alias("k"))
    path = str(tmp_path / "side")
    compute = lambda d: d.withColumn("v", F.col("k") * 2)
    assert ingest.fill_sidecar(source.filter("k < 3"), path, "k", compute) == 3
    assert ingest.fill_sidecar(source, path, "k", compute) == 2
    assert ingest.fill_sidecar(source, path, "k", compute) == 0
    assert spark.read.parquet(path).count() == 5


def test_results_and_latest(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"by_fraction": {"1.0": {"m": 2.0}, "0.5": {"m": 1.0}}}))
    assert [tuple(r) for r in readers.results(spark, str(tmp_path / "r.json")).collect()] == [(0.5, "m", 1.0), (1.0, "m", 2.0)]
    files = spark.createDataFrame([("ck_10.pt",), ("ck_9.pt",)], "p string")
    step = F.nullif(F.regexp_extract("p", r"(\d+)", 1), F.lit("")).cast("int")
    assert readers.latest(files, step, "p") == "ck_10.pt"
    with pytest.raises(ValueError):
        readers.latest(files.union(files), step, "p")


def test_dense_index(spark):
    df = spark.createDataFrame([(x * 7 % 101,) for x in range(101)], "k long")
    got = indexing.dense_index(df, "k", "i", 7).collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(i, i) for i in range(101)]
    assert indexing.dense_index(df.limit(0), "k", "i").count() == 0


def test_captions(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row long")
    meta = spark.createDataFrame([(1, "a"), (1, "a")], "row long, caption string")
    assert sorted(map(tuple, readers.captions(rows, meta, "row").collect())) == [(1, "a"), (2, "")]
    with pytest.raises(Exception, match="disagree"):
        readers.captions(rows, meta.union(spark.createDataFrame([(1, "b")], meta.schema)), "row").collect()


def test_raw_files(tmp_path):
    (tmp_path / "vitro").mkdir()
    (tmp_path / "vitro" / "counts.mtx.gz").write_bytes(b"")
    url = "https://example.org/a/counts.mtx.gz/"
    assert readers.raw_path(str(tmp_path), "vitro", url).endswith("vitro/counts.mtx.gz")
    with pytest.raises(FileNotFoundError, match="download"):
        readers.raw_path(str(tmp_path), "vivo", url)


def test_cached_results(spark):
    listing = lambda *names: spark.createDataFrame([(f"/o/{n}",) for n in names], "path string")
    files = listing("eval_tensors_0000010.pt", "eval_tensors_0000200.pt", "metrics_0000200.json", "metrics_0000010.json", "eval_tensors_0000300.pt")
    assert readers.cached_result(files, 10) == 10 and readers.cached_result(files.limit(4)) == 200
    with pytest.raises(FileNotFoundError, match="metrics"):
        readers.cached_result(files)
    with pytest.raises(FileNotFoundError):
        readers.cached_result(listing("x.pt"))


def test_token_embeddings_may_come_from_a_table(spark):
    names = ["latents", "filled", "token_ids", "token_mask", "token_lengths", "token_filled", "gtext"]
    files = spark.createDataFrame([(f"/d/{n}_00007.bin",) for n in names] + [("/d/latents_00008.bin",)], "path string")
    for mode in (True, False):
        (row,) = readers.discover_shards(files, table_mode=mode).collect()
        assert row["shard_id"] == 7 and row["has_tokens"] == mode and row["gtext"] is None


def test_sharded_tables_and_documents(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("row"))
    writers.sharded(df, "row", 10, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["shard_id"], r["count"]) for r in back.groupBy("shard_id").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    assert sorted((r["row"], r["shard_id"] * 10 + r["local_row"]) for r in back.collect()) == [(i, i) for i in range(25)]
    writers.gz_table(df.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("*.csv.gz")
    assert gzip.open(part, "rt").read().split() == ["row", *map(str, range(25))]
    writers.document({"b": 2.0, "a": 1.0}, spark, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"a": 1.0, "b": 2.0}


def test_streaming_watchdog(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(30)], "t string, v double").select(F.to_timestamp("t").alias("t"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.slow_windows(stream, "t", "v", 10.0).writeStream.format("memory").queryName("slow").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["v"], r["slow"]) for r in spark.table("slow").collect()) == [(4.5, True), (14.5, False), (24.5, False)]


@pytest.mark.parametrize("short", [0, 3, 200])
def test_first_short_rows_stop_early(spark, tmp_path, short):
    from pyspark.sql import functions as F

    rows = [(i, "x" * (2 if i < short or i > 4990 else 50)) for i in range(5000)] + [(None, "x")]
    spark.createDataFrame(rows, "k long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for n in (0, 1, 4, 150):
        got = indexing.first_short(df, "k", F.length("text"), 10, n)
        want = [None, *[k for k, t in rows if k is not None and len(t) <= 10]][:n]
        assert [r["k"] for r in got.collect()] == want
        if short == 200 and n == 4:
            assert "LessThanOrEqual(k" in got._jdf.queryExecution().executedPlan().toString()
