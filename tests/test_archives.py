"""Archives as a streaming source: exactly once over broken runs, failures in the ledger."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import readers
from quillspark.streaming import archives


def tar(path, members, cut=None):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as archive:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    path.write_bytes(data.getvalue()[:cut])


def pair(key, size=3):
    return [(f"{key}.json", json.dumps({"key": key, "caption_type": "t", "caption": f" {key} "}).encode()), (f"{key}.jpg", b"x" * size)]


def records(spark, path):
    return sorted((r["key"], r["caption"], r["batch"]) for r in spark.read.parquet(path).collect())


def test_a_broken_run_goes_on_with_its_archives(spark, tmp_path):
    for i in range(6):
        tar(tmp_path / f"a{i}.tar", pair(f"k{i}a") + pair(f"k{i}b"))
    at = {k: str(tmp_path / k) for k in ("manifest.txt", "out", "bad", "progress")}
    assert archives.freeze(spark, str(tmp_path), at["manifest.txt"]) == 6
    broken = {"left": 1}

    def fails_once(batch):
        if batch.filter("key = 'k3a'").count() and broken.pop("left", 0):
            return batch.withColumn("key", F.raise_error(F.lit("killed")).cast("string"))
        return batch

    run = lambda: archives.ingest_archives(spark, at["manifest.txt"], at["out"], at["bad"], at["progress"], per_batch=2, prepare=fails_once)
    with pytest.raises(Exception, match="killed"):
        run()
    assert [k for k, _, _ in records(spark, at["out"])] == ["k0a", "k0b", "k1a", "k1b"]
    run()
    want = [(f"k{i}{s}", f"k{i}{s}", i // 2) for i in range(6) for s in "ab"]
    assert records(spark, at["out"]) == want
    run()
    assert records(spark, at["out"]) == want
    tar(tmp_path / "a0b.tar", pair("k9"))  # sorts before archives that were read
    assert archives.freeze(spark, str(tmp_path), at["manifest.txt"]) == 6
    assert archives.freeze(spark, str(tmp_path), at["manifest.txt"], extend=True) == 7
    run()
    assert records(spark, at["out"]) == sorted([*want, ("k9", "k9", 3)])
    assert spark.read.parquet(at["bad"]).count() == 0


def test_unreadable_archives_go_to_the_ledger(spark, tmp_path):
    tar(tmp_path / "good.tar", pair("g"))
    tar(tmp_path / "half.tar", pair("h") + pair("lost", 5000), cut=3 * 1024 + 600)
    (tmp_path / "text.tar").write_bytes(b"this is no archive at all" * 50)
    (tmp_path / "void.tar").write_bytes(b"")
    tar(tmp_path / "json.tar", [("j.json", b"{broken"), ("j.png", b"x")])
    at = {k: str(tmp_path / k) for k in ("manifest.txt", "out", "bad", "progress")}
    archives.freeze(spark, str(tmp_path), at["manifest.txt"])
    archives.ingest_archives(spark, at["manifest.txt"], at["out"], at["bad"], at["progress"])
    assert [k for k, _, _ in records(spark, at["out"])] == ["g", "h"]
    bad = {r["key"].split("#")[0].rsplit("/", 1)[-1]: r["reason"] for r in spark.read.parquet(at["bad"]).collect()}
    assert sorted(bad) == ["half.tar", "json.tar", "text.tar", "void.tar"] and "broken off" in bad["half.tar"] and "no archive" in bad["text.tar"]


def test_a_batch_read_raises(spark, tmp_path):
    tar(tmp_path / "good.tar", pair("g"))
    assert readers.archives(spark, str(tmp_path)).count() == 1
    (tmp_path / "text.tar").write_bytes(b"this is no archive at all" * 50)
    with pytest.raises(Exception, match="text.tar: no archive"):
        readers.archives(spark, str(tmp_path)).count()


def test_a_manifest_may_only_grow(spark, tmp_path):
    for i in range(2):
        tar(tmp_path / f"a{i}.tar", pair(f"k{i}"))
    at = {k: str(tmp_path / k) for k in ("manifest.txt", "out", "bad", "progress")}
    archives.freeze(spark, str(tmp_path), at["manifest.txt"])
    run = lambda: archives.ingest_archives(spark, at["manifest.txt"], at["out"], at["bad"], at["progress"])
    run()
    (tmp_path / "manifest.txt").write_text("")
    with pytest.raises(Exception, match="only grow"):
        run()


def test_headers_of_members_do_not_stay(tmp_path):
    """Reading and writing hold no list that grows with the archive."""
    import tracemalloc

    import pyarrow as pa

    from quillspark.plans import ingest

    rows = 20_000
    batches = (pa.RecordBatch.from_pydict({"tar": [t] * 1000, "p_partkey": list(range(i, i + 1000)), "p_name": ["n"] * 1000, "p_size": [3] * 1000}) for t in (1, 4) for i in range(0, rows, 1000))
    tracemalloc.start()
    try:
        assert [b.column("tar").to_pylist() for b in ingest._pack_parts(str(tmp_path))(batches)] == [[1], [4]]
        packed = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        with open(tmp_path / "late-4.tar", "rb") as stream:
            assert sum(1 for _ in readers.pair_members(stream)) == rows
        assert packed < 4 << 20 and tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()
