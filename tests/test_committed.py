"""Commit-last tables: what was not committed does not show, and a second run completes."""

import json
import os

import pytest

from quillspark.sources import committed, files


def test_a_killed_writer_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        committed.read(spark, path)
    rows = lambda k: lambda: spark.range(10 * k, 10 * k + 10)
    parts = [(f"p{k}", rows(k)) for k in range(4)]
    calls = {"n": 0}
    honest = committed.replace_text

    def killed(*args):
        calls["n"] += 1
        if calls["n"] == 3:
            raise KeyboardInterrupt("killed between rows and commit")
        honest(*args)

    monkeypatch.setattr(committed, "replace_text", killed)
    with pytest.raises(KeyboardInterrupt):
        committed.write_parts(spark, path, parts)
    assert sorted(r["id"] for r in committed.read(spark, path).collect()) == list(range(20))
    assert len(os.listdir(f"{path}/attempts")) == 3
    assert committed.write_parts(spark, path, parts) == ["p2", "p3"]
    assert sorted(r["id"] for r in committed.read(spark, path).collect()) == list(range(40))
    assert committed.write_parts(spark, path, parts) == [] and committed.sweep(spark, path) == 1 and committed.sweep(spark, path) == 0
    assert committed.read(spark, path).count() == 40


def test_a_manifest_is_whole_or_old(tmp_path, monkeypatch):
    path = str(tmp_path / "m.json")
    files.replace_text(path, json.dumps({"a": 1}))

    class Full:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def move(self, *_):
            raise OSError("killed before the move")

    honest = files.located
    monkeypatch.setattr(files, "located", lambda p: (Full(honest(p)[0]), honest(p)[1]))
    with pytest.raises(OSError):
        files.replace_text(path, json.dumps({"a": 2}))
    assert json.loads(files.read_text(path)) == {"a": 1} and files.read_text(str(tmp_path / "none")) is None


def test_writers_and_columns_are_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = committed.manifest(path)
    first = committed.attempt(spark.range(3), path, "a")
    committed.commit(spark, path, "a", first, seen)
    with pytest.raises(RuntimeError, match="another writer"):
        committed.commit(spark, path, "b", committed.attempt(spark.range(3), path, "b"), seen)
    with pytest.raises(ValueError, match="other columns"):
        committed.write_parts(spark, path, [("c", lambda: spark.range(3).selectExpr("id as x"))])
    assert committed.read(spark, path).count() == 3
    committed.write_parts(spark, path, [("empty", lambda: spark.range(0))])
    assert committed.manifest(path)["parts"]["empty"]["rows"] == 0 and committed.read(spark, path).count() == 3
