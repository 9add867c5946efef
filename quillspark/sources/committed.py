"""Tables whose parts show only once they are committed.

A part's rows go to a folder of their own attempt. When it is complete, the manifest that names the attempts is replaced as a
whole: this is the commit, and the last thing that happens. Readers follow the manifest, so what a writer that was killed
left behind is never seen; the next run writes that part again and leaves parts alone that are there. One writer at a
time commits to a table; a manifest that another has replaced meanwhile is an error. Manifests hold a line a part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillspark.session import remove
from quillspark.sources.files import read_text, replace_text

MANIFEST = "_manifest.json"


def manifest(path: str) -> dict:
    """{"version", "schema", "parts": {name: {"folder", "rows"}}}; version 0: nothing was committed yet."""
    held = read_text(f"{path}/{MANIFEST}")
    return json.loads(held) if held else {"version": 0, "schema": None, "parts": {}}


def attempt(df: DataFrame, path: str, part: str) -> str:
    """Writes a part's rows to the folder of a new attempt, which nobody reads yet."""
    folder = f"attempts/{part}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, part: str, folder: str, seen: dict) -> dict:
    """Names the attempt as the part's content; seen: the manifest that the writer knows. Returns the new one."""
    now = manifest(path)
    if now["version"] != seen["version"]:
        raise RuntimeError(f"another writer has committed to {path}")
    held = spark.read.parquet(f"{path}/{folder}")
    schema = now["schema"] or json.loads(held.schema.json())
    if StructType.fromJson(schema) != held.schema:
        raise ValueError(f"part {part} has other columns than {path}")
    now["parts"][part] = {"folder": folder, "rows": held.count()}
    now |= {"version": now["version"] + 1, "schema": schema}
    replace_text(f"{path}/{MANIFEST}", json.dumps(now, sort_keys=True))
    return now


def write_parts(spark: SparkSession, path: str, parts: Iterable[tuple[str, Callable[[], DataFrame]]]) -> list[str]:
    """Writes and commits the parts (name, rows) that are not there yet; their names."""
    seen, done = manifest(path), []
    for name, rows in parts:
        if name not in seen["parts"]:
            seen = commit(spark, path, name, attempt(rows(), path, name), seen)
            done.append(name)
    return done


def read(spark: SparkSession, path: str) -> DataFrame:
    """The committed parts."""
    held = manifest(path)
    if not held["version"]:
        raise FileNotFoundError(f"nothing was committed to {path}")
    return spark.read.schema(StructType.fromJson(held["schema"])).parquet(*(f"{path}/{p['folder']}" for p in held["parts"].values()))


def sweep(spark: SparkSession, path: str) -> int:
    """Removes the attempts that no manifest names, when no writer is at work; their number."""
    held = {p["folder"] for p in manifest(path)["parts"].values()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/attempts")
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    lost = [f"attempts/{s.getPath().getName()}" for s in (system.listStatus(at) if system.exists(at) else [])]
    lost = [x for x in lost if x not in held]
    for x in lost:
        remove(spark, f"{path}/{x}")
    return len(lost)
