"""Readers: MatrixMarket, line lists, delimited metadata, archives, shards, manifests, result files."""

from __future__ import annotations

import csv
import json
import os
import tarfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of image members, and the kinds of files that make up a shard.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
SHARD_FILES = ("latents", "filled", "text", "logvar", "dino", "dino_filled", "gtext", "gtext_filled", "token_emb", "token_ids", "token_mask", "token_lengths", "token_filled")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), 0-based, of a coordinate file or folder of parts (gz is read through).

    Comments go, and so does the size line: the first entry of each file that has a banner."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).withColumn("_line", F.monotonically_increasing_id())
    banner = lines.filter(F.col("value").startswith("%%")).select("_file").distinct()
    if not banner.limit(1).count():
        raise ValueError(f"{path} has no MatrixMarket banner")
    entries = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = entries.join(F.broadcast(banner), "_file").groupBy("_file").agg(F.min("_line").alias("_size"))  # a row a file with a banner
    body = entries.join(F.broadcast(size.select("_size")), F.col("_line") == F.col("_size"), "left_anti").withColumn("p", F.split(F.trim("value"), r"\s+"))
    value = F.when(F.size("p") > 2, F.element_at("p", 3).cast("double")).otherwise(F.lit(1.0))
    return body.select((F.element_at("p", 1).cast("bigint") - 1).alias("row"), (F.element_at("p", 2).cast("int") - 1).alias("col"), value.alias("value"))


def line_list(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """(idx, name) of the stripped, non-blank lines of one file, in order."""
    from quillspark.operators.indexing import dense_index

    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).select("_at", F.trim("value").alias(name)).filter(F.col(name) != "")
    return dense_index(lines, "_at", "idx").select("idx", name)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header: tabs, or the sniffed delimiter if that gives one column; names stripped."""
    read = lambda sep: spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path)
    df = read("\t")
    if len(df.columns) == 1:
        head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
        df = read(csv.Sniffer().sniff(head).delimiter)
    return df.toDF(*[c.strip() for c in df.columns])


def resolve(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """First candidate that is a column, by exact name before any by case-insensitive name."""
    for c in candidates:
        if c in columns:
            return c
    folded = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in folded:
            return folded[c.lower()]
    if required:
        raise KeyError(f"none of {candidates} in {columns}")
    return None


def _members(archive: tarfile.TarFile):
    """(name, bytes) of an archive's files; one that breaks off raises ValueError."""
    try:
        while (member := archive.next()) is not None:
            archive.members.clear()  # a stream never goes back; the list of headers would grow with the archive
            if member.isfile():
                yield member.name, archive.extractfile(member).read()
    except (tarfile.TarError, EOFError, zlib.error) as broken:
        raise ValueError(f"broken off: {broken}") from broken


def pair_members(stream):
    """(key, caption_type, caption, image) of an archive's json and image members that share a key.

    A key is the name without its known last extension. Broken json gives a record of nulls; members without a partner go.
    The archive is read as a stream: only members that wait for their partner are in memory. A file that is no archive, or
    one that breaks off, raises ValueError, the latter after the records before the break.
    """
    texts, images = {}, {}
    try:
        archive = tarfile.open(fileobj=stream, mode="r|*")
    except tarfile.TarError as broken:
        raise ValueError(f"no archive: {broken}") from broken
    with archive:
        for name, data in _members(archive):
            if name.endswith(".json"):
                key = name[: -len(".json")]
                try:
                    x = json.loads(data)
                    texts[key] = (x.get("key"), x.get("caption_type"), (x.get("caption") or "").strip()) if isinstance(x, dict) else (None,) * 3
                except (ValueError, AttributeError):
                    texts[key] = (None,) * 3
            else:
                suffix = next((s for s in IMAGE_SUFFIXES if name.lower().endswith(s)), None)
                if suffix:
                    images[name[: -len(suffix)]] = data
            key = name.rsplit(".", 1)[0]
            if key in texts and key in images:
                yield (*texts.pop(key), images.pop(key))


def _named_errors(path: str, records):
    try:
        yield from records
    except ValueError as broken:
        raise ValueError(f"{path}: {broken}") from broken


def archive_files(spark: SparkSession, path: str, splits: list[str] | None = None) -> list[str]:
    """All *.tar below path whose names hold any of the splits, in order; empty files too, which Spark's own listing leaves out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, names = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(at, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".tar") and (not splits or any(s in name for s in splits)):
            names.append(name)
    return sorted(names)


def archives(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """(path, key, caption_type, caption, image) of all *.tar below path whose names hold any of the splits.

    The driver lists the files' names; each file is opened where its task runs (local and shared folders, HDFS, S3) and streamed, so
    an archive may be larger than a task's memory. One that can't be read raises.
    """
    schema = pa.schema([("path", pa.string()), ("key", pa.string()), ("caption_type", pa.string()), ("caption", pa.string()), ("image", pa.binary())])

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    for record in _named_errors(path, pair_members(stream)):
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, *record), schema)], schema=schema)

    names = archive_files(spark, path, splits)
    if not names:
        raise FileNotFoundError(f"no archive below {path}")
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names))
    return files.mapInArrow(read, "path string, key string, caption_type string, caption string, image binary")


def discover_shards(files: DataFrame, table_mode: bool = True) -> DataFrame:
    """Shards in a listing (path): shard_id, and the paths of its latents, filled map and optional sidecars.

    A shard counts with latents and a filled map. A sidecar that has a map of its own is there only with it; tokens are
    there with ids, mask, lengths and filled map, and with embeddings unless those come from a table.
    """
    name = F.substring_index("path", "/", -1)
    kinds = list(SHARD_FILES)
    known = files.select("path", F.regexp_extract(name, r"^([a-z_]+)_\d+\.", 1).alias("kind"), F.regexp_extract(name, r"_(\d+)\.", 1).try_cast("int").alias("shard_id"))
    by = known.filter(F.col("kind").isin(*kinds) & F.col("shard_id").isNotNull()).groupBy("shard_id").pivot("kind", kinds).agg(F.min("path"))
    for side in ("dino", "gtext"):
        whole = F.col(side).isNotNull() & F.col(f"{side}_filled").isNotNull()
        by = by.withColumn(side, F.when(whole, F.col(side)))
        by = by.withColumn(f"{side}_filled", F.when(F.col(side).isNotNull(), F.col(f"{side}_filled")))
    whole = F.lit(True)
    for k in kinds:
        if k.startswith("token_") and not (table_mode and k == "token_emb"):
            whole = whole & F.col(k).isNotNull()
    return by.filter("latents is not null and filled is not null").withColumn("has_tokens", whole)


def cached_result(files: DataFrame, step: int | None = None) -> int:
    """The step of a cached evaluation in a listing (path): the last tensor file by name, or the one asked for, with its metrics."""
    name = F.substring_index("path", "/", -1)
    kept = files.select(F.regexp_extract(name, r"^(eval_tensors|metrics)_\d+\.", 1).alias("kind"), F.regexp_extract(name, r"_(\d+)\.", 1).alias("step")).filter("kind <> ''")
    if step is None:
        last = kept.filter("kind = 'eval_tensors'").agg(F.max("step")).first()[0]
        if last is None:
            raise FileNotFoundError("no cached evaluation")
        step = int(last)
    there = {r["kind"] for r in kept.filter(F.col("step").cast("bigint") == step).select("kind").distinct().collect()}
    for kind in ("eval_tensors", "metrics"):
        if kind not in there:
            raise FileNotFoundError(f"missing {kind} of step {step}")
    return step


def raw_path(root: str, dataset: str, url: str) -> str:
    """Where a downloaded file of a dataset lies; the error says how to get it."""
    path = os.path.join(root, dataset, url.rstrip("/").rsplit("/", 1)[-1])
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing; download {url} to it")
    return path


def missing_members(manifest: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Names of a frozen manifest that are not there."""
    return manifest.select(key).join(present.select(key), key, "left_anti")


def captions(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Caption by row, empty where there is none; rows whose captions disagree raise when read."""
    one = meta.groupBy(key).agg(F.min("caption").alias("caption"), F.max("caption").alias("_other"))
    one = one.withColumn("caption", F.when(F.col("caption") == F.col("_other"), F.col("caption")).otherwise(F.raise_error(F.lit("captions of one row disagree")).cast("string"))).drop("_other")
    return rows.join(one, key, "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def latest(files: DataFrame, step: Column, path: str) -> str:
    """Path of the greatest step; a tie is an error."""
    best = files.select(step.alias("step"), F.col(path).alias("path")).filter("step is not null")
    top = best.agg(F.max("step").alias("m")).first()["m"]
    if top is None:
        raise FileNotFoundError("no checkpoint")
    hits = best.filter(F.col("step") == top).limit(2).collect()
    if len(hits) > 1:
        raise ValueError(f"two checkpoints have step {top}")
    return hits[0]["path"]


def results(spark: SparkSession, path: str) -> DataFrame:
    """(fraction, metric, value) of result files {"by_fraction": {fraction: {metric: value}}}, fractions in numeric order."""
    raw = spark.read.option("multiLine", True).schema("by_fraction map<string, map<string, double>>").json(path)
    rows = raw.select(F.explode("by_fraction").alias("fraction", "m")).select(F.col("fraction").cast("double").alias("fraction"), F.explode("m").alias("metric", "value"))
    return rows.orderBy("fraction", "metric")
