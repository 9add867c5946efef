"""Archives as a streaming source whose offsets are archives of a frozen manifest.

A batch takes the next archives of the manifest, a task an archive. The engine logs a batch's offsets before it runs and its end
after the sink has it, so a run that was killed begins again with the archives of the batch that it broke off in, and
writes over what that batch had left: no record comes twice, none is lost. The manifest may grow at its end only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspark.session import attach
from quillspark.sources.files import located, read_text, replace_text
from quillspark.sources.readers import archive_files, pair_members
from quillspark.streaming.ingest import exactly_once

SCHEMA = "archive string, place int, key string, caption_type string, caption string, image binary, reason string"


class Archive(InputPartition):
    def __init__(self, place: int, path: str):
        self.place, self.path = place, path


class ArchiveReader(DataSourceStreamReader):
    """Offsets {"archives": n}: the first n lines of the manifest are read."""

    def __init__(self, options: dict):
        self.manifest, self.progress, self.step = options["manifest"], options["progress"], int(options.get("per_batch", "16"))

    def _names(self) -> list[str]:
        held = read_text(self.manifest)
        if held is None:
            raise FileNotFoundError(f"no manifest {self.manifest}")
        return held.split("\n")[:-1]

    def initialOffset(self) -> dict:
        return {"archives": 0}

    def latestOffset(self) -> dict:
        held = read_text(self.progress)
        offered, there = int(json.loads(held)["archives"]) if held else 0, len(self._names())
        if there < offered:
            raise ValueError(f"the manifest has {there} archives; {offered} were read: it may only grow")
        if getattr(self, "settled", True) and offered < there:  # the last offer has become a batch
            offered, self.settled = min(there, offered + self.step), False
            replace_text(self.progress, json.dumps({"archives": offered}))
        return {"archives": offered}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.settled = True
        names = self._names()
        return [Archive(i, names[i]) for i in range(start["archives"], end["archives"])]

    def commit(self, end: dict) -> None:
        self.settled = True

    def read(self, partition: Archive) -> Iterator[tuple]:
        """Records of an archive; what can't be read is a record with a reason. A file system that fails raises, to be tried again."""
        system, inner = located(partition.path)
        with system.open_input_stream(inner, compression=None) as stream:
            try:
                for record in pair_members(stream):
                    yield (partition.path, partition.place, *record, "no json" if record[0] is None else None)
            except ValueError as broken:
                yield (partition.path, partition.place, None, None, None, None, str(broken))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_pairs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def freeze(spark: SparkSession, path: str, manifest: str, splits: list[str] | None = None, extend: bool = False) -> int:
    """Lists the archives below path in the manifest, once and for all; extend adds those that are new at its end. Their number."""
    held = read_text(manifest)
    names = held.split("\n")[:-1] if held else []
    if held is None or extend:
        known = set(names)
        names += [n for n in archive_files(spark, path, splits) if n not in known]
        replace_text(manifest, "".join(f"{n}\n" for n in names))
    return len(names)


def ingest_archives(spark: SparkSession, manifest: str, out: str, failures: str, checkpoint: str, per_batch: int = 16, prepare=None) -> None:
    """Reads what the manifest holds and was not read yet: accepted records to out, others with archive and reason to failures."""
    attach(spark)
    spark.dataSource.register(ArchiveSource)
    stream = spark.readStream.format("archive_pairs").option("manifest", manifest).option("progress", f"{checkpoint}/offered.json").option("per_batch", str(per_batch)).load()

    def keyed(batch: DataFrame) -> DataFrame:
        found = batch.withColumn("key", F.coalesce("key", F.concat("archive", F.lit("#"), F.coalesce("caption", F.lit("")))))
        return prepare(found) if prepare else found

    query = stream.writeStream.foreachBatch(exactly_once(keyed, out, failures)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
