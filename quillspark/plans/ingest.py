"""Ingest, archive and scan queries that run on files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.config import geometry_fits
from quillspark.operators import records
from quillspark.plans.base import query, table
from quillspark.session import scratch
from quillspark.sources import committed, layouts, readers, writers
from quillspark.streaming import archives, ingest


@query("select l_orderkey - 1 as row, (l_partkey - 1)::int as col, l_quantity as value from lineitem where l_orderkey > 0")
def matrix_market_scan(spark, sf_dir):
    path = scratch(spark)
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey > 0")
    lines = li.select(F.concat_ws(" ", "l_orderkey", "l_partkey", "l_quantity").alias("value"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("0 0 0",)], "value string").coalesce(1)
    head.write.text(path)
    lines.write.mode("append").option("compression", "gzip").text(path)
    return readers.matrix_market(spark, path)


@query("select event_type, count(*) as n from events group by event_type")
def stream_resume(spark, sf_dir):
    """Two runs over the same files: the second adds nothing."""
    base = scratch(spark)
    events = table(spark, sf_dir, "events")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    for _ in range(2):
        ingest.ingest(spark, f"{base}/in", events.schema, lambda b: b.withColumn("key", F.col("event_id").cast("string")).withColumn("reason", F.lit(None).cast("string")), f"{base}/out", f"{base}/bad", f"{base}/progress")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def manifest_missing(spark, sf_dir):
    return readers.missing_members(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select p_partkey, (round_even(w * 256.0::double / least(w, h), 0))::int as new_w, (round_even(h * 256.0::double / least(w, h), 0))::int as new_h from (select p_partkey, 300 + p_size as w, 200 + p_partkey % 300 as h from part)")
def crop_geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.lit(300) + F.col("p_size")).alias("w"), (F.lit(200) + F.col("p_partkey") % 300).alias("h"))
    g = records.crop_geometry(F.col("w"), F.col("h"), 256)
    return p.select("p_partkey", g["new_w"].alias("new_w"), g["new_h"].alias("new_h"))


def _put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder from the driver."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(inner, compression=None) as out:
        out.write(data)


@query("select row_number() over (order by n_name) - 1 as idx, n_name as line from nation")
def line_list_scan(spark, sf_dir):
    """Lines with blanks around them and empty lines between."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_name").collect()]  # 25 rows
    path = f"{scratch(spark)}/names.txt"
    _put(path, "\n\n".join(f"  {n} " for n in names).encode())
    return readers.line_list(spark, path)


@query("select n_nationkey::int as key, n_name as name, n_regionkey::int as region from nation")
def metadata_scan(spark, sf_dir):
    """A table whose delimiter is not the usual one, and columns found under another case."""
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows
    path = f"{scratch(spark)}/cells.txt"
    _put(path, "\n".join(["Key ;Nation Name; region", *(f"{r['n_nationkey']};{r['n_name']};{r['n_regionkey']}" for r in rows)]).encode())
    found = readers.metadata(spark, path)
    pick = lambda *names: F.col(f"`{readers.resolve(found.columns, list(names))}`")
    return found.select(pick("key").cast("int").alias("key"), pick("label", "NATION NAME").alias("name"), pick("Region").cast("int").alias("region"))


@query("select n_name as key, 'short' as caption_type, 'of ' || n_regionkey as caption, length(n_name)::int as bytes from nation where n_nationkey % 2 = 0")
def archive_pairs(spark, sf_dir):
    """Archives of json and image members: pairs come out, broken json gives nulls, single members and other splits nothing."""
    import io
    import json
    import tarfile

    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    base = scratch(spark)
    for split in ("train", "other"):
        data = io.BytesIO()
        with tarfile.open(fileobj=data, mode="w") as archive:
            for r in rows:
                name, members = r["n_name"], {}
                members[f"{name}.json"] = json.dumps({"key": name, "caption_type": "short", "caption": f" of {r['n_regionkey']} "}).encode() if r["n_nationkey"] % 4 != 3 else b"{broken"
                if r["n_nationkey"] % 2 == 0 or r["n_nationkey"] % 4 == 3:
                    members[f"{name}.JPG"] = name.encode()
                for member, body in members.items():
                    info = tarfile.TarInfo(member)
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))
        _put(f"{base}/{split}_0.tar", data.getvalue())
    found = readers.archives(spark, base, ["train"]).filter("key is not null")
    return found.select("key", "caption_type", "caption", F.octet_length("image").alias("bytes"))


def _pack_parts(base: str):
    """Writes the archive of each run of equal tar in batches (tar, p_partkey, p_name, p_size), a member at a time; yields the number of each."""
    import io
    import json
    import tarfile

    import pyarrow as pa

    from quillspark.sources.files import located

    def run(batches):
        n = stream = archive = None

        def close():
            archive.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["tar"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for r in batch.slice(i, 1024).to_pylist():
                    if archive is None or r["tar"] != n:
                        if archive is not None:
                            yield close()
                        n = r["tar"]
                        system, inner = located(f"{base}/{'early' if n < 3 else 'late'}-{n}.tar")
                        system.create_dir(inner.rsplit("/", 1)[0])
                        stream = system.open_output_stream(inner, compression=None)
                        archive = tarfile.open(fileobj=stream, mode="w|")
                    text = json.dumps({"key": f"p{r['p_partkey']}", "caption_type": "short", "caption": f" {r['p_name']}\n"}) if r["p_partkey"] % 5 else "{broken"
                    for name, body in ((f"p{r['p_partkey']}.json", text.encode()), (f"p{r['p_partkey']}.png", b"." * r["p_size"])):
                        info = tarfile.TarInfo(name)
                        info.size = len(body)
                        archive.addfile(info, io.BytesIO(body))
                        archive.members.clear()
        if archive is not None:
            yield close()

    return run


@query("select p_partkey % 7 as archive, 'p' || p_partkey as key, 'short' as caption_type, p_name as caption, p_size::int as bytes, p_partkey % 7 >= 3 as later from part where p_partkey % 5 <> 0")
def archive_stream(spark, sf_dir):
    """Archives of parts through the streaming source in two runs, the second after the manifest has grown; broken json goes to the ledger."""
    base = scratch(spark)
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("tar"), "p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))
    rows.repartition(7, "tar").sortWithinPartitions("tar").mapInArrow(_pack_parts(base), "tar bigint").count()
    for splits in (["early"], ["early", "late"]):
        archives.freeze(spark, base, f"{base}/manifest.txt", splits, extend=True)
        archives.ingest_archives(spark, f"{base}/manifest.txt", f"{base}/out", f"{base}/bad", f"{base}/progress", per_batch=2)
    number = F.regexp_extract("archive", r"-(\d+)\.tar$", 1).cast("bigint")
    found = spark.read.parquet(f"{base}/out")
    return found.select(number.alias("archive"), "key", "caption_type", "caption", F.octet_length("image").alias("bytes"), (F.col("batch") >= 2).alias("later"))


@query("""with r as (select (vec_id % 5) / 4.0::double as fraction, count(*)::double as rows, round(sum(embedding[1]::double), 6) + 0.0 as first from embeddings group by 1)
  select fraction, 'rows' as metric, rows as value from r union all select fraction, 'first', first from r""")
def result_files(spark, sf_dir):
    """Results by fraction of the embeddings, written as a document and read back."""
    import json

    by = table(spark, sf_dir, "embeddings").groupBy(((F.col("vec_id") % 5) / F.lit(4.0)).alias("fraction")).agg(F.count("*").cast("double").alias("rows"), (F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 6) + F.lit(0.0)).alias("first"))
    path = f"{scratch(spark)}/results.json"
    _put(path, json.dumps({"by_fraction": {str(r["fraction"]): {"rows": r["rows"], "first": r["first"]} for r in by.collect()}}, indent=1).encode())  # 5 rows
    return readers.results(spark, path)


@query("""with p as (select vec_id, (vec_id + 1) % (select count(*) from embeddings) as late, vec_id % 3 as split from embeddings)
  select p.vec_id as early_idx, round(a.embedding[1]::double, 6) + 0.0 as x0, round(b.embedding[1]::double, 6) + 0.0 as x1 from p join embeddings a on a.vec_id = p.vec_id join embeddings b on b.vec_id = p.late where split = 1""")
def pair_dataset_scan(spark, sf_dir):
    """The prepared dataset written and its test split read back with both latents."""
    e = table(spark, sf_dir, "embeddings")
    latents = e.select(F.col("vec_id").alias("compact_cell_id"), F.col("embedding").cast("array<double>").alias("latent"))
    n = e.count()
    pairs = e.select(F.col("vec_id").alias("early_idx"), F.pmod(F.col("vec_id") + 1, F.lit(n)).alias("late_idx"), (F.col("vec_id") % 3).alias("split"))
    path = scratch(spark)
    writers.prepared(latents.select("compact_cell_id"), latents, pairs, path)
    got = writers.pair_dataset(spark, path, "test")
    first = lambda c: F.round(F.get(c, F.lit(0)), 6) + F.lit(0.0)
    return got.select("early_idx", first("x_0").alias("x0"), first("x_1").alias("x1"))


@query("select doc_id // 64 as shard_id, count(*) as n, sum(doc_id % 64)::bigint as local from documents group by 1")
def sharded_write(spark, sf_dir):
    """A sharded table written and read back by its partitions."""
    path = scratch(spark)
    writers.sharded(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("shard_id").cast("bigint").alias("shard_id")).agg(F.count("*").alias("n"), F.sum("local_row").alias("local"))


@query("select doc_id % 5 as part, count(*) as n, sum(doc_id)::bigint as total from documents where doc_id is not null group by 1")
def committed_write(spark, sf_dir):
    """A writer that stopped between a part's rows and its commit shows nothing of them; the next run completes the table."""
    path, docs = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(5)).alias("part")).filter("doc_id is not null")
    parts = [(f"p{k}", lambda k=k: docs.filter(F.col("part") == k)) for k in range(5)]
    committed.write_parts(spark, path, parts[:2])
    committed.attempt(docs.filter("part = 2"), path, "p2")  # never committed
    committed.write_parts(spark, path, parts)
    return committed.read(spark, path).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@query("select d.doc_id, length(d.text)::bigint as n from documents d where d.doc_id in (select doc_id from labels where doc_id is not null)")
def addressed_rows(spark, sf_dir):
    """The labelled documents, by row number from a sharded table."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null")
    layouts.write_shards(docs, "doc_id", 64, path)
    return layouts.read_rows(spark, path, table(spark, sf_dir, "labels"), "doc_id", 64).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("select s_suppkey, s_nationkey, round(s_acctbal, 2) as s_acctbal from supplier")
def gz_table_write(spark, sf_dir):
    """A compressed delimited table, written and read back."""
    path, rows = scratch(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    writers.gz_table(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("""with t as (select coalesce(event_type, 'none') as key, count(*)::double as value from events group by 1) select key, value from t""")
def metrics_document(spark, sf_dir):
    """Metrics of all events as one document, written and read back."""
    path = scratch(spark)
    per = table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("none")).alias("key")).agg(F.count("*").cast("double").alias("value"))
    writers.document({r["key"]: r["value"] for r in per.collect()}, spark, path)  # a row a type
    return spark.read.schema("value string").text(path).select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "value"))


@query("""with p as (select p_partkey, 4 * (1 + p_partkey % 2) as channels, p_size as side, 1 + p_partkey % 4 as patch, 2 * (1 + p_partkey % 3) * (1 + p_partkey % 4) as dim from part), t as (select *, channels * side * side // dim as tokens from p)
  select p_partkey, (tokens >= 1 and side % patch = 0 and tokens * dim = channels * side * side and ((patch * patch * channels) % dim = 0 or dim % (patch * patch * channels) = 0)) as fits from t""")
def bridge_geometries(spark, sf_dir):
    """Which token layouts fold into a tensor, a layout a part."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.lit(4) * (F.lit(1) + F.col("p_partkey") % 2)).alias("channels"), F.col("p_size").cast("bigint").alias("side"), (F.lit(1) + F.col("p_partkey") % 4).alias("patch"))
    p = p.withColumn("dim", F.lit(2) * (F.lit(1) + F.col("p_partkey") % 3) * F.col("patch")).withColumn("tokens", F.expr("channels * side * side div dim"))
    return p.select("p_partkey", geometry_fits("channels", "side", "side", "patch", "tokens", "dim").alias("fits"))
