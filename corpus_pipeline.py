"""Corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents. Rows with null ids or texts pass the filters that can't judge
them (no score, no links, no windows).

1. toxicity      drops documents that the noisy-or model, learned from all labels, scores at 0.5 or more
2. near_dup      of each group linked at similarity 0.8 on five-word shingles only the smallest doc_id stays
3. decontaminate drops documents that hold a benchmark item's template
4. surrogates    replaces personal data by keyed surrogates (the session's key; a session without one draws its own)
5. pieces        SentencePiece ids (with end id) and the text decoded from them
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import decontaminate as _decontaminate
from quillspark.llm import near_dup as _near_dup
from quillspark.llm import piece_codec as _piece_codec
from quillspark.llm import surrogates as _surrogates
from quillspark.llm import toxicity as _toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _toxicity.reject(docs, model, 0.5)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = _near_dup.near_duplicates(docs, k=5, percent=80)
    extra = C.stage(found.filter("not kept").select(F.col("doc_id").alias("_extra")).distinct())
    side = F.broadcast(extra) if extra.count() * 16 <= _near_dup.BROADCAST_BYTES else extra
    return docs.join(side, docs["doc_id"] == side["_extra"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _surrogates.replace(docs, _surrogates.session_key(spark, draw=True))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), full=True)


STAGES = [("toxicity", toxicity), ("near_dup", near_dup), ("decontaminate", decontaminate), ("surrogates", surrogates), ("pieces", pieces)]

#: Stages of learning, sketching and merging have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's rows written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = C.scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
