"""Token rows: hashing, padding, pad remapping, vocabulary lookup, differences, stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.operators.records import small

BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column, most: int | None = None) -> Column:
    """Words of a text, the first `most` if given: the rest of the text is not cut up then."""
    pieces = F.split(F.coalesce(text, F.lit("")), BLANK, -1 if most is None else most + 2)  # blanks in front give an empty piece
    found = F.filter(pieces, lambda w: w != "")
    return found if most is None else F.slice(found, 1, most)


def hashed_ids(docs: DataFrame, vocab: int, most: int | None = None) -> DataFrame:
    """(doc_id, ids): each word's id in 1..vocab by its digest, of the first `most` words if given; 0 is left for padding."""
    return docs.select("doc_id", F.transform(words(F.col("text"), most), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % vocab + 1).cast("int")).alias("ids"))


def padded(df: DataFrame, size: int, pad: int = 0) -> DataFrame:
    """(doc_id, token_ids of the given size, length); the mask is pos < length."""
    n = F.least(F.size("ids"), F.lit(size))
    return df.select("doc_id", F.concat(F.slice("ids", 1, size), F.array_repeat(F.lit(pad), F.lit(size) - n)).alias("token_ids"), n.alias("length"))


def remapped(df: DataFrame, size: int, pad_id: int) -> DataFrame:
    """Cut to size; positions beyond the length get the true pad id."""
    n = F.least(F.col("length"), F.lit(size))
    ids = F.transform(F.slice("token_ids", 1, size), lambda x, i: F.when(i < n, x).otherwise(F.lit(pad_id)))
    return df.select("doc_id", ids.alias("token_ids"), n.alias("length"))


def embedded(df: DataFrame, vocab: DataFrame, dim: int) -> DataFrame:
    """(doc_id, pos, unit): each token's vocabulary vector, cut to dim, then of norm 1."""
    table = small(vocab.select("token_id", vec.truncate(F.col("vec"), dim).alias("unit")))
    rows = df.select("doc_id", "length", F.posexplode("token_ids").alias("pos", "token_id")).filter("pos < length")
    return rows.join(table, "token_id").select("doc_id", "pos", "unit")


def difference(a: Column, b: Column) -> Column:
    """Positions that differ over the shorter length, plus the difference in length."""
    n = F.least(F.size(a), F.size(b))
    differ = F.size(F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), lambda d: d))
    return (differ + F.abs(F.size(a) - F.size(b))).cast("bigint")


def best_attempt(df: DataFrame, group: str, trial: str, score: str) -> DataFrame:
    """The trial of least score a group, the latest of equal ones, not looking past the first exact hit."""
    exact = df.groupBy(group).agg(F.min(F.when(F.col(score) == 0, F.col(trial))).alias("_hit"))
    live = df.join(exact, group).filter(F.col("_hit").isNull() | (F.col(trial) <= F.col("_hit")))
    return live.groupBy(group).agg(F.min_by(F.col(trial), F.struct(F.col(score), -F.col(trial))).alias(trial), F.min(score).alias(score))


def strip_thinking(text: Column) -> Column:
    """What follows the last closing think tag, without quotes and blanks around it."""
    return F.regexp_replace(F.substring_index(text, "</think>", -1), r"^[\s\"']+|[\s\"']+$", "")
