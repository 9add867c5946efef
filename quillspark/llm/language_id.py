"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, DEPTH bytes deep. The code length of a byte is exact for frozen counts:
where the longest context was seen, a byte seen after it costs -log2(c / (n + d)) (n occurrences, d distinct
followers: escape method C) and any other escapes at -log2(d / (n + d)) to the context one byte shorter; unseen
contexts escape free of charge; below order 0 all 256 bytes are alike. A text's code length under a language is the sum
over its bytes; the shortest wins and the score is its posterior under equal priors with lengths tempered per byte.

Training takes at most about SAMPLE_DOCS documents a language (a documented bound: every document stays with the same
chance, by a hash of its text and id); with fewer, all of them. Statistics are counts of (DEPTH+1)-byte strings,
summed before they are shuffled. Every whole text is scored. A text that is null or has no letter (Unicode's classes L) is `und`
with score 0. Texts are compared with A-Z lower-cased and DEPTH leading line breaks. Ties go to the alphabetically first language.
Null languages never train; with no language to learn every text is `und`. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X

DEPTH = 3
SAMPLE_DOCS = 8_000
#: Code lengths are compared at this weight (nats of posterior for each bit of difference a text, at most).
SHARPNESS = 0.3


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH+1)-byte strings, one for each byte with its context, as numbers; and each text's bounds among them."""
    low = X.LOWER[buf]
    n = len(off) - 1
    size = len(buf) + DEPTH * n
    padded = np.full(size, 10, np.uint8)
    lengths = np.diff(off)
    begins = off[:-1] + DEPTH * np.arange(1, n + 1)
    padded[X.ragged(begins, lengths)] = low
    wide = padded.astype(np.uint32)
    grams = wide.copy()
    for k in range(1, DEPTH + 1):
        grams[k:] |= wide[:-k] << np.uint32(8 * k)
    return grams[X.ragged(begins, lengths)], off


class Ppm:
    """Frozen counts of all languages; code lengths by table for known strings, by escape for the rest."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.langs = langs
        k = len(langs)
        self.levels = []  # order 0..DEPTH: (sorted strings, cost by language), (sorted contexts, escape cost by language)
        lower = None
        for order in range(DEPTH + 1):
            key = gram & np.uint32((1 << (8 * (order + 1))) - 1)
            strings, at = np.unique(key, return_inverse=True)
            c = np.zeros((len(strings), k))
            np.add.at(c, (at, lang), count)
            contexts, up = np.unique(strings >> np.uint32(8), return_inverse=True) if order else (np.zeros(min(1, len(strings)), np.uint32), np.zeros(len(strings), np.int64))
            n, d = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(n, up, c)
            np.add.at(d, up, (c > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                own = -np.log2(c / (n + d)[up])
            if order == 0:
                below = np.full((len(strings), k), 8.0)
            else:
                below = lower(strings & np.uint32((1 << (8 * order)) - 1))
            cost = np.where(c > 0, own, escape[up] + below)
            self.levels.append((strings, cost, contexts, escape))
            lower = functools.partial(self._cost, order)
        self.table = self._pairs()

    def _cost(self, order: int, keys: np.ndarray) -> np.ndarray:
        strings, cost, contexts, escape = self.levels[order]
        at = np.minimum(np.searchsorted(strings, keys), max(0, len(strings) - 1))
        out = cost[at].copy()
        miss = np.flatnonzero(strings[at] != keys)
        if len(miss):
            rest = keys[miss]
            if order == 0:
                out[miss] = escape[0] + 8.0
            else:
                context = rest >> np.uint32(8)
                up = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                free = np.where((contexts[up] == context)[:, None], escape[up], 0.0)
                out[miss] = free + self._cost(order - 1, rest & np.uint32((1 << (8 * order)) - 1))
        return out

    def _pairs(self):
        """Known strings by two lookups: dense numbers of their byte pairs, then a square table."""
        strings = self.levels[DEPTH][0]
        high, low = (strings >> np.uint32(16)).astype(np.int64), (strings & np.uint32(0xFFFF)).astype(np.int64)
        pairs = np.unique(np.concatenate([high, low]))
        if len(pairs) > 6000:  # wider alphabets go by binary search
            return None
        number = np.full(1 << 16, -1, np.int32)
        number[pairs] = np.arange(len(pairs))
        square = np.full((len(pairs), len(pairs)), -1, np.int32)
        square[number[high], number[low]] = np.arange(len(strings))
        return number, square

    def lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        grams, bounds = _grams(buf, off)
        strings, cost = self.levels[DEPTH][:2]
        if self.table is None:
            at = np.minimum(np.searchsorted(strings, grams), len(strings) - 1)
            at = np.where(strings[at] == grams, at, -1)
        else:
            number, square = self.table
            high, low = number[grams >> np.uint32(16)], number[grams & np.uint32(0xFFFF)]
            at = np.where((high < 0) | (low < 0), -1, square[high, low])
        miss = np.flatnonzero(at < 0)
        rest = self._cost(DEPTH, grams[miss]) if len(miss) else None
        out = np.empty((len(off) - 1, len(self.langs)))
        for k in range(len(self.langs)):
            bits = cost[:, k][at]
            if rest is not None:
                bits[miss] = rest[:, k]
            sums = np.concatenate([[0.0], np.cumsum(bits)])
            out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out


def _count(langs: list[str]):
    schema = pa.schema([("lang", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[int, tuple] = {}

        def add(k, g, c):
            if k in held:
                g, c = np.concatenate([held[k][0], g]), np.concatenate([held[k][1], c])
                g, at = np.unique(g, return_inverse=True)
                c = np.bincount(at, weights=c).astype(np.int64)
            held[k] = (g, c)

        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            buf, off = C.texts_of(batch.column("text"))
            for i, j in C.blocks(buf, off):
                grams, bounds = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                owner = np.repeat(lang[i:j], np.diff(bounds))
                for k in np.unique(owner).tolist():
                    add(k, *np.unique(grams[owner == k], return_counts=True))
        for k, (g, c) in held.items():
            yield C.table_of(schema, lang=np.full(len(g), k), gram=g.astype(np.int64), n=c)

    return run


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ppm | None:
    """Learns from (text, lang) of the given rows; None if no row has a language. doc_id, if there, only draws the sample."""
    C.tune(docs.sparkSession)
    mark = F.xxhash64("text", "doc_id") if "doc_id" in docs.columns else F.xxhash64("text")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), mark.alias("mark")).filter("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return None
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / totals[k])))])
    draw = F.pmod("mark", F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(draw < rate[F.col("lang")]).select("text", "lang")
    counted = chosen.mapInArrow(_count(langs), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counted.column(c).to_numpy() for c in ("lang", "gram", "n"))
    if not len(gram):  # only empty texts
        return None
    order = np.lexsort((gram, lang))
    return Ppm(langs, lang[order].astype(np.int64), gram[order].astype(np.uint32), n[order])


def _predict(model, extra: pa.Schema):
    schema = pa.schema([*extra, ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        ppm = model.value if model is not None else None
        for batch in batches:
            texts = batch.column("text")
            buf, off = C.texts_of(texts)
            names, scores = [], []
            for i, j in C.blocks(buf, off):
                letters = [t is not None and any(map(str.isalpha, t)) for t in texts.slice(i, j - i).to_pylist()]
                if ppm is None:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                bits = ppm.lengths(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                best = bits.argmin(axis=1)
                gap = bits - bits.min(axis=1, keepdims=True)
                post = 1.0 / np.exp2(-np.minimum(SHARPNESS * gap, 1000.0)).sum(axis=1)
                names += [ppm.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters)]
                scores += np.where(letters, post, 0.0).tolist()
            kept = {f.name: batch.column(f.name) for f in extra}
            yield C.table_of(schema, **kept, lang_pred=names, score=scores)

    return run


def predict(docs: DataFrame, model: Ppm | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text."""
    spark = C.tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model) if model is not None else None  # bounded by the training sample
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_predict(shared, pa.schema([("doc_id", pa.int64())])), "doc_id bigint, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit(docs.filter(~held))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
