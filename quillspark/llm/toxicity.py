"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence (text between . ! ? or line breaks) has p = sigmoid(bias + sum of w over its distinct words and stems); a
document is toxic unless none of its sentences is: 1 - prod(1 - p). Weights come from gradient descent on the
likelihood of the document labels, so the sentences that explain a label are found without sentence labels.

The classifier is fitted on the driver on a bounded sample of labelled rows: about MAX_TOXIC toxic and MAX_CLEAN clean
documents (documented bounds; each document has the same chance within its class, by a hash of its id, and is weighted
by the inverse of it). All rows are used when there are fewer; texts are taken whole, of any length. Executors count in
how many sampled documents each word occurs, and the driver sees those that may carry weight, then only where these
stand. Words that occur in fewer than MIN_DOCS documents, or speak too weakly for toxicity, carry no weight: noisy
labels would else be explained by rare words. Evidence is the log-likelihood ratio of the counts of sampled documents, as they are, without
weights. It must reach SHARE of what a word of all toxic and no clean documents would have, so that the filter is as
strong on any number of labels, and CHANCE (about 5 in 10,000) where labels are few. Scoring reads whole texts and
needs no shuffle.

Null, empty or wordless text: no sentence, score 0. Labels that are null, or not 0 or 1, do not train; of documents
labelled twice, every label row trains. With no toxic label at all, every score is 0. Repeated rows repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X

MAX_TOXIC, MAX_CLEAN, MIN_DOCS = 1500, 2500, 3
#: Least evidence of a word, as a share of a perfect word's; and what chance alone exceeds once in 2,000 words.
SHARE, CHANCE = 0.016, 12.0
#: Bytes of the stems that count beside whole words.
STEMS = (4, 6)
#: Bytes of text whose words are held at once (tens of bytes for each).
BLOCK = 1 << 18
ROUNDS, RATE, DECAY, BIAS = 200, 0.1, 2e-5, -8.0

WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 63]] = True


def instances(buf: np.ndarray, off: np.ndarray):
    """Sentences and their words: (hashes of words and stems, sentence of each, document of each sentence, spans of sentences)."""
    n = len(buf)
    z = np.zeros(0, np.int64)
    if n == 0:
        return z.astype(np.uint64), z, z, z, z
    low = X.LOWER[buf]
    solid = WORDLIKE[buf]
    lead = np.zeros(n + 1, bool)
    lead[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | lead[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | lead[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(start):
        return z.astype(np.uint64), z, z, z, z
    breaks = np.cumsum(STOP[buf] & ~np.concatenate([[False], STOP[buf][:-1]]))
    doc = np.searchsorted(off, start, side="right") - 1
    place = breaks[start] + doc  # grows at each stop and each document
    first = np.concatenate([[True], (place[1:] != place[:-1])])
    sentence = np.cumsum(first) - 1
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(start) - 1]])
    sums = X.prefix(low)
    marks, owners = [X.span_hashes(sums, start, end)], [sentence]
    for size in STEMS:  # stems: inflected words share them
        longer = np.flatnonzero(end - start > size)
        marks.append(X.mix(X.span_hashes(sums, start[longer], start[longer] + size) + X.U(size)))
        owners.append(sentence[longer])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(marks)[order], owner[order], doc[first], start[first], end[last]


class NoisyOr:
    """Words (sorted hashes) with weights, and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, buf: np.ndarray, off: np.ndarray):
        """Noisy-or of each document, and the span and probability of its worst sentence."""
        n = len(off) - 1
        h, sentence, doc, start, end = instances(buf, off)
        out, worst_p = np.zeros(n), np.zeros(n)
        worst_start, worst_end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(doc) == 0 or len(self.words) == 0:
            return out, worst_start, worst_end, worst_p
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = np.flatnonzero(self.words[at] == h)
        pairs = np.unique(sentence[known] * len(self.words) + at[known])  # distinct words of a sentence
        z = self.bias + np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=len(doc))
        calm = -np.logaddexp(0.0, z)
        out = -np.expm1(np.bincount(doc, weights=calm, minlength=n))
        order = np.lexsort((-np.arange(len(z)), z, doc))
        last = order[np.concatenate([np.flatnonzero(doc[order][1:] != doc[order][:-1]), [len(order) - 1]])]
        has = doc[last]
        worst_start[has], worst_end[has], worst_p[has] = start[last] - off[has], end[last] - off[has], -np.expm1(calm[last])
        return out, worst_start, worst_end, worst_p


def _evidence(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """Log-likelihood ratio of a word's document counts in two classes, negative where the first has the smaller share."""
    share = (a + b) / max(1e-9, n + m)

    def part(x, total, p):
        q = x / max(1e-9, total)
        return np.where(x > 0, x * np.log(np.maximum(q, 1e-300) / np.maximum(p, 1e-300)), 0) + np.where(total > x, (total - x) * np.log(np.maximum(1 - q, 1e-300) / np.maximum(1 - p, 1e-300)), 0)

    return 2 * (part(a, n, share) + part(b, m, share)) * np.sign(a / max(1e-9, n) - b / max(1e-9, m))


def _least(n: int, m: int) -> float:
    """Evidence asked of a word, given n toxic and m clean documents."""
    perfect = float(_evidence(np.array([float(n)]), np.array([0.0]), n, m)[0])
    return max(SHARE * perfect, min(CHANCE, perfect))


def select(words: np.ndarray, in_toxic: np.ndarray, in_clean: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which words carry weight, given in how many of the n toxic and m clean documents they occur."""
    return (in_toxic + in_clean >= MIN_DOCS) & (_evidence(in_toxic, in_clean, n, m) >= _least(n, m))


def train(words, in_toxic, in_clean, toxic, weight, rows, columns, owner, silent) -> NoisyOr:
    """Gradient descent (Adam) on the weighted noisy-or likelihood, with a weak pull towards each word's log ratio of shares.

    words (ascending) with their document counts by class; toxic and weight of each document; rows and columns: sentence
    and word of each place where a word stands; owner: document of each such sentence; silent: each document's other
    sentences, which hold no word and score the bias alone.
    """
    n, m = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n or not len(words):
        return NoisyOr(np.zeros(0, np.uint64), np.zeros(0), BIAS)
    w = np.clip(np.log((in_toxic + 0.5) / (n + 1)) - np.log((in_clean + 0.5) / (m + 1)), 0, 8)
    theta = np.append(w, BIAS)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(rows, weights=theta[columns], minlength=len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-np.clip(theta[-1], -40, 40)))
        calm = np.bincount(owner, weights=-np.logaddexp(0.0, z), minlength=len(toxic)) - silent * np.logaddexp(0.0, theta[-1])
        pull = np.where(toxic == 1, -1 / np.maximum(np.expm1(np.minimum(-calm, 500.0)), 1e-9), 1.0) * weight
        g_z = p * pull[owner]
        g = np.append(np.bincount(columns, weights=g_z[rows], minlength=len(words)), g_z.sum() + p0 * (silent * pull).sum()) / weight.sum()
        g[:-1] += DECAY * (theta[:-1] - w)  # words that nothing speaks against keep their evidence
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    solid = np.abs(theta[:-1]) > 1e-3
    return NoisyOr(words[solid], theta[:-1][solid], float(theta[-1]))


def _sums(word: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Counts added up by word."""
    distinct, at = np.unique(word, return_inverse=True)
    return distinct, np.bincount(at, weights=a, minlength=len(distinct)).astype(np.int64), np.bincount(at, weights=b, minlength=len(distinct)).astype(np.int64)


def _occurrences():
    """In how many toxic and clean documents each word occurs, summed a task."""
    schema = pa.schema([("word", pa.int64()), ("in_toxic", pa.int64()), ("in_clean", pa.int64())])

    def run(batches):
        C.free()
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy()
            for i, j in C.blocks(buf, off, BLOCK):
                h, sentence, doc, _, _ = instances(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                owner = doc[sentence] if len(doc) else np.zeros(0, np.int64)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
                bad = toxic[i:j][owner[new]]
                held = _sums(*(np.concatenate(x) for x in zip(held, (h[new], bad, 1 - bad))))
            C.trim()
        yield C.table_of(schema, word=held[0].view(np.int64), in_toxic=held[1], in_clean=held[2])

    return run


def _features(words: np.ndarray):
    """Where the given words stand: of each document (sentence, word) pairs, and how many sentences hold none."""
    schema = pa.schema([("toxic", pa.int32()), ("pairs", pa.binary()), ("silent", pa.int64())])

    def run(batches):
        C.free()
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            toxic = batch.column("toxic").to_pylist()
            for i, j in C.blocks(buf, off, BLOCK):
                h, sentence, doc, _, _ = instances(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                known = words[at] == h
                pairs = np.unique(sentence[known] * len(words) + at[known])
                where = pairs // len(words)
                speaking = np.bincount(doc[np.unique(where)], minlength=j - i)
                cut = np.searchsorted(doc[where], np.arange(j - i + 1))
                begin = np.searchsorted(doc, np.arange(j - i))
                yield C.table_of(
                    schema,
                    toxic=toxic[i:j],
                    pairs=[C.pack(pairs[a:b] - begin[k] * len(words)) for k, (a, b) in enumerate(zip(cut, cut[1:]))],
                    silent=np.bincount(doc, minlength=j - i) - speaking,
                )
            C.trim()

    return run


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> NoisyOr:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic)."""
    C.tune(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((1, max_toxic), (0, max_clean))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.filter(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.stage(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))  # at most about max_toxic + max_clean labels
    drawn = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = drawn.get(1, 0), drawn.get(0, 0)
    counts = rows.mapInArrow(_occurrences(), "word bigint, in_toxic bigint, in_clean bigint").groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))
    # a word that speaks for toxicity has the larger share there; fewer than half of the words that recur do
    counts = counts.filter((F.col("in_toxic") + F.col("in_clean") >= MIN_DOCS) & (F.col("in_toxic") * float(max(1, n_clean)) > F.col("in_clean") * float(max(1, n_toxic)))).toArrow()
    words, in_toxic, in_clean = (counts.column(c).to_numpy() for c in ("word", "in_toxic", "in_clean"))
    words = words.view(np.uint64)
    order = np.argsort(words)
    order = order[select(words, in_toxic, in_clean, n_toxic, n_clean)[order]] if len(order) else order
    words, in_toxic, in_clean = words[order], in_toxic[order], in_clean[order]
    got = rows.mapInArrow(_features(words), "toxic int, pairs binary, silent bigint").collect() if len(words) else []
    C.drop(rows)
    got.sort(key=lambda r: (r["toxic"], r["silent"], bytes(r["pairs"])))  # the order of rows must not matter
    toxic, silent = np.array([r["toxic"] for r in got], np.int64), np.array([r["silent"] for r in got], np.int64)
    weight = np.array([1 / rate[r["toxic"]] for r in got])
    pairs = [C.unpack(r["pairs"], np.int64) for r in got]
    document = np.repeat(np.arange(len(got)), [len(p) for p in pairs])
    flat = np.concatenate([*pairs, np.zeros(0, np.int64)])
    place = flat // max(1, len(words))  # sentence inside its document
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])]) if len(flat) else np.zeros(0, bool)
    return train(words, in_toxic, in_clean, toxic, weight, np.cumsum(new) - 1, flat % max(1, len(words)), document[new], silent)


def _score(model, keep: pa.Schema):
    schema = pa.schema([*keep, ("score", pa.float64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()), ("worst_score", pa.float64())])

    def run(batches):
        C.free()
        m = model.value
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            for i, j in C.blocks(buf, off, BLOCK):
                s, a, b, p = m.score(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                kept = {f.name: batch.column(f.name).slice(i, j - i) for f in keep}
                yield C.table_of(schema, **kept, score=np.clip(s, 0, 1), worst_start=a, worst_end=b, worst_score=p)
            C.trim()

    return run


#: Names of the columns that scoring adds.
ADDED = "score double, worst_start bigint, worst_end bigint, worst_score double"


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score, and byte span and probability of the worst sentence, for every whole text."""
    spark = C.tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most the words of the bounded training sample
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_score(shared, pa.schema([("doc_id", pa.int64())])), f"doc_id bigint, {ADDED}")


def reject(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they were."""
    from pyspark.sql.pandas.types import to_arrow_schema

    C.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = to_arrow_schema(docs.schema)

    def run(batches):
        C.free()
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            keep = np.concatenate([shared.value.score(buf[off[i] : off[j]], off[i : j + 1] - off[i])[0] < threshold for i, j in C.blocks(buf, off, BLOCK)] or [np.zeros(0, bool)])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.filter(pa.array(keep)).columns, schema)], schema=schema)
            C.trim()

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held))
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "worst_start", "worst_end", "worst_score")
