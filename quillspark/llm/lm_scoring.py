"""Language-model scoring by deleted interpolation of word bigrams.

P(w | v) = a(b) c(v w)/c(v) + m(b) c(w)/N + u(b)/(V+1), with b the bucket of the context's count c(v) (its power of two;
unseen contexts have a bucket of their own, without the first term). The weights a, m, u of each bucket are learned by
expectation-maximisation on held-out counts: every training token is scored as if its own occurrence were deleted,
(c(v w)-1)/(c(v)-1) and (c(w)-1)/(N-1). All training documents take part in the counts and in the held-out counts;
these are gathered on a grid of sixteenths of an octave, whose size doesn't depend on the corpus.

A document's tokens are its lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ and one end; the first context is a begin mark.
Words are known by 64-bit hashes of their bytes.

How counts reach the documents. Documents are read in chunks. Each chunk sends its distinct n-grams once, as sorted
blocks of keys cut into value ranges, whose number follows the bytes of the input (a word, however common, is one key of
a chunk, so no range is hot). The owner of
a range adds up what all chunks sent and answers each chunk with the totals in the order of its keys. The chunk's text
meets the answers in a second task. Nothing of the corpus is sent to the driver but the grid and two totals.

Null or empty text: one end token. With no training document every count is 0 and V + 1 = 1: base_score is then
log10(0.1/0.1) = 0 a token, and score is the same. Rows with a null id are scored and, having no remainder, train.
Repeated rows are documents of their own. The input is read twice and must be a table: if its rows move between the
readings, the sizes of keys and answers differ and the job raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X

U = np.uint64
END, BEGIN = U(0x5BF0363546294CE7), U(0xC2B2AE3D27D4EB4F)
GRID, OCTAVES = 16, 40  # cells an octave, octaves below 1
ROUNDS = 60
BUCKETS = 34  # 0: unseen context; else 1 + floor(log2 c(v))
CHUNK_BYTES = 4 << 20
#: Bytes of the corpus that one value range of keys stands for at most.
RANGE_TEXT = 64 << 20


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with ends, their contexts, number of tokens of each document), blockwise to bound memory."""
    parts, counts = [], []
    for i, j in C.blocks(buf, off):
        h, n = X.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        ends = np.cumsum(n + 1) - 1
        out = np.empty(len(h) + len(n), np.uint64)
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask], out[ends] = h, END
        parts.append(out)
        counts.append(n + 1)
    token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    context = np.empty_like(token)
    if len(token):
        context[1:] = token[:-1]
        context[np.cumsum(n) - n] = BEGIN
    return token, context, n


def keys_of(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words (odd) and of the bigrams (even; so is BEGIN_KEY, which counts documents)."""
    return token | U(1), X.mix(context * U(X.RADIX) + token) & ~U(1)


BEGIN_KEY = X.mix(np.array([BEGIN]))[0] & ~U(1)


def _send(n: int):
    """A chunk's distinct keys with their training counts, a row for each value range."""
    schema = pa.schema([("target", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for chunk, table in C.Chunks(["text", "train"], CHUNK_BYTES)(batches):
            buf, off = C.texts_of(table.column("text"))
            train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
            token, context, per = tokens(buf, off)
            word, bigram = keys_of(token, context)
            learn = np.repeat(train, per)
            every = np.sort(np.concatenate([word, bigram, [BEGIN_KEY]]))
            every = every[np.concatenate([[True], every[1:] != every[:-1]])]
            mine = np.sort(np.concatenate([word[learn], bigram[learn], np.full(int(train.sum()), BEGIN_KEY)]))
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
            counts = np.zeros(len(every), np.uint32)
            counts[np.searchsorted(every, mine[first])] = np.diff(np.append(first, len(mine)))
            cut = C.slices(every, n)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                a, b = int(cut[r]), int(cut[r + 1])
                yield C.table_of(schema, target=[r], chunk=[chunk], keys=[every[a:b].tobytes()], counts=[C.pack(counts[a:b])])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Adds up the counts of one value range and answers every chunk; chunk -1 gets the totals of words and of types."""
    schema = pa.schema([("chunk", pa.int64()), ("target", pa.int32()), ("n", pa.int64()), ("totals", pa.binary()), ("types", pa.int64())])
    target = table.column("target")[0].as_py()
    blocks = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("keys")]
    counts = [C.unpack(b.as_py(), np.uint32) for b in table.column("counts")]
    every = np.sort(np.concatenate(blocks))
    every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
    total = np.zeros(len(every), np.int64)
    places = []
    for b, c in zip(blocks, counts):
        at = np.searchsorted(every, b).astype(np.int32)
        total[at] += c  # a chunk's keys are distinct
        places.append(at)
    words = (every & U(1)).astype(bool)
    del blocks, counts
    C.trim()
    chunks = [*table.column("chunk").to_pylist(), -1]
    return pa.table(
        {
            "chunk": chunks,
            "target": pa.array([target] * len(chunks), pa.int32()),
            "n": [*map(len, places), int(total[words].sum())],
            "totals": [*(C.pack(total[p].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64)) for p in places), b""],
            "types": [*([4 if total.max(initial=0) < 1 << 32 else 8] * len(places)), int((total[words] > 0).sum())],
        },
        schema=schema,
    )


ANSWER = "chunk bigint, target int, n bigint, totals binary, types bigint"


def _carry():
    """The chunk's documents, packed, for the task that has the answers."""
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary())])

    def run(batches):
        for chunk, table in C.Chunks(["doc_id", "text", "train"], CHUNK_BYTES)(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            yield C.table_of(schema, chunk=[chunk], docs=[sink.getvalue().to_pybytes()])

    return run


COUNTED = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, counts binary, wide int, cell bigint, weight bigint"


def _count(total_words: int, types: int):
    """Per document: base score and the packed counts of its tokens; per chunk: cells of the held-out grid."""
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("counts", pa.binary()), ("wide", pa.int32()), ("cell", pa.int64()), ("weight", pa.int64())])
    below = np.log10(total_words + 0.1 * (types + 1))

    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(answers.column("target").to_numpy())
        totals = [C.unpack(answers.column("totals")[int(i)].as_py(), np.uint32 if answers.column("types")[int(i)].as_py() == 4 else np.uint64) for i in order]
        totals = np.concatenate(totals).astype(np.int64) if totals else np.zeros(0, np.int64)
        for packed in documents.column("docs"):
            table = pa.ipc.open_stream(packed.as_py()).read_all().combine_chunks()
            buf, off = C.texts_of(table.column("text"))
            train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
            token, context, n = tokens(buf, off)
            word, bigram = keys_of(token, context)
            every = np.sort(np.concatenate([word, bigram, [BEGIN_KEY]]))
            every = every[np.concatenate([[True], every[1:] != every[:-1]])]
            if len(every) != len(totals):
                raise RuntimeError("the input changed between two readings; write it to a table first")
            c_w = totals[np.searchsorted(every, word)]
            c_vw = totals[np.searchsorted(every, bigram)]
            starts = np.cumsum(n) - n
            c_v = np.concatenate([[0], c_w[:-1]])
            begin = int(totals[np.searchsorted(every, BEGIN_KEY)])
            c_v[starts] = begin
            base = np.log10(c_w + 0.1) - below
            sums = np.concatenate([[0.0], np.cumsum(base)])
            known = np.concatenate([[0], np.cumsum(c_w > 0)])
            ends = starts + n
            high = int(max(c_w.max(initial=0), begin))
            kind = np.uint32 if high < 1 << 32 else np.uint64
            rows = len(n)
            blobs = [C.pack(np.concatenate([[begin], c_w[a:b], c_vw[a:b]]).astype(kind)) for a, b in zip(starts.tolist(), ends.tolist())]
            learn = np.repeat(train, n)
            cells, weights = np.unique(grid(c_vw[learn] - 1, c_v[learn] - 1, c_w[learn] - 1, total_words - 1), return_counts=True)
            pad = len(cells)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.concat_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()) if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id"), pa.nulls(pad, pa.int64())]),
                        "train": pa.array([*train.tolist(), *[None] * pad], pa.bool_()),
                        "n_tokens": pa.array([*n.tolist(), *[None] * pad], pa.int64()),
                        "n_known": pa.array([*(known[ends] - known[starts]).tolist(), *[None] * pad], pa.int64()),
                        "base_score": pa.array([*(sums[ends] - sums[starts]).tolist(), *[None] * pad], pa.float64()),
                        "counts": pa.array([*blobs, *[None] * pad], pa.binary()),
                        "wide": pa.array([*[8 if kind is np.uint64 else 4] * rows, *[None] * pad], pa.int32()),
                        "cell": pa.array([*[None] * rows, *cells.tolist()], pa.int64()),
                        "weight": pa.array([*[None] * rows, *weights.tolist()], pa.int64()),
                    },
                    schema=schema,
                )
            )
        C.trim()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def bucket(c_v: np.ndarray) -> np.ndarray:
    return np.where(c_v > 0, 1 + np.floor(np.log2(np.maximum(c_v, 1))).astype(np.int64), 0).clip(0, BUCKETS - 1)


def grid(c_vw, c_v, c_w, total) -> np.ndarray:
    """Cell of (bucket, bigram frequency, word frequency); step 0 stands for a frequency of 0."""
    steps = GRID * OCTAVES

    def step(top, bottom):
        f = np.where(bottom > 0, top / np.maximum(bottom, 1), 0.0)
        return np.where(f > 0, 1 + np.minimum(steps - 1, np.floor(-np.log2(np.where(f > 0, f, 1.0)) * GRID + 0.5)), 0).astype(np.int64)

    return (bucket(c_v) * (steps + 1) + step(c_vw, c_v)) * (steps + 1) + step(c_w, total)


def learn_weights(cells: np.ndarray, weight: np.ndarray, types: int) -> np.ndarray:
    """EM over the grid: (BUCKETS, 3) weights of bigram, word and uniform estimates."""
    side = GRID * OCTAVES + 1
    b, s2, s1 = cells // (side * side), cells // side % side, cells % side
    f2 = np.where(s2 > 0, np.exp2(-(s2 - 1) / GRID), 0.0)
    f1 = np.where(s1 > 0, np.exp2(-(s1 - 1) / GRID), 0.0)
    parts = np.stack([f2, f1, np.full(len(cells), 1.0 / (types + 1))], axis=1)
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = [0, 0.5, 0.5]
    for _ in range(ROUNDS):
        share = parts * lam[b]
        share *= (weight / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1).astype(float)
        # a bucket of few tokens leans on all tokens of like kind
        pooled = new[1:].sum(axis=0) / max(1e-300, new[1:].sum()) if new[1:].sum() else np.full(3, 1 / 3)
        new[1:] += pooled
        new[0] += [0, 0.5, 0.5]
        new[0, 0] = 0
        lam = new / new.sum(axis=1, keepdims=True)
        lam = np.maximum(lam, [0, 1e-9, 1e-9])
    return lam / lam.sum(axis=1, keepdims=True)


def _score(lam: np.ndarray, total_words: int, types: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            scores = []
            for packed, wide in zip(batch.column("counts").to_pylist(), batch.column("wide").to_pylist()):
                x = C.unpack(packed, np.uint64 if wide == 8 else np.uint32).astype(np.float64)
                k = (len(x) - 1) // 2
                c_w, c_vw, c_v = x[1 : k + 1], x[k + 1 :], x[:k]
                w = lam[bucket(c_v)]
                p = w[:, 0] * c_vw / np.maximum(c_v, 1) + w[:, 1] * c_w / max(1, total_words) + w[:, 2] / (types + 1)
                scores.append(float(np.log10(p).sum()) if total_words else 0.0)
            yield C.table_of(schema, doc_id=batch.column("doc_id"), held_out=[not t for t in batch.column("train").to_pylist()], n_tokens=batch.column("n_tokens"), n_known=batch.column("n_known"), train_tokens=[total_words] * batch.num_rows, base_score=batch.column("base_score"), score=scores)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, train (boolean). One row a document with base and model log10 probabilities."""
    spark = C.tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("train").cast("boolean").alias("train"))
    n = max(C.parts(spark), -(-C.text_bytes(slim) // RANGE_TEXT))
    sent = slim.mapInArrow(_send(n), "target int, chunk bigint, keys binary, counts binary")
    answers = C.stage(sent.groupBy("target").applyInArrow(_answer, ANSWER))
    total = answers.filter("chunk = -1").agg(F.sum("n").alias("n"), F.sum("types").alias("v")).first()
    total_words, types = int(total["n"] or 0), int(total["v"] or 0)
    carried = slim.mapInArrow(_carry(), "chunk bigint, docs binary")
    run = _count(total_words, types)
    counted = C.stage(carried.groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk")).applyInArrow(lambda a, b: run(a, b), COUNTED))
    cells = counted.filter("cell is not null").groupBy("cell").agg(F.sum("weight").alias("w")).toArrow()
    lam = learn_weights(cells.column("cell").to_numpy(), cells.column("w").to_numpy().astype(float), types)
    C.drop(answers)
    out = counted.filter("cell is null").select("doc_id", "train", "n_tokens", "n_known", "base_score", "counts", "wide")
    return out.mapInArrow(_score(lam, total_words, types), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))
    return score_documents(docs.select("doc_id", "text", train.alias("train")))
