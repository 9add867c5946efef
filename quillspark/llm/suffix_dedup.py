"""Removal of byte strings that occur more than once, by external induced sorting of suffixes.

Every byte covered by a LENGTH-byte string that also starts elsewhere in the corpus goes; overlaps count and strings are
judged on the input. Matches never cross documents; null texts are empty.

Only suffixes that can have a partner are sorted, and equal ones meet in one shard:

1. Every window of LENGTH bytes has an anchor, the least GRAM-byte hash inside it, so equal windows have equal anchors.
   Neighbouring windows with one anchor form a run; its segment is the text they cover. Each chunk of documents
   sends its distinct (anchor, segment hash) pairs once; the owner of a range of anchors answers with a code:
   0 the anchor occurs once: no window of the run has a partner; 1 it occurs again and all its segments are equal: one
   copy stands for all and every window has a partner; 2 and 3 segments differ, this one is single (2) or not (3).
   Anchors with more than HOT differing segments are marked (HOT_BIT).
2. Segments of codes 2 and 3 go, each distinct one once a chunk, to the shard of their anchor. Those of a marked anchor
   are cut into PIECES pieces of neighbouring windows first, and a piece goes to the shard of the bytes that all its
   windows share: equal windows lie equally far from their anchor and meet, while the anchor's segments part.
   A shard sorts the suffixes of its segments by external induction (induced_sort) and flags those that share LENGTH
   bytes with a neighbour.
3. Flags return to the documents that asked. Documents without open runs are finished before, without a shuffle.

Anchors and segments are told apart by hashes, of 64 bits for an anchor (a collision costs time only) and of 128 bits
for a segment; equal ones count as equal strings. The number of shards and of ranges follows the bytes of the input. A
shard's tuples wait on the task's own disk beyond a budget; that disk space is freed with the task.
The input is read twice and must be a table; rows that move between the readings raise. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _anchors as A
from quillspark.llm import _common as C
from quillspark.llm import _text as X
from quillspark.llm import induced_sort as I

LENGTH, GRAM = 400, 232
CHUNK_BYTES = 4 << 20
SHARDS_A_PART = 4
#: Bytes of the corpus that one shard, and one range of anchors, stands for at most.
SHARD_TEXT, RANGE_TEXT = 4 << 20, 256 << 20
#: Differing segments of an anchor beyond which its windows are spread over several shards.
HOT, HOT_BIT, PIECES = 4096, 4, 8


def _sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of two polynomial hashes."""
    second = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(SECOND[part] * X.powers(len(part) + 1)[0][: len(part)], out=second[1:])
    return X.prefix(part), second


SECOND = X.mix(X.BYTE + X.U(0x632BE59BD9B4E019))


def _runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of all documents blockwise: (document, first and last start, anchor and its position, two hashes of the segment)."""
    out = []
    for i, j in C.blocks(buf, off, 1 << 19):
        part = buf[off[i] : off[j]]
        doc, first, last, anchor, place = A.runs(part, off[i : j + 1] - off[i], length, gram)
        if len(doc):
            one, two = _sums(part)
            out.append((doc + i, first + off[i], last + off[i], anchor, place + off[i], X.span_hashes(one, first, last + length), X.span_hashes(two, first, last + length)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _distinct(anchor: np.ndarray, seg: np.ndarray, seg2: np.ndarray):
    """Distinct (anchor, segment) in order, where each run stands among them, and a run of each."""
    order = np.lexsort((seg2, seg, anchor))
    a, s, t = anchor[order], seg[order], seg2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])]) if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], s[new], t[new], place, order[new]


def _send(n: int, length: int, gram: int):
    schema = pa.schema([("target", pa.int32()), ("chunk", pa.int64()), ("anchors", pa.binary()), ("segs", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for chunk, table in C.Chunks(["text"], CHUNK_BYTES)(batches):
            _, _, _, anchor, _, seg, seg2 = _runs(*C.texts_of(table.column("text")), length, gram)
            a, s, t, place, _ = _distinct(anchor, seg, seg2)
            counts = np.minimum(np.bincount(place, minlength=len(a)), 2).astype(np.uint8)
            cut = C.slices(a, n)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                i, j = int(cut[r]), int(cut[r + 1])
                yield C.table_of(schema, target=[r], chunk=[chunk], anchors=[a[i:j].tobytes()], segs=[s[i:j].tobytes() + t[i:j].tobytes()], counts=[C.pack(counts[i:j])])

    return run


def _answer(hot: int):
    schema = pa.schema([("chunk", pa.int64()), ("target", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        blocks = []
        for a, s, c in zip(table.column("anchors"), table.column("segs"), table.column("counts")):
            a, s = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(s.as_py(), np.uint64)
            blocks.append((a, s[: len(a)], s[len(a) :], C.unpack(c.as_py(), np.uint8)))
        anchor, seg, seg2, count = (np.concatenate(x) for x in zip(*blocks))
        a, s, _, place, _ = _distinct(anchor, seg, seg2)
        total = np.bincount(place, weights=count, minlength=len(a)).astype(np.int64)
        first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        kinds, members = np.bincount(group, minlength=0), np.bincount(group, weights=total).astype(np.int64)
        code = np.where(members[group] == 1, 0, np.where(kinds[group] == 1, 1, np.where(total > 1, 3, 2))).astype(np.uint8) if len(a) else np.zeros(0, np.uint8)
        code += np.where(kinds[group] > hot, HOT_BIT, 0).astype(np.uint8) if len(a) else code
        codes = code[place]
        ends = np.cumsum([len(b[0]) for b in blocks])
        out = pa.table({"chunk": table.column("chunk"), "target": table.column("target"), "n": [len(b[0]) for b in blocks], "codes": [C.pack(codes[e - len(b[0]) : e]) for e, b in zip(ends, blocks)]}, schema=schema)
        C.trim()
        return out

    return run


def _carry():
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary())])

    def run(batches):
        for chunk, table in C.Chunks(["doc_id", "text"], CHUNK_BYTES)(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            yield C.table_of(schema, chunk=[chunk], docs=[sink.getvalue().to_pybytes()])

    return run


STATE = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary()), ("body", pa.binary()), ("target", pa.int32())])
STATE_SQL = "kind int, chunk bigint, idx int, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans binary, body binary, target int"
#: Kinds of rows between the steps: a finished document, one that waits for flags, segments on their way to a shard.
DONE, OPEN, SEGMENTS = 0, 1, 2


def cut_out(text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """What stays when windows first..last (inclusive starts) go: (removed bytes, spans (k, 2), remaining bytes)."""
    if not len(first):
        return 0, np.zeros((0, 2), np.int64), text.tobytes()
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return int(gone.sum()), edge.reshape(-1, 2), text[~gone].tobytes()


def _finished(**columns) -> pa.Table:
    n = len(columns["doc_id"])
    return pa.table({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in STATE}, schema=STATE)


def _pieces(buf, off, doc, first, last, place, length: int, gram: int):
    """Runs cut by how far their windows start before the anchor: (document, first and last start, key of the bytes all share)."""
    room = length - gram + 1  # distances 0 .. room - 1
    out = []
    for k in range(PIECES):
        near, far = room * k // PIECES, room * (k + 1) // PIECES - 1
        x, y = np.maximum(first, place - far), np.minimum(last, place - near)
        mine = np.flatnonzero((x <= y) & (far >= near))
        for r in mine.tolist():
            shared = buf[max(off[doc[r]], place[r] - near) : min(off[doc[r] + 1], place[r] - far + length)]
            digest = hashlib.blake2b(shared.tobytes(), digest_size=8, key=bytes([k])).digest()
            out.append((doc[r], x[r], y[r], np.frombuffer(digest, np.uint64)[0]))
    return [np.array(c, t) for c, t in zip(zip(*out), (np.int64, np.int64, np.int64, np.uint64))] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)]


def _judge(length: int, gram: int, shards: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("target").to_numpy())
        codes = np.concatenate([C.unpack(answers.column("codes")[int(i)].as_py(), np.uint8) for i in order] or [np.zeros(0, np.uint8)])
        out = []
        for chunk, packed in zip(documents.column("chunk").to_pylist(), documents.column("docs")):
            table = pa.ipc.open_stream(packed.as_py()).read_all()
            buf, off = C.texts_of(table.column("text"))
            doc, first, last, anchor, spot, seg, seg2 = _runs(buf, off, length, gram)
            a, _, _, place, sample = _distinct(anchor, seg, seg2)
            if len(a) != len(codes):
                raise RuntimeError("the input changed between two readings; write it to a table first")
            hot, code = codes[place] >= HOT_BIT, codes[place] % HOT_BIT
            sure, asked = (code == 1) | (code == 3), code == 2
            names = table.column("doc_id").to_pylist()
            bounds = np.searchsorted(doc, np.arange(len(names) + 1))
            rows = {f.name: [] for f in STATE if f.name not in ("chunk", "target")}
            packer = zstandard.ZstdCompressor(level=1)
            for d, name in enumerate(names):
                text, mine = buf[off[d] : off[d + 1]], slice(bounds[d], bounds[d + 1])
                known = sure[mine]
                x, y = first[mine][known] - off[d], last[mine][known] - off[d]
                wait = bool(asked[mine].any())
                removed, spans, rest = (0, None, b"") if wait else cut_out(text, x, y, length)
                for k, v in {"kind": OPEN if wait else DONE, "idx": d, "doc_id": name, "n_bytes": len(text), "n_removed": removed, "n_spans": 0 if wait else len(spans), "kept_sha256": None if wait else hashlib.sha256(rest).hexdigest(), "spans": np.stack([x, y]).tobytes() if wait else spans.tobytes(), "body": packer.compress(text.tobytes()) if wait else None}.items():
                    rows[k].append(v)
            out.append(_finished(**rows, chunk=[chunk] * len(names)))
            ship = sample[codes % HOT_BIT >= 2]  # one run for each distinct segment that must be compared
            if len(ship):
                calm, torn = ship[~hot[ship]], ship[hot[ship]]
                cut = _pieces(buf, off, doc[torn], first[torn], last[torn], spot[torn], length, gram)
                # starts of a chunk's runs ascend and don't overlap, so a piece's start finds its run
                run_of = np.searchsorted(first, cut[1], side="right") - 1
                owner, begin, end = (np.concatenate([x[calm], y]) for x, y in ((doc, cut[0]), (first, cut[1]), (last, cut[2])))
                key, asks = np.concatenate([anchor[calm], cut[3]]), asked[np.concatenate([calm, run_of])]
                target = ((key >> X.U(32)) * X.U(shards) >> X.U(32)).astype(np.int32)
                order = np.argsort(target, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], np.diff(target[order]) != 0, [True]]))
                blobs, targets = [], []
                for i, j in zip(edges[:-1], edges[1:]):
                    r = order[i:j]
                    head = np.stack([np.where(asks[r], owner[r], -1), begin[r] - off[owner[r]], end[r] - begin[r] + 1])
                    blobs.append(packer.compress(np.int64(len(r)).tobytes() + head.tobytes() + b"".join(buf[x : y + length].tobytes() for x, y in zip(begin[r].tolist(), end[r].tolist()))))
                    targets.append(int(target[r[0]]))
                out.append(_finished(kind=[SEGMENTS] * len(blobs), chunk=[chunk] * len(blobs), doc_id=[None] * len(blobs), body=blobs, target=targets))
        C.trim()
        return pa.concat_tables(out) if out else STATE.empty_table()

    return run


FLAGS = pa.schema([("chunk", pa.int64()), ("flags", pa.binary())])


def _sort_shard(length: int, budget: int):
    """Sorts a shard's segments and returns, by chunk, the window starts (document, first, last) that have partners."""

    def run(table: pa.Table) -> pa.Table:
        opener, known, again = zstandard.ZstdDecompressor(), {}, set()
        askers: list[tuple] = []
        for chunk, body in zip(table.column("chunk").to_pylist(), table.column("body")):
            raw = opener.decompress(body.as_py())
            n = int(np.frombuffer(raw[:8], np.int64)[0])
            head = np.frombuffer(raw[8 : 8 + 24 * n], np.int64).reshape(3, n)
            at = 8 + 24 * n
            for doc, first, count in head.T.tolist():
                part = raw[at : at + count + length - 1]
                at += len(part)
                before = len(known)
                which = known.setdefault(part, before)  # compared as bytes: the same segment from several places is one
                if len(known) == before:
                    again.add(which)
                askers.append((which, chunk, doc, first, count))
        text, begins = I.text_of(list(known))
        flags = I.repeated(text, length, budget)
        by: dict[int, list] = {}
        for which, chunk, doc, first, count in askers:
            if doc < 0:
                continue
            b = int(begins[which])
            mine = np.ones(count, np.int8) if which in again else flags[b : b + count].astype(np.int8)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]])))
            by.setdefault(chunk, []).extend((doc, first + x, first + y - 1) for x, y in edge.reshape(-1, 2).tolist())
        C.trim()
        return pa.table({"chunk": list(by), "flags": [np.array(v, np.int64).tobytes() for v in by.values()]}, schema=FLAGS)

    return run


def _finish(length: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(-1, 3) for b in answers.column("flags")] or [np.zeros((0, 3), np.int64)])
        found = found[np.argsort(found[:, 0], kind="stable")]
        opener, rows = zstandard.ZstdDecompressor(), {f.name: [] for f in STATE if f.name not in ("target", "body")}
        for r in documents.to_pylist():
            a, b = np.searchsorted(found[:, 0], [r["idx"], r["idx"] + 1])
            x, y = np.frombuffer(r["spans"], np.int64).reshape(2, -1)
            removed, spans, rest = cut_out(np.frombuffer(opener.decompress(r["body"]), np.uint8), np.concatenate([x, found[a:b, 1]]), np.concatenate([y, found[a:b, 2]]), length)
            for k, v in {"kind": DONE, "chunk": r["chunk"], "idx": r["idx"], "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "n_removed": removed, "n_spans": len(spans), "kept_sha256": hashlib.sha256(rest).hexdigest(), "spans": spans.tobytes()}.items():
                rows[k].append(v)
        C.trim()
        return _finished(**rows)

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int | None = None, sort_budget: int = 64 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, kept, spans.

    repeated: the document holds a repeated string; kept: its text stays whole (the opposite); spans: pairs of int64, begin
    and end of each removed run.
    """
    spark = C.tune(docs.sparkSession)
    gram = gram or max(1, min(length, round(length * GRAM / LENGTH)))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = C.text_bytes(slim)
    n = max(C.parts(spark), -(-size // RANGE_TEXT))
    shards = max(C.parts(spark) * SHARDS_A_PART, -(-size // SHARD_TEXT))
    sent = slim.mapInArrow(_send(n, length, gram), "target int, chunk bigint, anchors binary, segs binary, counts binary")
    answer = _answer(HOT)
    answers = sent.groupBy("target").applyInArrow(lambda t: answer(t), "chunk bigint, target int, n bigint, codes binary")
    carried = slim.mapInArrow(_carry(), "chunk bigint, docs binary")
    judge, sort, finish = _judge(length, gram, shards), _sort_shard(length, sort_budget), _finish(length)
    state = C.stage(carried.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: judge(a, b), STATE_SQL))
    segments = state.filter(F.col("kind") == SEGMENTS).select("target", "chunk", "body")
    flags = segments.groupBy("target").applyInArrow(lambda t: sort(t), "chunk bigint, flags binary")
    waiting = state.filter(F.col("kind") == OPEN)
    finished = waiting.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(lambda a, b: finish(a, b), STATE_SQL)
    done = state.filter(F.col("kind") == DONE).unionByName(finished)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"), (F.col("n_removed") == 0).alias("kept"), "spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
