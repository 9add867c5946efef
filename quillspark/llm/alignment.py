"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizations A and B of the same bytes are read side by side. The state is which side leads and the bytes of its last
token that the other side has not matched yet (the dangling suffix). The side that lags gives the next token: it eats
into the suffix, or outruns it and leads with a suffix of its own, or ends with it. An empty suffix closes a group. Each
step overlaps exactly the leading token and the next one, so a step is a link, and a group of m and n tokens has m+n-1
links. Transitions are remembered by (side, suffix, next token).

Where a run of blanks begins, and the byte-level pre-tokenizer begins a piece there, both tokenizations end a token: texts
are cut there into units, whose groups do not depend on what stands around them. A unit's groups and links are
remembered by its bytes, so the transducer runs once for each distinct unit while it is remembered. Each new unit of B
is checked against the sentencepiece library, and one text of each block is encoded whole by both libraries.

Counts of linked id pairs are summed over the corpus by pair: a chunk of documents sends each of its distinct pairs once. The
highest count of each B id is a table of at most B's vocabulary and is broadcast. Totals go back to the chunks by join.

Null and empty texts have no tokens, nor have texts that hold U+2581, which B reads as a blank, or whose tokens' bytes
otherwise differ from those of the text behind a blank: zeros and an empty string. Repeated rows count as often as they
come; rows without an id keep it. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X
from quillspark.llm._units import UnitTable
from quillspark.llm.piece_codec import MARK, Rows, UnitCache
from quillspark.llm.token_binary import UnitEncoder, encode_doc, pretokens

CHUNK_BYTES = 8 << 20
#: A pair of ids as one number: B's id above A's.
SHIFT = 20
#: Transitions remembered at most.
MEMO = 1 << 20
HEAD = 3


class Transducer:
    """Aligns two tokenizations; tokens are given by number, their bytes by the two vocabularies."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self._forget()

    def _forget(self) -> None:
        self.number, self.states, self.memo = {}, [(0, b"")], {}

    def _state(self, lead: int, suffix: bytes) -> int:
        found = self.number.get((lead, suffix))
        if found is None:
            found = self.number[lead, suffix] = len(self.states)
            self.states.append((lead, suffix))
        return found

    def _step(self, state: int, token: int) -> int:
        """The state after the side that lags gives its token; 0: closed, -1: the bytes differ."""
        lead, suffix = self.states[state]
        own = self.bytes[1 - lead][token]
        if not own:
            return -1
        if len(own) < len(suffix):
            return self._state(lead, suffix[len(own) :]) if suffix.startswith(own) else -1
        if not own.startswith(suffix):
            return -1
        return self._state(1 - lead, own[len(suffix) :]) if len(own) > len(suffix) else 0

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]] | None:
        """(groups as bounds in a and b, links as places in a and b); None if the joined bytes differ."""
        if len(self.memo) > MEMO:
            self._forget()
        memo, states, step = self.memo, self.states, self._step
        i = j = i0 = j0 = state = 0
        groups, links = [], []
        m, n = len(a), len(b)
        while i < m or j < n:
            if not state:  # both sides have matched all: A leads with its next token
                if i == m or not self.bytes[0][a[i]]:
                    return None
                state = self._state(0, self.bytes[0][a[i]])
                i += 1
            if states[state][0] == 0:
                if j == n:
                    return None
                token, j = b[j], j + 1
            else:
                if i == m:
                    return None
                token, i = a[i], i + 1
            links.append((i - 1, j - 1))
            key = state << SHIFT | token
            after = memo.get(key)
            if after is None:
                after = memo[key] = step(state, token)
            if after < 0:
                return None
            state = after
            if not state:
                groups.append((i0, i, j0, j))
                i0, j0 = i, j
        return None if state else (groups, links)


class Aligner:
    """Aligns blocks of texts through their distinct units."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = UnitEncoder(a_path, 0), UnitCache(b_path)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library = self.b.model.library
        spelt = {chr(c): i for i, c in enumerate(self.a.spell.tolist())}
        names = self.a.tokenizer.get_vocab()
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(spelt[c] for c in name) if all(c in spelt for c in name) else b""
        for i in self.a.tokenizer.get_added_tokens_decoder():
            a_bytes[i] = b""
        b_bytes = [self.b.model.surface.get(i, b"") for i in range(self.library.get_piece_size())]
        self.size = max(len(a_bytes), len(b_bytes))
        if self.size > 1 << SHIFT:
            raise ValueError("a vocabulary of at most 2^20 ids is needed")
        self.transducer = Transducer(a_bytes, b_bytes)
        self.table = UnitTable(limit=8 << 20)
        self.digits = Rows([list(b"%d%s" % (i, mark)) for mark in (b",", b"|", b";") for i in range(self.size)], np.uint8)

    def _fresh(self, buf, raw, a_start, b_start, begin, end):
        """What is remembered of new units: numbers of A's, B's ids and groups, the ids in the order of the groups with their marks, the links."""

        def tokens(start, encode):
            first, last = np.searchsorted(start, begin), np.searchsorted(start, end)
            each = X.ragged(first, last - first)
            ids, counts = encode(start[each], np.append(start[1:], len(buf))[each])
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(last - first)]
            return ids.tolist(), ends.tolist()

        a, a_ends = tokens(a_start, lambda s, e: self.a.fresh(buf, s, e))
        b, b_ends = tokens(b_start, lambda s, e: self.b.fresh(raw, s, e))
        flat: list[int] = []
        counts, a0, b0, size = [], 0, 0, self.size
        for a1, b1 in zip(a_ends, b_ends):
            x, y = a[a0:a1], b[b0:b1]
            found, before = self.transducer.align(x, y), len(flat)
            if found is None:
                flat += (0, 0, 0)
            else:
                groups, links = found
                flat += (len(x), len(y), len(groups))
                for i0, i1, j0, j1 in groups:
                    flat += x[i0 : i1 - 1]
                    flat.append(x[i1 - 1] + size)
                    flat += y[j0 : j1 - 1]
                    flat.append(y[j1 - 1] + 2 * size)
                flat += [x[i] for i, _ in links]
                flat += [y[j] for _, j in links]
            counts.append(len(flat) - before)
            a0, b0 = a1, b1
        return np.array(flat, np.int32), np.array(counts, np.int64)

    def block(self, buf: np.ndarray, off: np.ndarray):
        """(n x 3 numbers of A's ids, B's ids, groups; group strings; text, pair and number of each text's distinct pairs)."""
        n = len(off) - 1
        source, ends = buf.tobytes(), off.tolist()
        plain = [source[a:b] for a, b in zip(ends[:-1], ends[1:])]
        there = [i for i, t in enumerate(plain) if t and MARK.encode() not in t]
        numbers, strings = np.zeros((n, HEAD), np.int64), [b""] * n
        none = np.zeros(0, np.int64)
        if not there:
            return numbers, strings, none, none, none
        raw = b"".join(b" " + plain[i] for i in there)
        buf = np.frombuffer(raw, np.uint8)
        off = np.concatenate([[0], np.cumsum([len(plain[i]) + 1 for i in there])]).astype(np.int64)
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((buf & 0xC0) != 0x80)
        a_start = at_byte[pretokens(cp, np.searchsorted(at_byte, off))]
        blank = buf == 32
        lead = np.zeros(len(buf) + 1, bool)
        lead[off] = True
        b_start = np.flatnonzero(blank & (lead[:-1] | np.concatenate([[True], ~blank[:-1]])))
        start = np.intersect1d(a_start, b_start, assume_unique=True)
        end = np.append(start[1:], len(buf))
        flat, sizes = self.table(buf, start, end, lambda i: self._fresh(buf, raw, a_start, b_start, start[i], end[i]))
        head = np.cumsum(sizes) - sizes
        unit = flat[head[:, None] + np.arange(HEAD)].astype(np.int64)
        tokens = unit[:, 0] + unit[:, 1]
        links = tokens - unit[:, 2]
        cut = np.searchsorted(start, off)  # the first unit of each text
        owner = np.repeat(np.arange(len(there)), np.diff(cut))
        void = np.zeros(len(there), bool)
        void[owner[tokens == 0]] = True
        live = ~void[owner]
        spoken, per = self.digits.take(flat[X.ragged(head + HEAD, tokens)])
        edge = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(tokens)])[cut]].tolist()
        spoken = spoken.tobytes()
        sums = np.concatenate([np.zeros((1, HEAD), np.int64), np.cumsum(unit, axis=0)])
        for k, i in enumerate(there):
            if not void[k]:
                numbers[i] = sums[cut[k + 1]] - sums[cut[k]]
                strings[i] = spoken[edge[k] : edge[k + 1] - 1]
        self._compare(plain, there, numbers, strings)
        links = np.where(live, links, 0)
        a = flat[X.ragged(head + HEAD + tokens, links)].astype(np.int64)
        b = flat[X.ragged(head + HEAD + 2 * tokens - unit[:, 2], links)].astype(np.int64)
        text = np.array(there)[np.repeat(owner, links)]
        order = np.lexsort((b << SHIFT | a, text))
        text, pair = text[order], (b << SHIFT | a)[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])) if len(pair) else none
        return numbers, strings, text[new], pair[new], np.diff(np.append(new, len(pair)))

    def _compare(self, plain, there, numbers, strings) -> None:
        """The longest text of up to SAMPLE_BYTES against both libraries."""
        sizes = [len(plain[i]) if len(plain[i]) <= self.a.SAMPLE_BYTES else -1 for i in there]
        i = there[int(np.argmax(sizes))]
        if max(sizes) < 0 or not numbers[i, 0]:
            return
        text = plain[i].decode()
        a, b = encode_doc(self.a.tokenizer, " " + text).tolist(), self.library.encode(text, num_threads=1)
        groups = [g.split(b"|") for g in strings[i].split(b";")]
        if [int(x) for g in groups for x in g[0].split(b",")] != a or [int(x) for g in groups for x in g[1].split(b",")] != b:
            raise ValueError("a text's ids differ from the libraries'")


@functools.lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# ---------------------------------------------------------------- Spark

STAGED = "chunk bigint, doc_id array<bigint>, numbers binary, sha array<string>, groups array<string>, texts binary, pairs binary, counts binary, keys binary, sums binary"


def _align(a_path: str, b_path: str, full: bool):
    """A row for each chunk of documents: what its documents return, their distinct pairs, and the chunk's."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("numbers", pa.binary()), ("sha", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), *((x, pa.binary()) for x in ("texts", "pairs", "counts", "keys", "sums"))])

    def run(batches):
        code = aligner(a_path, b_path)
        for chunk, table in C.Chunks(["doc_id", "text"], CHUNK_BYTES)(batches):
            buf, off = C.texts_of(table.column("text"))
            numbers, strings, held = [], [], []
            for i, j in C.blocks(buf, off, 1 << 19):
                got, said, text, pair, count = code.block(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                numbers.append(got)
                strings += [hashlib.sha256(s).hexdigest() if s else "" for s in said] if not full else said
                held.append((text + i, pair, count))
            text, pair, count = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(pair, return_inverse=True)
            sums = np.bincount(at, weights=count, minlength=len(keys)).astype(np.int64)
            sha = [hashlib.sha256(s).hexdigest() if s else "" for s in strings] if full else strings
            yield C.table_of(
                schema,
                chunk=[chunk],
                doc_id=[table.column("doc_id").to_pylist()],
                numbers=[C.pack(np.concatenate(numbers))],
                sha=[sha],
                groups=[[s.decode() for s in strings] if full else None],
                texts=[C.pack(text.astype(np.uint32))],
                pairs=[C.pack(at.astype(np.uint32))],
                counts=[C.pack(count.astype(np.uint32))],
                keys=[C.pack(keys.astype(np.int64))],
                sums=[C.pack(sums)],
            )
            del numbers, strings, held, text, pair, count, at
            C.trim()

    return run


def _pairs(batches):
    """(chunk, pair, n): each chunk's distinct pairs with their numbers of links."""
    schema = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for chunk, keys, sums in zip(batch.column("chunk").to_pylist(), batch.column("keys").to_pylist(), batch.column("sums").to_pylist()):
            keys, sums = C.unpack(keys, np.int64), C.unpack(sums, np.int64)
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield C.table_of(schema, chunk=np.full(len(part), chunk), pair=part, n=sums[i : i + (1 << 16)])


def _score(full: bool):
    fields = [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]
    schema = pa.schema(fields + [("groups", pa.string())] * full)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("pair").to_numpy())  # the chunk's pairs are numbered in ascending order
        total, best = answers.column("total").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]
        out = []
        for r in chunks.to_pylist():
            if len(C.unpack(r["keys"], np.int64)) != len(total):
                raise RuntimeError("pairs of a chunk are missing")
            n = len(r["doc_id"])
            numbers = C.unpack(r["numbers"], np.int64).reshape(n, HEAD)
            text, at, count = C.unpack(r["texts"], np.uint32), C.unpack(r["pairs"], np.uint32), C.unpack(r["counts"], np.uint32).astype(np.int64)
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, text, count * best[at])
            np.add.at(count_sum, text, count * total[at])
            columns = {"doc_id": r["doc_id"], "n_a": numbers[:, 0], "n_b": numbers[:, 1], "n_groups": numbers[:, 2], "n_links": numbers[:, 0] + numbers[:, 1] - numbers[:, 2], "n_best": n_best, "count_sum": count_sum, "groups_sha256": r["sha"]}
            out.append(C.table_of(schema, **columns, **({"groups": r["groups"]} if full else {})))
        return pa.Table.from_batches(out, schema=schema)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, full: bool = True) -> DataFrame:
    """One row a document: numbers of tokens, groups and links, the links' counts, the groups' digest and (full) the groups."""
    spark = C.tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = C.stage(slim.mapInArrow(_align(a_path, b_path, full), STAGED))
    sent = staged.select("chunk", "keys", "sums").mapInArrow(_pairs, "chunk bigint, pair bigint, n bigint")
    totals = C.stage(sent.groupBy("pair").agg(F.sum("n").alias("total")))
    top = totals.groupBy(F.shiftright("pair", SHIFT).alias("b")).agg(F.max("total").alias("top"))  # at most a row for each id of B
    judged = totals.withColumn("b", F.shiftright("pair", SHIFT)).join(F.broadcast(top), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = sent.select("chunk", "pair").join(judged, "pair")
    run = _score(full)
    tail = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + (", groups string" if full else "")
    kept = staged.drop("sums")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: run(a, b), tail)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), full=False)
