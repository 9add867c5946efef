"""Token ids in binary files: static range asymmetric numeral system (rANS) over independent interleaved blocks.

File format. A dataset is a folder of Parquet containers, one row a block, in ascending order of doc_id:

    part, block   place of the block: range partition, then number inside it
    doc_ids       the documents of the block (a document never crosses blocks); lengths: ids of each, end id included
    n_tokens      ids in the block
    lanes         interleaved coders; id i belongs to lane i mod lanes
    states        the lanes' 64-bit states at the block's start: the checkpoint from which a decoder starts
    words         32-bit code words in reading order
    crc32         unsigned CRC-32 of the decoded ids as little-endian unsigned 32-bit integers

The frequency table (one for the dataset, 2^PRECISION in total) is written beside it as (id, freq). It is counted over
all ids of all documents. Every block decodes alone, so readers work in parallel and a damaged block is named.
Null or empty text: only the end id. Repeated doc_ids keep all their rows, ordered by a hash of the text, then the text;
null doc_ids come first. Ranges are cut by doc_id and that hash, so neither nulls nor a repeated id fall into one task.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
import operator
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X
from quillspark.llm._units import SHORT, ShortUnitTable

PRECISION = 22
LOW = 1 << 31
BLOCK = 1 << 17  # ids a block closes at
LANES = 512
#: Rows of lanes that are prepared at once; ids, about, of blocks that are coded side by side.
STEPS, TOGETHER = 64, 1 << 21
#: Bytes of text that one range of documents holds, about.
RANGE_TEXT = 64 << 20

STAGED = "kind int, part int, block int, doc_ids array<bigint>, lengths array<int>, n_tokens bigint, ids binary"
BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<int>, n_tokens bigint, lanes int, states binary, words binary, crc32 bigint"


# ---------------------------------------------------------------- rANS


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Scales counts to 2^precision in total; every id that occurs keeps at least 1."""
    total, goal = int(counts.sum()), 1 << precision
    if total == 0:
        return np.zeros(len(counts), np.int64)
    seen = counts > 0
    if int(seen.sum()) > goal:
        raise ValueError("more distinct ids than the precision holds")
    freq = np.where(seen, np.maximum(1, (counts.astype(object) * goal // total).astype(np.int64)), 0)
    over = int(freq.sum()) - goal
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # take from the largest, never below 1
        cut = np.minimum(freq[order] - 1, -(-over // max(1, int((freq > 1).sum()))))
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        over = int(freq.sum()) - goal
    freq[order[0]] -= over
    return freq


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray, cum: np.ndarray, precision: int = PRECISION) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(lanes, states, words) of each block; blocks don't meet, their lanes only step together.

    The coder runs backwards, so that the decoder runs forwards. Places behind a block's end hold a symbol of the whole
    range, which leaves a state as it is.
    """
    k, rows = len(blocks), max((-(-len(b) // LANES) for b in blocks), default=0)
    shift, top, half = np.uint64(precision), np.uint64(31 - precision + 32), np.uint64(32)
    f_of, c_of = np.append(freq, 1 << precision).astype(np.uint64), np.append(cum, 0).astype(np.uint64)
    ids = np.full((k, rows * LANES), len(freq), np.int32)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    ids = ids.reshape(k, rows, LANES)
    state = np.full((k, LANES), LOW, np.uint64)
    low, full = np.empty((rows, k, LANES), np.uint32), np.empty((rows, k, LANES), bool)
    q, r = np.empty_like(state), np.empty_like(state)
    for end in range(rows, 0, -STEPS):
        begin = max(0, end - STEPS)
        f = f_of[ids[:, begin:end].transpose(1, 0, 2)]
        c, most = c_of[ids[:, begin:end].transpose(1, 0, 2)], f << top
        for row in range(end - 1, begin - 1, -1):
            np.greater_equal(state, most[row - begin], out=full[row])
            low[row] = state
            np.multiply(full[row], half, out=r)
            np.right_shift(state, r, out=state)
            np.divmod(state, f[row - begin], out=(q, r))
            np.left_shift(q, shift, out=q)
            np.add(q, r, out=q)
            np.add(q, c[row - begin], out=state)
    out = []
    for i, b in enumerate(blocks):
        lanes = max(1, min(LANES, len(b)))
        out.append((lanes, state[i, :lanes].copy(), low[:, i][full[:, i]]))
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, precision: int = PRECISION) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, states, words) of one block."""
    return encode_blocks([ids], freq, cum, precision)[0]


def decode_blocks(blocks: list[tuple[int, int, np.ndarray, np.ndarray]], freq: np.ndarray, cum: np.ndarray, slot: np.ndarray, precision: int = PRECISION) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, lanes, states, words); slot maps each value below 2^precision to its id.

    Rows that several blocks have in full are decoded side by side, the rest of each block alone.
    """
    width = max([1, *(b[1] for b in blocks)])
    rows = [n // lanes if lanes == width else 0 for n, lanes, _, _ in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -rows[i])
    rows = [rows[i] for i in order]
    out = [np.empty(n, np.int32) for n, _, _, _ in blocks]
    state = np.zeros((len(blocks), width), np.int64)  # states stay below 2^63
    for j, i in enumerate(order):
        state[j, : blocks[i][1]] = blocks[i][2].astype(np.int64)
    sizes = np.array([len(blocks[i][3]) for i in order], np.int64)
    words = np.concatenate([blocks[i][3] for i in order] or [np.zeros(0, np.uint32)])
    at, limit = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    shift, mask = np.int64(precision), np.int64((1 << precision) - 1)
    f_of, c_of = np.ascontiguousarray(freq, np.int64), np.ascontiguousarray(cum, np.int64)

    def step(x: np.ndarray, first: int) -> np.ndarray:
        """One row of the blocks first, first + 1 and so on: renews their states x and returns the ids."""
        low_bits = x & mask
        s = slot[low_bits]
        x >>= shift
        x *= f_of[s]
        x += low_bits
        x -= c_of[s]
        need = np.flatnonzero(x < LOW)
        if len(need):
            edge = np.searchsorted(need, np.arange(width, len(x) + 1, width)) if len(x) > width else np.array([len(need)])
            count = np.diff(edge, prepend=0)
            here = at[first : first + len(count)]
            if (here + count > limit[first : first + len(count)]).any():
                raise ValueError("block has fewer words than it needs")
            x[need] = x[need] << 32 | words[np.repeat(here - edge + count, count) + np.arange(len(need))]
            here += count
        return s

    done = 0
    for wide in range(len(blocks), 0, -1):  # the blocks that still have full rows are the first ones
        x = state[:wide].reshape(-1)
        for begin in range(done, rows[wide - 1], STEPS):
            held = [step(x, 0) for _ in range(begin, min(begin + STEPS, rows[wide - 1]))]
            for j, part in enumerate(np.stack(held).reshape(len(held), wide, width).transpose(1, 0, 2)):
                out[order[j]][begin * width : (begin + len(held)) * width] = part.reshape(-1)
        done = max(done, rows[wide - 1])
    for j, i in enumerate(order):
        n, lanes, _, _ = blocks[i]
        for first in range(rows[j] * width, n, lanes):
            x = state[j, : min(lanes, n - first)]
            out[i][first : first + len(x)] = step(x, j)
        if at[j] != limit[j]:
            raise ValueError("block does not end where its words do")
    return out


def decode_block(n: int, lanes: int, states: np.ndarray, words: np.ndarray, freq: np.ndarray, cum: np.ndarray, slot: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """The n ids of one block."""
    return decode_blocks([(n, lanes, states, words)], freq, cum, slot, precision)[0]


def groups(rows: list[dict], most: int):
    """Runs of rows that hold at most so many ids if all were as long as the longest (a longer row is a run of its own)."""
    held, longest = [], 0
    for r in rows:
        longest = max(longest, r["n_tokens"], LANES)
        if held and (len(held) + 1) * longest > most:
            yield held
            held, longest = [], max(r["n_tokens"], LANES)
        held.append(r)
    if held:
        yield held


# ---------------------------------------------------------------- tokens


def encode_doc(tokenizer, text: str) -> np.ndarray:
    return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


#: Classes of characters that the pre-tokenizer's pattern tells apart.
OTHER, LETTER, NUMBER, WHITE = range(4)
#: What the pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.lru_cache(1)
def char_class() -> np.ndarray:
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = ord("!")
    points = points.tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(name, points):
            out[m.start() : m.end()] = kind
    return out


def _split_suffixes(start: np.ndarray, text: np.ndarray, quote: np.ndarray, off: np.ndarray) -> None:
    """Makes pieces of 's 't 're 've 'm 'll 'd where a piece begins with an apostrophe (quote); text: code points or bytes."""
    if not len(quote):
        return
    n = len(text)
    room = np.searchsorted(off, quote, side="right")
    left = off[room] - quote - 1
    c1 = text[np.minimum(quote + 1, n - 1)] * (left >= 1)
    c2 = text[np.minimum(quote + 2, n - 1)] * (left >= 2)
    size = np.zeros(len(quote), np.int64)
    for suffix in SUFFIXES:
        same = (c1 == ord(suffix[0])) & ((len(suffix) == 1) | (c2 == ord(suffix[-1])))
        size = np.where((size == 0) & same, len(suffix), size)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    start[quote[size == 2] + 2] = False
    after = quote + 1 + size
    start[after[after < n]] = True
    # a blank after the suffix begins its own piece and takes what follows, as the mask already has it


def pretokens(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the byte-level pattern makes of texts given as code points (texts are not empty runs' sum)."""
    n = len(cp)
    kind = char_class()[cp]
    lead = np.zeros(n + 1, bool)
    lead[off] = True
    first, last = lead[:-1], lead[1:]
    white, solid = kind == WHITE, kind != WHITE
    before = np.concatenate([[False], kind[:-1] == kind[1:]]) & ~first  # the character before is of this kind
    prev_white = np.concatenate([[False], white[:-1]]) & ~first
    prev_blank = np.concatenate([[False], cp[:-1] == 32]) & ~first
    next_solid = np.concatenate([solid[1:], [False]]) & ~last
    start = first | (white & (~prev_white | next_solid)) | (solid & ~before & ~prev_blank)
    quote = np.flatnonzero((cp == 39) & (first | (np.concatenate([[OTHER], kind[:-1]]) != OTHER) & ~prev_blank))
    _split_suffixes(start, cp, quote, off)
    return np.flatnonzero(start)


@functools.lru_cache(1)
def ascii_class() -> bytes:
    return char_class()[:128].tobytes() + bytes(128)


def piece_starts(buf: np.ndarray, raw: bytes, off: np.ndarray) -> np.ndarray:
    """What pretokens finds, for texts given as UTF-8: the first bytes of the pieces. A character's later bytes have its class."""
    n = len(buf)
    kind = np.frombuffer(raw.translate(ascii_class()), np.uint8)
    high = np.flatnonzero(buf >= 128)
    if len(high):
        leads = (buf[high] & 0xC0) != 0x80
        classes = char_class()[np.frombuffer(buf[high].tobytes().decode().encode("utf-32-le"), np.uint32)]
        kind = kind.copy()
        kind[high] = classes[np.cumsum(leads) - 1]
    first = np.zeros(n + 1, bool)
    first[off] = True
    white, blank = kind == WHITE, buf == 32
    start = first[:-1].copy()
    new = kind[1:] != kind[:-1]  # of another class than the character before
    start[1:] |= new & (white[1:] | ~blank[:-1])
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:-1]  # the last white character before a solid one
    if len(high):
        lead = high[leads]
        wide = classes == WHITE  # white characters of several bytes
        at, size = lead[wide], np.diff(np.append(np.flatnonzero(leads), len(high)))[wide]
        after = np.minimum(at + size, n - 1)
        start[high[~leads]] = False
        start[at] |= (at + size < n) & ~white[after] & ~first[after]
    quote = np.flatnonzero(buf == 39)
    if len(quote):
        before = np.maximum(quote - 1, 0)
        quote = quote[first[quote] | (kind[before] != OTHER) & ~blank[before]]
        _split_suffixes(start, buf, quote, off)
    return np.flatnonzero(start)


def special_docs(raw: bytes, off: np.ndarray, specials: tuple[bytes, ...]) -> np.ndarray:
    """Texts that spell a special token; the library encodes them whole."""
    hits = []
    for s in specials:
        at = raw.find(s)
        while at >= 0:
            hits.append(at)
            at = raw.find(s, at + 1)
    return np.unique(np.searchsorted(off, np.array(hits, np.int64), side="right") - 1)


#: The settings that the vectorised pre-tokenizer is made for.
EXPECTED = {"normalizer": None, "truncation": None, "padding": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


def check_settings(spec: dict) -> None:
    """Raises if the tokenizer splits texts in another way than pretokens does."""
    for name, value in EXPECTED.items():
        if spec.get(name) != value:
            raise ValueError(f"tokenizer setting {name} is {spec.get(name)!r}; only {value!r} is supported")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        raise ValueError("a byte-level BPE model without dropout is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in white space or stand between words only are not supported")


class UnitEncoder:
    """Encodes blocks of texts; each distinct piece of the pre-tokenizer meets the library's model once while remembered.

    The longest text of up to SAMPLE_BYTES of every block is encoded whole by the library too; a difference raises.
    """

    SAMPLE_BYTES = 4096

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.table = Tokenizer.from_file(path), end_id, ShortUnitTable()
        check_settings(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.specials = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that byte-level vocabularies write as themselves
        self.spell = np.arange(256, dtype=np.uint32)
        self.spell[[b for b in range(256) if b not in printable]] = 256 + np.arange(256 - len(printable))

    def fresh(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces by the library's model."""
        size = end - start
        text = self.spell[buf[X.ragged(start, size)]].tobytes().decode("utf-32-le")
        last = np.cumsum(size)
        merge = self.model.tokenize
        tokens = [merge(text[a:b]) for a, b in zip((last - size).tolist(), last.tolist())]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter(map(operator.attrgetter("id"), itertools.chain.from_iterable(tokens)), np.int32, int(counts.sum())), counts

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, and how many each text has."""
        n = len(off) - 1
        if not len(buf):
            return np.full(n, self.end_id, np.int32), np.ones(n, np.int64)
        raw = buf.tobytes()
        start = piece_starts(buf, raw, off)
        end = np.append(start[1:], len(buf))
        odd = special_docs(raw, off, self.specials)
        bounds = np.searchsorted(start, off)  # pieces of each text
        if len(odd):
            keep = np.ones(len(start), bool)
            for d in odd.tolist():
                keep[bounds[d] : bounds[d + 1]] = False
            start, end = start[keep], end[keep]
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        wide = np.frombuffer(raw + bytes(SHORT), np.uint8)
        ids, per = self.table(wide, start, end, lambda i: self.fresh(wide, start[i], end[i]))
        total = np.diff(np.concatenate([[0], np.cumsum(per)])[bounds]) + 1
        whole = {int(d): encode_doc(self.tokenizer, raw[off[d] : off[d + 1]].decode()) for d in odd}
        for d, p in whole.items():
            total[d] = len(p) + 1
        out = np.empty(int(total.sum()), np.int32)
        ends = np.cumsum(total)
        regular = np.ones(len(out), bool)
        regular[ends - 1] = False
        for d, p in whole.items():
            out[ends[d] - 1 - len(p) : ends[d] - 1] = p
            regular[ends[d] - 1 - len(p) : ends[d] - 1] = False
        out[regular] = ids
        out[ends - 1] = self.end_id
        self._compare(raw, off, out, total, ends)
        return out, total

    def _compare(self, raw: bytes, off: np.ndarray, out: np.ndarray, total: np.ndarray, ends: np.ndarray) -> None:
        sizes = np.diff(off)
        d = int(np.where(sizes <= self.SAMPLE_BYTES, sizes, -1).argmax())
        if sizes[d] <= self.SAMPLE_BYTES and not np.array_equal(out[ends[d] - total[d] : ends[d] - 1], encode_doc(self.tokenizer, raw[off[d] : off[d + 1]].decode())):
            raise ValueError(f"text {d} of a block differs from the library's ids")


@functools.lru_cache(2)
def encoder(path: str, end_id: int) -> UnitEncoder:
    return UnitEncoder(path, end_id)


# ---------------------------------------------------------------- Spark


def _tokenise(path: str, end_id: int, vocab: int):
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, []
        counts, code = np.zeros(vocab, np.int64), encoder(path, end_id)

        def close(held, block):
            ids = np.concatenate([h[2] for h in held])
            return C.table_of(schema, kind=[0], part=[part], block=[block], doc_ids=[[d for h in held for d in h[0]]], lengths=[np.concatenate([h[1] for h in held])], n_tokens=[len(ids)], ids=[C.pack(ids.astype(np.uint32 if vocab > 65536 else np.uint16))])

        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in C.blocks(buf, off, 1 << 19):
                ids, lengths = code(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts += np.bincount(ids, minlength=vocab)
                held.append((names[i:j], lengths, ids))
                if sum(len(h[2]) for h in held) >= BLOCK:
                    yield close(held, block)
                    block, held = block + 1, []
        if held:
            yield close(held, block)
        yield C.table_of(schema, kind=[1], part=[part], block=[-1], doc_ids=[[]], lengths=[[]], n_tokens=[int(counts.sum())], ids=[C.pack(counts)])

    return run


def _sum_counts(vocab: int):
    schema = pa.schema([("ids", pa.binary())])

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for b in batch.column("ids").to_pylist():
                total += C.unpack(b, np.int64)
        yield C.table_of(schema, ids=[C.pack(total)])

    return run


def _encode(freq: bytes, vocab: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("states", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())])

    def run(batches):
        f = C.unpack(freq, np.int64)
        cum = np.cumsum(f) - f

        def coded(rows):
            for part in groups(rows, TOGETHER):
                ids = [C.unpack(r["ids"], np.uint32 if vocab > 65536 else np.uint16) for r in part]
                yield from zip(part, ids, encode_blocks(ids, f, cum))

        for batch in batches:
            for r, ids, (lanes, states, words) in coded(batch.to_pylist()):
                yield C.table_of(schema, part=[r["part"]], block=[r["block"]], doc_ids=[r["doc_ids"]], lengths=[r["lengths"]], n_tokens=[r["n_tokens"]], lanes=[lanes], states=[states.tobytes()], words=[words.tobytes()], crc32=[zlib.crc32(ids.astype("<u4").tobytes())])

    return run


def _decode(freq: bytes, with_ids: bool):
    fields = [("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        f = C.unpack(freq, np.int64)
        cum = np.cumsum(f) - f
        slot = np.repeat(np.arange(len(f), dtype=np.int32), f)

        def opened(rows):
            for part in groups(rows, TOGETHER):
                yield from zip(part, decode_blocks([(r["n_tokens"], r["lanes"], np.frombuffer(r["states"], np.uint64), np.frombuffer(r["words"], np.uint32)) for r in part], f, cum, slot))

        for batch in batches:
            for r, ids in opened(batch.to_pylist()):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"checksum of block {r['part']}/{r['block']} differs")
                lengths = np.asarray(r["lengths"], np.int64)
                begin = np.cumsum(lengths) - lengths
                more = {"ids": [ids[b : b + n] for b, n in zip(begin, lengths)]} if with_ids else {}
                yield C.table_of(schema, part=[r["part"]] * len(lengths), block=[r["block"]] * len(lengths), doc_id=r["doc_ids"], begin=begin, n_tokens=lengths, ids_crc32=[zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), lengths.tolist())], **more)

    return run


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """A query that runs inside removes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0) -> str:
    """Encodes whole texts, appends end_id to each document and writes the dataset in folder out, by ascending doc_id."""
    from tokenizers import Tokenizer

    spark = C.tune(docs.sparkSession)
    vocab = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(C.parts(spark), -(-C.text_bytes(slim) // RANGE_TEXT))
    ordered = slim.withColumn("mark", F.xxhash64("text")).repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    with _shuffles_go(spark):  # the texts' shuffle need not lie beside the ids and the files
        staged = C.stage(ordered.drop("mark").mapInArrow(_tokenise(tokenizer_path, end_id, vocab), STAGED))
    hist = staged.filter("kind = 1").select("ids").coalesce(8).mapInArrow(_sum_counts(vocab), "ids binary").collect()
    counts = sum((C.unpack(r["ids"], np.int64) for r in hist), np.zeros(vocab, np.int64))
    freq = frequencies(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/table")
    staged.filter("kind = 0").mapInArrow(_encode(C.pack(freq), vocab), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{out}/blocks")
    C.drop(staged)
    return out


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    C.tune(spark)
    table = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    freq = np.array([r["freq"] for r in table], np.int64)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    per_part = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a file, not a block
    before = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", "n_tokens").withColumn("b0", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("n_tokens").join(before, "part").select("part", "block", (F.col("p0") + F.col("b0")).alias("base"))
    schema = "part int, block int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    rows = blocks.mapInArrow(_decode(C.pack(freq), with_ids), schema)
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = C.scratch(spark, "tokens")
    write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, out)
