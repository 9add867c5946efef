"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

No piece of a merge vocabulary trained with split_by_whitespace holds a white-space mark after another character, so
merges never cross the start of a white-space run. Texts are cut there into units; each distinct unit runs through the
agenda once while it is remembered, and every new unit is checked against the sentencepiece library, an Arrow batch at
a time; so is one whole document of each block. A difference raises.

Null or empty text: only the end id, decoded to "". A literal U+2581 counts as a space, as in the library. Repeated
rows give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X
from quillspark.llm._units import UnitTable

MARK = "▁"
#: Kinds of pieces in the model file (fixed values).
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
SHORT, NEVER = 48, np.iinfo(np.int32).max


class Rows:
    """Short rows of numbers behind one another."""

    def __init__(self, rows: list, kind):
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.fromiter(itertools.chain.from_iterable(rows), kind, int(self.size.sum()))

    def followed_by(self, other: Rows) -> Rows:
        out = Rows([], self.flat.dtype)
        out.flat, out.size = np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size])
        out.start = np.cumsum(out.size) - out.size
        return out

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows at, joined, and the size of each."""
        size = self.size[at]
        return self.flat[X.ragged(self.start[at], size)], size


class PieceModel:
    """The vocabulary with its own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("a merge-type model with identity normalisation and a leading space is needed")
        self.rank, self.byte_ids, self.surface = {}, {}, {}
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {p.piece!r} crosses white space")
                self.rank[p.piece] = (-p.score, i)
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        self._tables()
        self._spellings()
        self.eos = self.library.eos_id()

    def _tables(self) -> None:
        """Numbers the symbols and lists every pair of symbols that makes a piece, in a probed hash table."""
        names = list(self.rank)
        chars = sorted({c for p in names for c in p} - self.rank.keys())
        number = self._number = {p: i for i, p in enumerate(names + chars)}
        order = {x: i for i, x in enumerate(sorted({r[0] for r in self.rank.values()}))}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        rows = [(number[p[:k]], number[p[k:]], i, order[self.rank[p][0]]) for i, p in enumerate(names) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, made, cost = (np.array(x, np.int64) for x in zip(*rows))
        self.size, self.bits = len(number), 20
        keys = left * self.size + right
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_made, self.slot_cost = np.zeros(len(self.slot_key), np.int32), np.zeros(len(self.slot_key), np.int32)
        self.probes = 1
        for k, m, c, h in zip(keys.tolist(), made.tolist(), cost.tolist(), self._slot(keys).tolist()):
            step = 0
            while self.slot_key[h + step] != -1:
                step += 1
            self.slot_key[h + step], self.slot_made[h + step], self.slot_cost[h + step] = k, m, c
            self.probes = max(self.probes, step + 1)

    def _spellings(self) -> None:
        """Ids that each symbol gives; and of every id its bytes and its decimal digits with a blank behind."""
        symbols = sorted((i, c) for c, i in self._number.items())
        own = [[self.rank[c][1]] if c in self.rank else [self.byte_ids[b] for b in c.encode()] for _, c in symbols]
        self.own = Rows(own, np.int32)
        ids = range(self.library.get_piece_size())
        self.spoken = Rows([list(self.surface.get(i, b"")) for i in ids], np.uint8)
        self.digits = Rows([list(b"%d " % i) for i in ids], np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(X.RADIX)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _costs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (NEVER: no piece) and merged symbol of pairs."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0) | (left >= self.size) | (right >= self.size)] = -2
        cost, made = np.full(keys.shape, NEVER, np.int32), np.zeros(keys.shape, np.int32)
        flat_cost, flat_made, keys = cost.reshape(-1), made.reshape(-1), keys.reshape(-1)
        at = self._slot(keys)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            found = self.slot_key[at + step]
            hit = found == keys
            if hit.any():
                flat_cost[open_[hit]], flat_made[open_[hit]] = self.slot_cost[at[hit] + step], self.slot_made[at[hit] + step]
            go = ~hit & (found != -1)
            if not go.any():
                break
            open_, at, keys = open_[go], at[go], keys[go]
        return cost, made

    def batch_ids(self, units: list[str]) -> list[list[int]]:
        """unit_ids of many units."""
        flat, counts = self.flat_ids(units)
        ends = np.cumsum(counts)
        return [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist())]

    def flat_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units one after another, and how many each has.

        One agenda a row: each round every row merges its best leftmost pair. Long units go through the heap.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for low, high in ((0, 8), (8, 12), (12, 18), (18, 28), (28, SHORT)):
            mine = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(mine):
                self._rows(mine, [units[i] for i in mine], lengths[mine], high, found)
        for i in np.flatnonzero((lengths > SHORT) | (lengths == 0)).tolist():
            ids = self.unit_ids(units[i])
            found.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
        who, counts, flat = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(who)
        begins = np.cumsum(counts) - counts
        return flat[X.ragged(begins[order], counts[order])], counts[order]

    def _rows(self, mine, units, lengths, width, found) -> None:
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int32)
        inside = np.arange(width) < lengths[:, None]
        sym = np.full((len(units), width), -2, np.int32)
        known = self.char[points]
        sym[inside] = np.where(known >= 0, known, self.size + points)  # characters of no piece are symbols of their own
        cost, made = self._costs(sym[:, :-1], sym[:, 1:])
        row, columns = np.arange(len(units)), np.arange(width - 1)
        while True:
            best = cost.argmin(axis=1)
            live = cost[np.arange(len(row)), best] != NEVER
            if not live.all():
                self._finish(mine[row[~live]], sym[~live], found)
                row, sym, cost, made, best = row[live], sym[live], cost[live], made[live], best[live]
            if not len(row):
                return
            each = np.arange(len(row))
            sym[each, best] = made[each, best]
            move = columns + (columns > best[:, None])  # drop what stands right of the merged pair
            sym[:, :-1] = np.take_along_axis(sym, move, 1)
            sym[:, -1] = -2
            move = np.minimum(columns + (columns >= best[:, None]), width - 2)
            cost, made = np.take_along_axis(cost, move, 1), np.take_along_axis(made, move, 1)
            cost[:, -1] = NEVER
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 1)
                cost[each[ok], at[ok]], made[each[ok], at[ok]] = self._costs(sym[each[ok], at[ok]], sym[each[ok], at[ok] + 1])

    def _finish(self, who, sym, found) -> None:
        """Ids of finished rows; a symbol that is no piece gives the ids of its bytes."""
        there = sym != -2
        symbols = sym[there]
        rows = np.cumsum(there.sum(axis=1))
        odd = symbols >= self.size
        if odd.any():
            points, at = np.unique(symbols[odd], return_inverse=True)
            strange = Rows([[self.byte_ids[b] for b in chr(p - self.size).encode()] for p in points.tolist()], np.int32)
            symbols[odd] = self.size + at
            ids, sizes = self.own.followed_by(strange).take(symbols)
        else:
            ids, sizes = self.own.take(symbols)
        total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], rows])]
        found.append((who, np.diff(total), ids))

    def symbols(self, unit: str) -> list[str]:
        """Merges adjacent symbols, best score first and leftmost among equals, until no pair is a piece.

        The agenda is a heap whose stale pairs are skipped: n log n for units without white space.
        """
        sym = list(unit)
        n, rank = len(sym), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = rank.get(sym[i] + sym[i + 1])
            if found:
                agenda.append((found[0], i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue  # one side has merged since
            sym[i] += sym[j]
            sym[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get(sym[i] + sym[k])
                if found:
                    heapq.heappush(agenda, (found[0], i, size + len(sym[k])))
            h = before[i]
            if h >= 0:
                found = rank.get(sym[h] + sym[i])
                if found:
                    heapq.heappush(agenda, (found[0], h, size + len(sym[h])))
        return [s for s in sym if s is not None]

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for s in self.symbols(unit):
            found = self.rank.get(s)
            if found:
                out.append(found[1])
            else:
                out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without the end id."""
        if not text:
            return []
        return self.unit_ids(MARK + text.replace(" ", MARK))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text; end ids vanish, the leading space goes, broken byte runs become U+FFFD."""
        raw = self.decode_bytes([i for i in ids if i in self.surface])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class UnitCache:
    """Encodes blocks of texts through their distinct units."""

    def __init__(self, path: str):
        self.model, self.table = PieceModel(path), UnitTable(slots=1 << 20, limit=2 << 20)  # workers live on beside other stages

    def fresh(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units, checked against the library; they must decode to the units' own bytes."""
        model = self.model
        spans = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        units = [s.decode().replace(" ", MARK) for s in spans]
        ids, counts = model.flat_ids(units)
        # the library puts the first mark itself, and none before an empty text: a lone mark can't be asked of it
        theirs = [b if u != MARK else model.unit_ids(u) for u, b in zip(units, model.library.encode([u[1:] for u in units], num_threads=1))]
        agreed = np.array_equal(counts, np.fromiter(map(len, theirs), np.int64, len(theirs))) and np.array_equal(ids, np.fromiter(itertools.chain.from_iterable(theirs), np.int32))
        if not agreed:
            u, b = next((u, b) for u, a, b in zip(units, model.batch_ids(units), theirs) if a != b)
            raise ValueError(f"unit {u!r} is {b} in the library")
        if model.spoken.take(ids)[0].tobytes() != b"".join(spans):
            raise ValueError("a new unit does not decode to itself")
        return ids, counts

    def block(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, bytes, bytes, np.ndarray]]:
        """(number of ids with the end id, their decimal form, decoded bytes, ids without the end id) of each text."""
        raw = buf.tobytes()
        texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        texts = [b" " + t if t else t for t in texts]
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        end_id = str(self.model.eos).encode()
        if not len(buf):
            return [(1, end_id, b"", np.zeros(0, np.int32))] * len(texts)
        blank = buf == 32
        lead = np.zeros(len(buf) + 1, bool)
        lead[off] = True
        start = np.flatnonzero(blank & (lead[:-1] | np.concatenate([[True], ~blank[:-1]])))
        end = np.append(start[1:], len(buf))
        ids, sizes = self.table(buf, start, end, lambda i: self.fresh(raw, start[i], end[i]))
        cut = _edges(sizes)[np.searchsorted(start, off)]  # where each text's ids begin
        spoken, per = self.model.spoken.take(ids)
        said = _edges(per)[cut].tolist()
        digits, per = self.model.digits.take(ids)
        written, spoken, digits = _edges(per)[cut].tolist(), spoken.tobytes(), digits.tobytes()
        cut = cut.tolist()
        return [(cut[i + 1] - cut[i] + 1, digits[written[i] : written[i + 1]] + end_id, spoken[said[i] + 1 : said[i + 1]], ids[cut[i] : cut[i + 1]]) for i in range(len(texts))]


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


@C.kept
def cache(path: str) -> UnitCache:
    return UnitCache(path)


def _run(path: str, full: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if full else [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        units = cache(path)
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            names = batch.column("doc_id")
            for i, j in C.blocks(buf, off, 1 << 19):
                rows = units.block(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                text = buf[off[i] : off[i + 1]].tobytes().decode()
                if rows[0][1].decode().split(" ") != [*map(str, units.model.library.encode(text, num_threads=1)), str(units.model.eos)]:
                    raise ValueError(f"document {names[i]} differs from the library's ids")
                if rows[0][2].decode() != units.model.library.decode([*map(int, rows[0][1].split(b" "))]):
                    raise ValueError(f"document {names[i]} differs from the library's text")
                common = {"doc_id": names.slice(i, j - i), "n_tokens": [r[0] for r in rows]}
                if full:
                    yield C.table_of(schema, **common, ids=[np.append(r[3], np.int32(units.model.eos)) for r in rows], decoded=[r[2].decode() for r in rows])
                else:
                    yield C.table_of(schema, **common, ids_sha256=[hashlib.sha256(r[1]).hexdigest() for r in rows], decoded_sha256=[hashlib.sha256(r[2]).hexdigest() for r in rows])
            C.trim()

    return run


def encode_decode(docs: DataFrame, model_path: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, then ids and decoded text (full) or their SHA-256. Needs no shuffle."""
    C.tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tail = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(_run(model_path, full), f"doc_id bigint, n_tokens bigint, {tail}")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
