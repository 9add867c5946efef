"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on the full sets.

A document's set holds the hashes of its distinct k-word shingles. A SetSketch (Ertl 2021) keeps, for each of REGISTERS
hash functions, the minimum of exponentially distributed values, truncated to exponentially spaced levels of base BASE:
register = floor(1 - log_BASE(minimum)). Registers merge by maximum and agree between two sets with a probability near
their Jaccard similarity. BANDS bands of registers are hashed; sets that agree in a band are candidates. At similarity
0.8 a pair shares no band with a probability below 1e-6.

1. Documents with equal words (by a 128-bit BLAKE2 digest) form a class; one row a class goes on, so copies cost nothing
   further.
2. Each bucket of a band proposes its smallest class (its centre) to its other classes: a star, not all pairs. A class
   verifies one link on the full sets, with the centre that shares most bands; components follow by star contraction.
   Then each bucket holds one class for each of its components, and proposes the smallest component's to the others:
   one link is verified for each two components.
3. In a bucket that still holds several components the rows outside the largest one meet each other and its rows, in
   blocks of about BLOCK rows. At first only registers are sent: a pair of blocks tells which of its rows have a partner
   of another component whose joint maximum-likelihood estimate is within DEVIATIONS deviations of the threshold. Only
   these rows are sent again with their texts, and verified on the full sets, each pair in the first band that it
   shares; a link joins its components there, so a row gives one link for each component that it joins, and pairs are
   no rows. No bucket is capped: a large one is spread over blocks. A bucket of n rows that are not linked still sends
   the registers (576 bytes) of each n/BLOCK times, but no text.

So the members of a group cost one link each, and what is verified after that lies between components only.
Steps 1 and 2 ship packed texts, grouped by the link's centre and cut into groups of at most about FAN links.

Sets are compared by 61-bit hashes first; every link is then confirmed on the shingles' own bytes.

A document with fewer than k words, but some, has one shingle: the whole sequence. Null, empty or blank texts have no
set, link with nothing and are kept. Rows with a null doc_id are no nodes: component null, kept. Rows that share a
doc_id are one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm import _text as X
from quillspark.llm.components import components

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
BLOCK = 1024
#: Shingles of a block's rows; long texts make blocks of fewer rows.
BLOCK_SHINGLES = 1 << 20
#: Links of one centre that a task verifies at once.
FAN = 64
#: Deviations below the threshold that a pair's estimate may lie to be verified still.
DEVIATIONS = 4.5
BROADCAST_BYTES = 32 << 20

_SEED = X.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * X.U(X.RADIX))
MULTIPLY = (_SEED >> X.U(32)).astype(np.uint32) | np.uint32(1)
ADD = _SEED.astype(np.uint32)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and how many each document has."""
    h, n = X.word_hashes(buf, off)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, 0)
    at = X.ragged(first, count)
    doc = np.repeat(np.arange(len(n)), count)
    sh = X.chain_hash([h[at + i] for i in range(k)]) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([X.chain_hash([h[first[d] + i : first[d] + i + 1] for i in range(n[d])])[0] for d in short], np.uint64)
        sh, doc = np.concatenate([sh, whole]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    if len(sh):
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])])
        sh, doc = sh[new], doc[new]
    return sh, np.bincount(doc, minlength=len(n))


def plain_words(body: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return body.translate(X.LOWER.tobytes()).split()  # bytes split at exactly \x20 and \x09-\x0D


def linked_exactly(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """Whether the shingle sets of two texts, as strings, are similar enough: confirms what their hashes say."""

    def shingles(body: bytes) -> set:
        w = plain_words(body)
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    one, two = shingles(a), shingles(b)
    both = len(one & two)
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def registers(sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of the documents that have a set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    if not len(starts):
        return np.zeros((0, REGISTERS), np.uint16)
    x = (sh >> X.U(32)).astype(np.uint32)
    best = np.empty((REGISTERS, len(starts)), np.uint32)
    for i in range(REGISTERS):  # the least exponential value has the largest uniform one
        best[i] = np.maximum.reduceat(x * MULTIPLY[i] + ADD[i], starts)
    least = -np.log((best.T.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    wide = reg.reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    key = X.mix(np.arange(BANDS, dtype=np.uint64) + X.U(7))[None, :]
    for r in range(ROWS):
        key = X.mix(key * X.U(X.RADIX) + wide[:, :, r])
    return key.view(np.int64)


def likely_jaccard(greater: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the similarity from how registers compare and the sets' known sizes."""
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 201)[None, :], np.minimum(u / v, v / u))

    def level(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(level(u - v * j), 1e-12), np.maximum(level(v - u * j), 1e-12)
    equal = np.maximum(1 - up - down, 1e-12)
    same = REGISTERS - greater - less
    fit = greater[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(equal)
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], 1)[:, 0]


# ---------------------------------------------------------------- Spark


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("reg", pa.binary())])

    def run(batches):
        C.free()
        for batch in batches:
            buf, off = C.texts_of(batch.column("text"))
            names = batch.column("doc_id")
            for i, j in C.blocks(buf, off, 1 << 19):
                sh, counts = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                reg = iter(registers(sh, counts))
                raw = buf[off[i] : off[j]].tobytes()
                body = [raw[a - off[i] : b - off[i]] for a, b in zip(off[i:j], off[i + 1 : j + 1])]
                digest = [hashlib.blake2b(b" ".join(plain_words(b)), digest_size=16).digest() if c else None for b, c in zip(body, counts)]
                yield C.table_of(schema, doc_id=names.slice(i, j - i), n_shingles=counts, digest=digest, reg=[next(reg).tobytes() if c else None for c in counts])
            C.trim()

    return run


def _bands(batches):
    schema = pa.schema([("band", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        reg = np.frombuffer(b"".join(batch.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(reg)
        yield C.table_of(schema, band=keys.reshape(-1), node=np.repeat(batch.column("node").to_numpy(), BANDS), n=np.repeat(batch.column("n").to_numpy(), BANDS))
        C.trim()


def _pack_texts(batches):
    schema = pa.schema([("node", pa.int64()), ("body", pa.binary())])
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield C.table_of(schema, node=batch.column("doc_id"), body=[packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()])
        C.trim()


def _verify(k: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        head = table.column("head").to_numpy(zero_copy_only=False)
        if not head.any() or head.all():
            return schema.empty_table()
        opener = zstandard.ZstdDecompressor()
        centre_body = opener.decompress(table.column("body")[int(head.argmax())].as_py())
        centre, _ = shingle_sets(np.frombuffer(centre_body, np.uint8), np.array([0, len(centre_body)]), k)
        rows = np.flatnonzero(~head)
        bodies = [opener.decompress(table.column("body")[int(r)].as_py()) for r in rows]
        off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        buf = np.frombuffer(b"".join(bodies), np.uint8)
        linked = np.zeros(len(rows), bool)
        for i, j in C.blocks(buf, off):
            sh, counts = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
            at = np.minimum(np.searchsorted(centre, sh), max(0, len(centre) - 1))
            hit = (centre[at] == sh) if len(centre) else np.zeros(len(sh), bool)
            both = np.bincount(np.repeat(np.arange(j - i), counts), weights=hit, minlength=j - i).astype(np.int64)
            linked[i:j] = (100 * both >= percent * (len(centre) + counts - both)) & (counts > 0)
        for i in np.flatnonzero(linked).tolist():
            linked[i] = linked_exactly(centre_body, bodies[i], k, percent)
        node = table.column("node").to_numpy()
        del buf, bodies
        C.trim()
        return pa.table({"u": table.column("centre").to_numpy()[rows[linked]], "v": node[rows[linked]]}, schema=schema)

    return run


def _block_links(k: int, percent: int, scout: bool = False):
    """Links between components in one pair of blocks of a bucket: likely pairs, verified on the full sets.

    A scout needs no texts: it returns the rows of the pair of blocks that have a likely partner, not the pairs.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    seen = pa.schema([("band", pa.int64()), ("across", pa.bool_()), ("p", pa.int64()), ("q", pa.int64()), ("node", pa.int64())])
    low = percent / 100 - DEVIATIONS * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def likely(reg, n, comp, band, sides):
        """Of each row the rows it may be linked with."""
        cells = reg.reshape(len(reg), BANDS, ROWS)
        here = int(np.flatnonzero(band_keys(reg[:1])[0] == band)[0])
        for i, right in sides:
            j = right[comp[right] != comp[i]]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            if len(j) and here:
                j = j[~(cells[j, :here] == cells[i, :here]).all(axis=2).any(axis=1)]
            if len(j):
                greater, less = (reg[i] > reg[j]).sum(axis=1), (reg[i] < reg[j]).sum(axis=1)
                j = j[likely_jaccard(greater, less, np.full(len(j), n[i], float), n[j].astype(float)) >= low]
            if len(j):
                yield i, j

    def opened(bodies, row) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bodies[row].as_py())

    def sets(bodies, rows):
        """Local numbers of the rows' shingles: (numbers, how many there are, begin and end of each row)."""
        opener = zstandard.ZstdDecompressor()
        texts = [opener.decompress(bodies[r].as_py()) for r in rows.tolist()]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        parts = [shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k) for i, j in C.blocks(buf, off)]
        names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        ends = np.cumsum(np.concatenate([p[1] for p in parts]))
        return at, len(names), np.concatenate([[0], ends[:-1]]), ends

    def run(table: pa.Table) -> pa.Table:
        node, comp, n, blk = (table.column(c).to_numpy() for c in ("node", "comp", "n", "blk"))
        comp = comp.copy()
        major = table.column("in_major").to_numpy(zero_copy_only=False)
        band, across, p, q = (table.column(c)[0].as_py() for c in ("band", "across", "p", "q"))
        reg = np.frombuffer(b"".join(table.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        if across:
            right = np.flatnonzero(major)
            sides = ((i, right) for i in np.flatnonzero(~major).tolist())
        elif p == q:
            sides = ((i, np.arange(i + 1, len(node))) for i in range(len(node)))
        else:
            right = np.flatnonzero(blk == q)
            sides = ((i, right) for i in np.flatnonzero(blk == p).tolist())
        if scout:
            partner = np.zeros(len(node), bool)
            for i, j in likely(reg, n, comp, band, sides):
                partner[i] = True
                partner[j] = True
            where = np.flatnonzero(partner)
            return table.select(["band", "across", "p", "q", "node"]).take(pa.array(where)).cast(seen)
        found = list(likely(reg, n, comp, band, sides))
        out: list[tuple[int, int]] = []
        if found:
            rows = np.unique(np.concatenate([np.append(j, i) for i, j in found]))
            bodies = table.column("body")
            number, size, begin, end = sets(bodies, rows)
            mine = np.zeros(size, bool)
            for i, j in found:
                j = j[comp[j] != comp[i]]  # links found on the way may have joined them
                if not len(j):
                    continue
                a, b = np.searchsorted(rows, i), np.searchsorted(rows, j)
                own = number[begin[a] : end[a]]
                mine[own] = True
                count = end[b] - begin[b]
                both = np.add.reduceat(mine[number[X.ragged(begin[b], count)]].astype(np.int64), np.cumsum(count) - count)
                mine[own] = False
                for x in j[100 * both >= percent * (len(own) + count - both)].tolist():
                    if comp[x] != comp[i] and linked_exactly(opened(bodies, i), opened(bodies, x), k, percent):
                        out.append((int(node[i]), int(node[x])))
                        comp[comp == comp[x]] = comp[i]
        C.trim()
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())}, schema=schema)

    return run


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packed texts of the wanted nodes, staged. A short list of nodes is broadcast, a long one is joined by shuffle."""
    wanted = F.broadcast(nodes) if nodes.count() * 16 <= BROADCAST_BYTES else nodes
    return C.stage(docs.join(wanted, docs["doc_id"] == nodes["node"], "left_semi").mapInArrow(_pack_texts, "node bigint, body binary"))


def _verified(docs: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (centre, node) that hold on the full sets, staged as (u, v)."""
    links = C.stage(links)
    nodes = C.stage(links.select("node").union(links.select(F.col("centre").alias("node"))).distinct())
    texts = _texts(docs, nodes)
    hot = C.stage(links.groupBy("centre").agg(F.count("*").alias("degree")).filter(F.col("degree") > FAN))
    cut = links.join(_sized(hot, 16), "centre", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("degree", F.lit(1)) / FAN))).drop("degree")
    members = cut.join(texts, "node").select("centre", "salt", "node", "body", F.lit(False).alias("head"))
    heads = cut.select("centre", "salt").distinct().join(texts.withColumnRenamed("node", "centre"), "centre").select("centre", "salt", F.col("centre").alias("node"), "body", F.lit(True).alias("head"))
    out = C.stage(members.union(heads).groupBy("centre", "salt").applyInArrow(_verify(k, percent), "u bigint, v bigint"))
    C.drop(links, nodes, texts, hot)
    return out


def _sized(side: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a staged side for broadcast if its counted rows fit; otherwise the join shuffles."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def _close(n: str, m: str, percent: int):
    """Sizes of sets that can be similar enough."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _first_links(bands: DataFrame, percent: int) -> DataFrame:
    """(centre, node): one link for each class, with the centre of its buckets that shares most bands, then the smallest."""
    centres = bands.groupBy("band").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("rows")).filter("rows > 1")
    stars = bands.join(centres, "band").filter((F.col("node") != F.col("c.node")) & _close("n", "c.n", percent))
    shared = stars.groupBy("node", F.col("c.node").alias("centre")).agg(F.count("*").alias("shared"))
    best = shared.groupBy("node").agg(F.max(F.struct("shared", (-F.col("centre")).alias("less"))).alias("top"))
    return C.stage(best.select((-F.col("top.less")).alias("centre"), "node"))


def _links_between(named: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(centre, node): one link for each two components whose smallest members in some bucket meet there."""
    held = named.groupBy("band", "comp").agg(F.min(F.struct("node", "n")).alias("one"))
    first = held.groupBy("band").agg(F.min(F.struct("comp", "one")).alias("c"), F.count("*").alias("comps")).filter("comps > 1")
    met = held.join(first, "band").filter((F.col("comp") != F.col("c.comp")) & _close("one.n", "c.one.n", percent))
    link = F.struct(F.col("c.one.node").alias("centre"), F.col("one.node").alias("node"))
    links = met.groupBy(F.col("c.comp").alias("other"), "comp").agg(F.min(link).alias("link")).select("link.*")
    return links.join(tested, ["centre", "node"], "left_anti")


def _named(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Band rows (band, node, n) with their components, staged."""
    roots = forest.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return C.stage(rows.join(roots, "node", "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp")))


def _joined(forest: DataFrame, links: DataFrame) -> DataFrame:
    return components(forest.union(links)) if links.limit(1).count() else forest


def _links_in_mixed(docs: DataFrame, named: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (u, v) of the buckets that hold several components, staged."""
    per = named.groupBy("band", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    mixed = per.groupBy("band").agg(F.max(F.struct("rows", "comp", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    mixed = mixed.select("band", F.col("top.comp").alias("major"), blocks(F.col("top.rows"), F.col("top.n")).alias("nj"), blocks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("ni"))
    placed = named.join(mixed, "band").withColumn("in_major", F.col("comp") == F.col("major")).withColumn("blk", F.pmod(F.xxhash64("node"), F.when(F.col("in_major"), F.col("nj")).otherwise(F.col("ni"))))
    meets = """if(in_major, transform(sequence(0L, ni - 1), i -> struct(true as across, blk as p, i as q)),
      concat(transform(sequence(0L, nj - 1), j -> struct(true as across, j as p, blk as q)), transform(sequence(0L, ni - 1), i -> struct(false as across, least(blk, i) as p, greatest(blk, i) as q))))"""
    spread = C.stage(placed.withColumn("g", F.explode(F.expr(meets))).select("band", "node", "n", "comp", "in_major", "blk", "g.across", "g.p", "g.q"))
    keys = ["band", "across", "p", "q"]
    columns = [*keys, "node", "n", "comp", "in_major", "blk", "reg"]
    sketched = spread.join(classes.select("node", "reg"), "node").select(*columns)
    met = C.stage(sketched.groupBy(*keys).applyInArrow(_block_links(k, percent, scout=True), "band bigint, across boolean, p bigint, q bigint, node bigint"))
    nodes = C.stage(met.select("node").distinct())
    texts = _texts(docs, nodes)
    held = sketched.join(met, [*keys, "node"], "left_semi").join(texts, "node").select(*columns, "body")
    out = C.stage(held.groupBy(*keys).applyInArrow(_block_links(k, percent), "u bigint, v bigint"))
    C.drop(spread, met, nodes, texts)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept, for every row of docs (doc_id, text)."""
    C.tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = C.stage(slim.mapInArrow(_sketch(k), "doc_id bigint, n_shingles bigint, digest binary, reg binary"))
    full = sketched.filter("digest is not null and doc_id is not null")
    classes = C.stage(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("reg").alias("reg")))
    bands = C.stage(classes.select("node", "n", "reg").mapInArrow(_bands, "band bigint, node bigint, n bigint"))

    first = _first_links(bands, percent)
    linked = _verified(slim, first, k, percent)
    forest = components(linked)
    shared = bands.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1").select("band")
    named = _named(bands.join(shared, "band"), forest)
    again = _verified(slim, _links_between(named, first, percent), k, percent)
    forest = _joined(forest, again)
    final_names = _named(named.drop("comp"), forest)
    more = _links_in_mixed(slim, final_names, classes, k, percent)
    final = _joined(forest, more)
    root = classes.select("digest", "node").join(final.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(root, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    C.drop(bands, first, linked, named, again, final_names, more)
    return result


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)
