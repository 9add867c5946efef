"""Metrics as mergeable statistics, and the vector edits of the perturbation and editing sweeps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.operators import tokens
from quillspark.operators.indexing import dense_index
from quillspark.operators.neighbours import squares
from quillspark.operators.quantiles import order_statistics
from quillspark.operators.records import small
from quillspark.session import stage

PAIR_BLOCK, PAIR_BYTES = 16384, 8 << 20  # rows and bytes a side of one pairwise block
TILE, NEAR = (256, 1024), 1e-3  # tiles stay in the processor's cache; nearer pairs are taken by plain differences
FEW = 20_000  # values that a quantile's last cell may hold
SHARE = 200  # an n-gram of one reference in so many is common
FIRST, STEP = 24, 14  # leading bits of a cell of doubles, and by how many it is cut further


# ---------------------------------------------------------------- edits


def faded(a: Column, b: Column, has_a: Column, has_b: Column, s: float) -> Column:
    """Token interpolation: slerp where both are real, else the real one faded out or in, else zeros."""
    return F.when(has_a & has_b, vec.slerp(a, b, s)).when(has_a, vec.scale(a, F.lit(1.0 - s))).when(has_b, vec.scale(b, F.lit(s))).otherwise(vec.scale(a, F.lit(0.0)))


def turned(df: DataFrame, u: str, g: str, angle: float) -> DataFrame:
    """Adds z: unit vector u turned by the angle towards the part of g that is tangent to it."""
    df = df.withColumn("_d", vec.dot(F.col(g), F.col(u)))
    df = df.withColumn("_v", F.zip_with(g, u, lambda x, y: x - F.col("_d") * y)).withColumn("_n", vec.norm(F.col("_v")))
    z = F.zip_with(u, "_v", lambda x, y: F.when(F.col("_n") < F.lit(1e-8), x).otherwise(F.lit(math.cos(angle)) * x + F.lit(math.sin(angle)) * y / F.col("_n")))
    return df.withColumn("z", z).drop("_d", "_v", "_n")


def time_embedding(t: Column, dim: int, time_scale: float = 1000.0) -> Column:
    """[sin, cos] of the scaled time at geometric frequencies."""
    half = dim // 2
    waves = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.lit(time_scale) * F.exp(F.lit(-math.log(10000.0)) * i.cast("double") / F.lit(float(half))))
    return F.concat(F.transform(waves, F.sin), F.transform(waves, F.cos))


# ---------------------------------------------------------------- one-pass statistics


def robust_limits(df: DataFrame, column: str, pad: float, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(pos, low, high): padded interpolated quantiles by component, from exact order statistics; of fewer than 20 values the least and greatest."""
    first = df.select(F.size(column).alias("n")).filter("n > 0").first()  # vectors are of one length
    dim = first["n"] if first else 0

    def ranks(n: int) -> list[int]:
        wanted = [p * (n - 1) for p in (low, high)] if n >= 20 else [0, max(0, n - 1)]
        return [k for r in wanted for k in (math.floor(r), math.ceil(r))]

    counts, q = order_statistics(df, column, dim, ranks) if dim else ([], [])
    rows = []
    for pos, (n, v) in enumerate(zip(counts, q)):
        if n:
            share = [p * (n - 1) - math.floor(p * (n - 1)) if n >= 20 else 0.0 for p in (low, high)]
            a, b = v[0] + (v[1] - v[0]) * share[0], v[2] + (v[3] - v[2]) * share[1]
            width = max(b - a, 1e-6)
            rows.append((pos, float(a - pad * width), float(b + pad * width)))
    return df.sparkSession.createDataFrame(rows, "pos int, low double, high double")  # a row a component


def mean_std(value: Column) -> tuple[Column, Column]:
    """Mean and population deviation from sums, never below zero under the root."""
    return F.avg(value), F.sqrt(F.greatest(F.avg(value * value) - F.avg(value) * F.avg(value), F.lit(0.0)))


def diversity(df: DataFrame, by: list[str], column: str, dim: int) -> DataFrame:
    """Mean cosine of all pairs of unit vectors of a group, from the sum of its vectors: no self join."""
    unit = df.withColumn("_u", vec.normalise_clamped(F.col(column)))
    sums = unit.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.get("_u", F.lit(i))).alias(f"_s{i}") for i in range(dim)])
    square = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(dim)), F.lit(0.0))
    return sums.select(*by, "n", F.when(F.col("n") >= 2, (square - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def _moments(dim: int, column: str):
    schema = pa.schema([("side", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            side = batch.column("side").to_numpy()
            x = np.asarray(batch.column(column).flatten()).reshape(-1, dim)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for s in np.unique(side).tolist():
                mine = x[side == s]
                held[s] = held.get(s, 0) + mine.T @ mine
        for s, m in held.items():
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], schema=schema)

    return run


def second_moments(df: DataFrame, column: str, dim: int) -> DataFrame:
    """(side, i, j, v), i <= j: sums of products of components; component dim is the constant 1. Summed a task at a time."""
    return df.select("side", column).mapInArrow(_moments(dim, column), "side bigint, i int, j int, v double").groupBy("side", "i", "j").agg(F.sum("v").alias("v"))


def frechet(df: DataFrame, column: str, dim: int) -> float:
    """Distance of the two sides' Gaussians (sample covariance); only moments reach the driver."""
    stats = {}
    for r in second_moments(df, column, dim).collect():
        m = stats.setdefault(r["side"], np.zeros((dim + 1, dim + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    (mu1, c1), (mu2, c2) = ((m[:-1, -1] / m[-1, -1], (m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) / m[-1, -1]) / (m[-1, -1] - 1)) for _, m in sorted(stats.items()))
    roots = np.sqrt(np.clip(np.linalg.eigvals(c1 @ c2).real, 0, None)).sum()
    return float(((mu1 - mu2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * roots)


# ---------------------------------------------------------------- pairwise, in blocks


def _met_blocks(df: DataFrame, n: int) -> DataFrame:
    """Every unordered pair of blocks of rows (side, id, e) as one staged row: (same, u, us, v, vs), vectors and sides packed.

    Rows are packed by block once; the pairs are dealt by one shuffle, and all passes read what it wrote.
    """
    one = df.select(F.size("e").alias("dim")).first()
    rows = max(1, min(PAIR_BLOCK, PAIR_BYTES // (8 * max(1, one["dim"] if one else 1))))
    blocks = max(1, -(-n // rows), min(16, -(-n // 256)))

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        x = np.asarray(table.column("e").combine_chunks().flatten(), float).reshape(table.num_rows, -1)[order]
        return pa.table({"b": table.column("b")[:1], "x": [x.tobytes()], "s": [table.column("side").to_numpy()[order].astype(np.int64).tobytes()]})

    held = df.select("side", "id", "e", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).groupBy("b").applyInArrow(pack, "b bigint, x binary, s binary")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    met = held.withColumn("o", every).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), F.struct("b", "x", "s").alias("one"))
    pair = met.groupBy("p", "q").agg(F.min("one").alias("u"), F.max("one").alias("v"))  # a row or two a pair
    return stage(pair.select((F.col("p") == F.col("q")).alias("same"), F.col("u.x").alias("u"), F.col("u.s").alias("us"), F.col("v.x").alias("v"), F.col("v.s").alias("vs")).filter("same or u <> v").repartition(min(blocks * (blocks + 1) // 2, 4096)))


def _distances(batches):
    """(squared distances, whether each pair counts or None for all, sides) of tiles of pairs of blocks, each unordered pair of rows once."""
    for b in batches:
        for r in b.to_pylist():
            s1, s2 = np.frombuffer(r["us"], np.int64), np.frombuffer(r["vs"], np.int64)
            u, v = np.frombuffer(r["u"]).reshape(len(s1), -1), np.frombuffer(r["v"]).reshape(len(s2), -1)
            for i in range(0, len(u), TILE[0]):
                for j in range(i if r["same"] else 0, len(v), TILE[1]):
                    d2 = squares(u[i : i + TILE[0]], v[j : j + TILE[1]], NEAR)
                    mask = np.triu(np.ones(d2.shape, bool), 1 + i - j) if r["same"] and j <= i + TILE[0] else None
                    yield d2, mask, s1[i : i + TILE[0]], s2[j : j + TILE[1]]


def _lengths(batches):
    """Non-zero distances, a tile at a time."""
    for d2, mask, *_ in _distances(batches):
        yield np.sqrt(d2[d2 > 0] if mask is None else d2[mask & (d2 > 0)])


def _tally(parts):
    """(cells, counts) of pairs of such arrays."""
    at, where = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
    return at, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(at)).astype(np.int64)


def _counted(cells: np.ndarray):
    """(cells, counts); cells close to each other are counted without a sort."""
    low = int(cells.min())
    if int(cells.max()) - low > 4 * len(cells) + 1024:
        return np.unique(cells, return_counts=True)
    n = np.bincount(cells - low)
    at = np.flatnonzero(n)
    return at + low, n[at]


def _median_distance(met: DataFrame) -> float | None:
    """Lower median of the non-zero distances: counts by leading bits of the doubles, which order as the numbers do, then the values of one cell."""

    def cells(bits: int, before: int, above: int | None):
        def run(batches):
            parts = []
            for d in _lengths(batches):
                whole = d.view(np.int64)
                if above is not None:
                    whole = whole[whole >> (64 - before) == above]
                if len(whole):
                    parts.append(_counted(whole >> (64 - bits)))
                if len(parts) == 64:
                    parts = [_tally(parts)]
            if parts:
                at, n = _tally(parts)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["cell", "n"])

        return run

    def inside(bits: int, cell: int):
        def run(batches):
            for d in _lengths(batches):
                d = d[d.view(np.int64) >> (64 - bits) == cell]
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(d)], names=["d"])

        return run

    rank, above, before, bits = None, None, 0, FIRST
    while True:
        got = sorted((r["cell"], r["n"]) for r in met.mapInArrow(cells(bits, before, above), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect())
        if not got:
            return None
        rank = (sum(n for _, n in got) - 1) // 2 if rank is None else rank
        for cell, n in got:
            if rank < n:
                break
            rank -= n
        if n <= FEW:
            return sorted(r["d"] for r in met.mapInArrow(inside(bits, cell), "d double").collect())[rank]
        if bits == 64:
            return float(np.array([cell], np.int64).view(np.float64)[0])
        above, before, bits = cell, bits, min(64, bits + STEP)


def rbf_mmd(df: DataFrame) -> float:
    """Squared discrepancy (V-statistic) of sides 0 and 1 of (side, id, e); bandwidth: lower median of non-zero distances."""
    counts = {r["side"]: r["n"] for r in df.groupBy("side").agg(F.count("*").alias("n")).collect()}
    met = _met_blocks(df, sum(counts.values()))
    median = _median_distance(met)
    sigma = 1.0 if median is None else max(median, 1e-6)
    gamma = 1.0 / (2 * sigma * sigma)

    def sums(batches):
        total = np.zeros((2, 2))
        for d2, mask, s1, s2 in _distances(batches):
            d2 *= -gamma
            k = np.exp(d2, out=d2)
            if mask is not None:
                k *= mask
            total += np.stack([s1 == 0, s1 == 1]).astype(float) @ k @ np.stack([s2 == 0, s2 == 1], axis=1).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (total[0, 0], total[1, 1], total[0, 1] + total[1, 0])], names=["xx", "yy", "xy"])

    s = met.mapInArrow(sums, "xx double, yy double, xy double").agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy")).first()
    nx, ny = counts.get(0, 0), counts.get(1, 0)
    return (2 * s["xx"] + nx) / nx**2 + (2 * s["yy"] + ny) / ny**2 - 2 * s["xy"] / (nx * ny)


# ---------------------------------------------------------------- text


def bigram_perplexity(docs: DataFrame) -> DataFrame:
    """(n_tokens, perplexity) of next-word targets under an add-one bigram model of the same documents."""
    w = docs.select(tokens.words(F.col("text")).alias("w")).filter(F.size("w") >= 2)
    # the last word of a text stands without a next one, so the pairs hold every word as their first
    grams = w.select(F.explode(F.expr("transform(sequence(0, size(w) - 1), i -> struct(w[i] as a, get(w, i + 1) as b))")).alias("g"))
    pair = grams.groupBy("g.a", "g.b").agg(F.count("*").alias("n"))
    # the sum of n log((n + 1) / (c + size)) splits into one over pairs and one over contexts: no join
    real = F.when(F.col("b").isNotNull(), F.col("n"))
    context = stage(pair.groupBy("a").agg(F.coalesce(F.sum(real), F.lit(0)).alias("c"), F.coalesce(F.sum(real * F.log(real + 1.0)), F.lit(0.0)).alias("s")))
    size = context.count()
    nll = F.sum(F.col("c") * F.log(F.col("c") + F.lit(float(size)))) - F.sum("s")
    return context.agg(F.sum("c").alias("n_tokens"), F.exp(nll / F.sum("c")).alias("perplexity"))


def cider(pairs: DataFrame, top: int = 4) -> DataFrame:
    """(pair_id, score): TF-IDF cosine of n-grams, averaged over n, times 10. pairs: pair_id, ref, hyp; idf over all refs.

    n-grams travel as a 64-bit and a 32-bit hash. Texts are dealt by pair once, so n-grams are counted where they are made. An n-gram of
    one reference or none weighs the same, so only frequencies of two and more are kept. Common n-grams (a reference in SHARE has
    them) meet theirs by broadcast if counting finds few of them; of the others, which meet them by shuffle, no key is in more
    references. Counts need no division by their number: it is one factor of all n-grams of a side, and the cosine drops it.
    """
    total = pairs.count()
    w = pairs.select("pair_id", "ref", "hyp").repartition("pair_id").select("pair_id", tokens.words(F.col("ref")).alias("ref"), tokens.words(F.col("hyp")).alias("hyp"))
    spans = lambda side: F.flatten(F.array(*[F.expr(f"case when size({side}) >= {n} then transform(sequence(1, size({side}) - {n - 1}), i -> named_struct('n', {n}, 'g', array_join(slice({side}, i, {n}), ' '), 'side', '{side}')) else array() end") for n in range(1, top + 1)]))
    grams = w.select("pair_id", F.explode(F.concat(spans("ref"), spans("hyp"))).alias("x")).select("pair_id", "x.n", "x.side", F.xxhash64("x.g").alias("g"), F.hash("x.g").alias("g2"))
    tf = stage(grams.groupBy("pair_id", "n", "g", "g2").agg(F.sum((F.col("side") == "ref").cast("bigint")).cast("int").alias("r"), F.sum((F.col("side") == "hyp").cast("bigint")).cast("int").alias("h")))
    keys, common = ["n", "g", "g2"], F.col("df") * SHARE >= F.lit(total)
    df = stage(tf.filter("r > 0").groupBy(*keys).agg(F.count("*").alias("df")).filter("df > 1"))
    often, seldom = df.filter(common), df.filter(~common)
    near = tf.join(small(often), keys, "left")  # at most SHARE times the n-grams of a mean reference
    known, rest = near.filter("df is not null"), near.filter("df is null").drop("df").join(seldom, keys, "left")
    weight = F.log(F.lit(float(total)) / F.coalesce(F.col("df"), F.lit(1)).cast("double"))
    x = known.unionByName(rest).withColumn("gr", F.col("r") * weight).withColumn("gh", F.col("h") * weight)
    by = x.groupBy("pair_id", "n").agg(F.sum(F.col("gr") * F.col("gh")).alias("d"), F.sqrt(F.sum(F.col("gr") * F.col("gr"))).alias("a"), F.sqrt(F.sum(F.col("gh") * F.col("gh"))).alias("b"))
    score = F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d") / (F.col("a") * F.col("b"))).otherwise(F.lit(0.0))
    scored = by.groupBy("pair_id").agg((F.sum(score) / F.lit(float(top)) * 10).alias("score"))
    return pairs.select("pair_id").join(scored, "pair_id", "left").select("pair_id", F.coalesce("score", F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- series


def log_means(log: DataFrame, window: str, rank: str, key: str, value: str) -> DataFrame:
    """(window, key, mean, worst, straggler): mean over ranks of each rank's mean, the greatest, and the first rank that has it."""
    local = log.groupBy(window, key, rank).agg(F.avg(value).alias("_m"))
    best = F.max(F.struct("_m", (-F.col(rank)).alias("_r")))
    return local.groupBy(window, key).agg(F.avg("_m").alias("mean"), best.alias("_b")).select(window, key, "mean", F.col("_b._m").alias("worst"), (-F.col("_b._r")).alias("straggler"))


def metric_key(name: Column, guidance: Column, ode: Column) -> Column:
    """Name of an evaluation metric with the sampler it was taken with (fixed values: how the parts are joined)."""
    return F.concat(name, F.lit("_cfg_"), guidance.cast("string"), F.lit("_"), F.when(ode, "ode").otherwise("sde"))


def slow_runs(series: DataFrame, step: str, value: str, threshold: float, most: int) -> DataFrame:
    """Runs of consecutive values below the threshold that reach `most` windows: (first_step, last_step, length)."""
    order = Window.orderBy(step)  # one row a logging window
    marked = series.withColumn("_slow", F.col(value) < threshold).withColumn("_i", F.row_number().over(order))
    slow = marked.filter("_slow").withColumn("_g", F.col("_i") - F.row_number().over(order))
    runs = slow.groupBy("_g").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("length"))
    return runs.filter(F.col("length") >= most).select("first_step", "last_step", "length")


def ema(series: DataFrame, step: str, value: str, decay: float) -> DataFrame:
    """Final exponential average of an ordered series (one row a step), starting from its first value: a sum of weights."""
    n = series.count()
    age = F.lit(float(n - 1)) - F.col("_i")
    weight = F.pow(F.lit(decay), age) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(1 - decay))
    return dense_index(series, step, "_i").agg(F.sum(F.col(value) * weight).alias("ema"), F.count("*").alias("n"))
