"""Queries of samplers, token layouts, run logs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import bridge, det, vec
from quillspark.operators import editing, indexing, metrics, simulate, tokens
from quillspark.plans.base import E, q6, query, r6, table, vectors
from quillspark.plans.etl import TOKENS
from quillspark.plans.process import T, timed
from quillspark.plans.vectors import NEXT, gauss_sql, neighbours
from quillspark.sources import readers, writers


def summary(df, column):
    return df.select("vec_id", r6(F.get(column, F.lit(0))).alias("x0"), r6(vec.total(F.col(column))).alias("total"))


def normal(seed: int, stream: str):
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: det.gauss(det.digest(seed, stream, F.col("vec_id"), i)))


def _ode_sql(begin: str, score: str, base: str, stream: str) -> str:
    first = f"0.25 * ({score}) / 20 + 0.5::double * sqrt(0.05::double) * g[i]"
    return f"""with recursive {E}, {NEXT}, n as (select vec_id, a, b, list_transform(range(64), lambda i: {gauss_sql(13, stream, 'vec_id', 'i')}) as g from p),
      s as (select vec_id, 0 as k, {begin} as x, a, b, g from n union all
      select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] + case when k = 0 then {first} else 0.125::double * (({score}) - ({base})) / 20 end), a, b, g from s where k < 20)
      select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 20"""


@query(_ode_sql("a", "0.8::double * b[i] - x[i]", "-(x[i] - a[i]) / (0.25 * greatest(k, 1) / 20.0::double)", "ode"))
def euler_ode(spark, sf_dir):
    """The probability flow towards the late end; its first step is stochastic."""
    score = lambda v, t, i: F.lit(0.8) * F.get("b", i) - v
    x = neighbours(spark, sf_dir).withColumn("g", normal(13, "ode"))
    return summary(x.withColumn("x", simulate.probability_flow(F.col("a"), bridge.Uniform(0.5), score, 20, F.col("a"), lambda k, i: F.get("g", i))), "x")


@query(_ode_sql("b", "0.8::double * a[i] - x[i]", "(b[i] - x[i]) / (0.25 * greatest(k, 1) / 20.0::double)", "back"))
def euler_ode_reverse(spark, sf_dir):
    score = lambda v, t, i: F.lit(0.8) * F.get("a", i) - v
    x = neighbours(spark, sf_dir).withColumn("g", normal(13, "back"))
    return summary(x.withColumn("x", simulate.probability_flow(F.col("b"), bridge.Uniform(0.5), score, 20, F.col("b"), lambda k, i: F.get("g", i), reverse=True)), "x")


def _flow_sql(field: str, sign: str = "+", t: str = "(k / 20.0::double)") -> str:
    return f"""with recursive {E}, {NEXT}, s as (select vec_id, 0 as k, b as x, a, b from p union all select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] {sign} ({field.format(t=t)}) / 20), a, b from s where k < 20)
      select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 20"""


FIELD = "0.5::double * a[i] - 0.2::double * x[i] * {t}"


def velocity(v, t, i):
    return F.lit(0.5) * F.get("a", i) - F.lit(0.2) * v * t


@query(_flow_sql(FIELD))
def flow_ascending(spark, sf_dir):
    """The single-cell convention: from the late end, time rising."""
    return summary(neighbours(spark, sf_dir).withColumn("x", simulate.flow(F.col("b"), velocity, 20, reverse=True, ascending=True)), "x")


@query(_flow_sql(FIELD, "-", "(1 - k / 20.0::double)"))
def flow_reverse(spark, sf_dir):
    return summary(neighbours(spark, sf_dir).withColumn("x", simulate.flow(F.col("b"), velocity, 20, reverse=True)), "x")


@query(_flow_sql(f"{FIELD} + 0.75::double * 0.5::double * a[i]"))
def flow_guided(spark, sf_dir):
    """Guidance by a field that doesn't see the condition."""
    both = lambda v, t, i: bridge.guided(velocity(v, t, i), F.lit(-0.2) * v * t, 0.75)
    return summary(neighbours(spark, sf_dir).withColumn("x", simulate.flow(F.col("b"), both, 20)), "x")


@query(f"with {E}, {NEXT}, x as (select vec_id, list_transform(range(1, 65), lambda i: (1 - {T}) * a[i] + {T} * b[i]) as x from p) select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from x")
def flow_interpolant(spark, sf_dir):
    return summary(timed(spark, sf_dir).withColumn("x", bridge.interpolant(F.col("a"), F.col("b"), F.col("t"))), "x")


@query(f"with {E}, {NEXT}, x as (select vec_id, list_transform(range(1, 65), lambda i: a[i] + exp(0.5::double * b[i]) * {gauss_sql(14, 'post', 'vec_id', 'i - 1')}) as x from p) select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from x")
def posterior_sample(spark, sf_dir):
    """The latent with a second vector as its log-variance."""
    return summary(neighbours(spark, sf_dir).withColumn("g", normal(14, "post")).withColumn("x", vec.posterior(F.col("a"), F.col("b"), F.col("g"))), "x")


@query(f"with {E}, t as (select vec_id, e, unnest(range(16)) as token from e) select vec_id, token::int as token, token * 4 as first, {q6('e[token * 4 + 1] + e[token * 4 + 2] + e[token * 4 + 3] + e[token * 4 + 4]')} as total from t")
def patch_positions(spark, sf_dir):
    """What each of a vector's 16 tokens owns, and the sum of it."""
    rows = vectors(spark, sf_dir).select("vec_id", "e", F.posexplode(vec.patch_positions(16, 4)).alias("token", "own"))
    return rows.select("vec_id", "token", F.get("own", F.lit(0)).cast("bigint").alias("first"), r6(vec.total(F.transform("own", lambda i: F.get("e", i)))).alias("total"))


@query(f"""with {E}, {NEXT}, x as (select vec_id, list_sum(list_transform(range(64), lambda i: {gauss_sql(15, 'start', 'vec_id', 'i')})) as n, a, b from p)
  select vec_id, {q6('n')} as x0, {q6('list_sum(b)')} as x1, {q6('list_sum(a)')} as cond0, {q6('list_sum(b)')} as cond1 from x""")
def noise_start(spark, sf_dir):
    """Noise as the process's start; the condition stays the data."""
    ends = editing.process_ends(F.col("a"), F.col("b"), F.col("g"), F.col("g"), start_as_noise=True)
    return neighbours(spark, sf_dir).withColumn("g", normal(15, "start")).select("vec_id", *[r6(vec.total(c)).alias(k) for k, c in ends.items()])


@query(f"with {TOKENS} select doc_id, least(len(ids), 16)::bigint as stop from t")
def pad_id_stop(spark, sf_dir):
    t = tokens.padded(tokens.hashed_ids(table(spark, sf_dir, "documents"), 400, 16), 16)
    return t.select("doc_id", vec.pad_id_stop(F.col("token_ids"), 0).alias("stop"))


@query(f"""with l as (select day(ts)::int as day, event_type as key, user_id % 8 as rank, avg(ln(1 + abs(value))) as m from events where user_id is not null group by all),
  w as (select day, key, max(m) as worst from l group by day, key)
  select l.day, l.key, {q6('avg(m)')} as mean, {q6('any_value(worst)')} as worst, min(rank) filter (m = worst) as straggler from l join w on l.day = w.day and l.key = w.key group by l.day, l.key""")
def log_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id is not null").select(F.dayofmonth("ts").alias("day"), (F.col("user_id") % 8).alias("rank"), F.col("event_type").alias("key"), F.log(F.abs("value") + 1.0).alias("value"))
    return metrics.log_means(e, "day", "rank", "key", "value").select("day", "key", r6(F.col("mean")).alias("mean"), r6(F.col("worst")).alias("worst"), "straggler")


@query("select 'eval/' || event_type || '_cfg_' || (case event_id % 3 when 0 then '0.0' when 1 then '0.5' else '1.0' end) || '_' || (case when event_id % 2 = 0 then 'ode' else 'sde' end) as name, count(*) as n from events where event_type is not null group by name")
def metric_keys(spark, sf_dir):
    """Events counted under the name of a metric and the sampler that it would have been taken with."""
    rows = table(spark, sf_dir, "events").filter("event_type is not null")
    name = metrics.metric_key(F.concat(F.lit("eval/"), "event_type"), (F.col("event_id") % 3) / F.lit(2.0), F.col("event_id") % 2 == 0)
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query(f"with {TOKENS} select doc_id, len(ids)::bigint as length from t where len(ids) <= 120 order by doc_id limit 40")
def short_captions(spark, sf_dir):
    t = table(spark, sf_dir, "documents").withColumn("length", F.size(tokens.words(F.col("text"))).cast("bigint"))
    return indexing.first_short(t, "doc_id", F.col("length"), 120, 40).select("doc_id", "length")


@query("select vec_id, vec_id % 5 as kind from embeddings where vec_id % 5 not in (1, 2, 3)")
def finite_rows(spark, sf_dir):
    """Vectors spoiled by a null, a NaN or an infinity are dropped."""
    bad = F.array(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf")))
    v = vectors(spark, sf_dir).withColumn("kind", F.col("vec_id") % 5)
    spoiled = F.when(F.col("kind").isin(1, 2, 3), F.concat("e", F.array(F.get(bad, F.col("kind").cast("int") - 1)))).otherwise(F.col("e"))
    return v.filter(vec.finite(spoiled)).select("vec_id", "kind")


@query("select s_suppkey::int as shard_id, s_suppkey % 3 = 0 as has_text, s_suppkey % 6 = 0 as has_dino, s_suppkey % 4 <> 0 as has_tokens from supplier where s_suppkey % 5 <> 0")
def shard_discovery(spark, sf_dir):
    """A listing in which some files are missing."""
    i = F.col("s_suppkey")
    always = F.lit(True)
    rules = {
        "latents": always, "filled": i % 5 != 0, "text": i % 3 == 0, "dino": i % 2 == 0, "dino_filled": i % 3 == 0,
        "token_ids": always, "token_mask": always, "token_lengths": i % 4 != 0, "token_filled": always, "other": always,
    }
    number = F.lpad(i.cast("string"), 5, "0")
    names = F.array_compact(F.array(*[F.when(rule, F.concat(F.lit(f"/data/{kind}_"), number, F.lit(".bin"))) for kind, rule in rules.items()]))
    got = readers.discover_shards(table(spark, sf_dir, "supplier").select(F.explode(names).alias("path")))
    return got.select("shard_id", F.col("text").isNotNull().alias("has_text"), F.col("dino").isNotNull().alias("has_dino"), "has_tokens")


@query("select max(p_partkey) as step from part")
def cached_step(spark, sf_dir):
    number = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    names = F.array(F.concat(F.lit("eval_tensors_"), number, F.lit(".pt")), F.concat(F.lit("metrics_"), number, F.lit(".json")))
    listing = table(spark, sf_dir, "part").select(F.explode(names).alias("path"))
    return spark.createDataFrame([(readers.cached_result(listing),)], "step bigint")


@query("select max(p_partkey) as step, 'ck_' || max(p_partkey) || '.pt' as path from part")
def latest_checkpoint(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("ck_"), F.col("p_partkey").cast("string"), F.lit(".pt")).alias("path"))
    step = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    return spark.createDataFrame([(readers.latest(files, step, "path"),)], "path string").select(step.alias("step"), "path")


@query("select d.doc_id, coalesce('q' || l.quality, '') as caption from documents d left join labels l using (doc_id)")
def caption_attach(spark, sf_dir):
    meta = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("caption"))
    return readers.captions(table(spark, sf_dir, "documents").select("doc_id"), meta, "doc_id")


@query("select conv_id, turn, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') as text from conversations")
def think_stripped(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit('<think>one </think> two</think>\n "'), F.regexp_replace("text", "[^A-Za-z0-9]", ""), F.lit('" '))
    return c.select("conv_id", "turn", tokens.strip_thinking(said).alias("text"))


@query("""select event_id, sha256('{"preset": "' || event_type || '", "shard": ' || user_id || '}') as hash from events where event_type is not null and user_id is not null""")
def config_hashes(spark, sf_dir):
    """Hashes of settings, one an event; those that change speed alone don't change the hash."""
    rows = table(spark, sf_dir, "events").filter("event_type is not null and user_id is not null")
    return rows.select("event_id", writers.settings_hash({"shard": F.col("user_id"), "batch_size": F.col("event_id"), "preset": F.col("event_type")}, text=("preset",)).alias("hash"))
