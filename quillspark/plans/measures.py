"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import vec
from quillspark.operators import metrics, tokens
from quillspark.operators.linear import principal, singular_values, sparse_svd
from quillspark.operators.neighbours import nearest
from quillspark.plans.base import E, q6, query, r6, table, vectors
from quillspark.plans.vectors import NEXT, neighbours
from quillspark.session import scratch, stage
from quillspark.streaming import watchdog


@query(f"""with {E}, s as (select label % 2 as side, vec_id as id, e from e), d as (select a.side as s, b.side as r, a.id as i, b.id as j, list_distance(a.e, b.e) as d from s a, s b),
  m as (select greatest(quantile_disc(d, 0.5), 1e-6) as sigma from d where i < j and d > 0)
  select {q6("avg(exp(-d * d / (2 * sigma * sigma))) filter (s = 0 and r = 0) + avg(exp(-d * d / (2 * sigma * sigma))) filter (s = 1 and r = 1) - 2 * avg(exp(-d * d / (2 * sigma * sigma))) filter (s = 0 and r = 1)")} as mmd from d, m""")
def rbf_mmd(spark, sf_dir):
    value = metrics.rbf_mmd(vectors(spark, sf_dir).select((F.col("label") % 2).alias("side"), F.col("vec_id").alias("id"), "e"))
    return spark.createDataFrame([(float(value),)], "mmd double").select(r6(F.col("mmd")).alias("mmd"))


@query(f"""with {E}, n as (select q.vec_id, q.label = arg_min(r.label, (list_distance(q.e, r.e), r.vec_id)) as hit from e q, e r where q.vec_id % 2 = 0 and r.vec_id % 2 = 1 group by q.vec_id, q.label)
  select {q6('avg(hit::int::double)')} as accuracy, count(*) as n from n""")
def knn_label_acc(spark, sf_dir):
    e = vectors(spark, sf_dir)
    q, r = e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1")
    near = nearest(q.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), r.select(F.col("vec_id").alias("ref_id"), "e"))
    labels = near.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(r.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("b")), "ref_id")
    return labels.agg(r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


@query(f"""with {E}, x as (select vec_id % 2 as side, vec_id, unnest(e) as v, (generate_subscripts(e, 1) - 1)::int as i from e), m as (select side, i, avg(v) as mu, count(*) as n from x group by side, i)
  select a.side, a.i, b.i as j, {q6('sum((a.v - p.mu) * (b.v - q.mu)) / (any_value(p.n) - 1)')} as cov from x a join x b on a.side = b.side and a.vec_id = b.vec_id and a.i <= b.i join m p on p.side = a.side and p.i = a.i join m q on q.side = b.side and q.i = b.i group by a.side, a.i, b.i""")
def frechet_stats(spark, sf_dir):
    m = metrics.second_moments(vectors(spark, sf_dir).select((F.col("vec_id") % 2).alias("side"), "e"), "e", 64)
    sums = m.filter("j = 64").select("side", "i", F.col("v").alias("s"))
    n = sums.filter("i = 64").select("side", F.col("s").alias("n"))
    c = m.filter("j < 64").join(F.broadcast(n), "side").join(F.broadcast(sums), ["side", "i"]).join(F.broadcast(sums.select("side", F.col("i").alias("j"), F.col("s").alias("t"))), ["side", "j"])
    return c.select("side", "i", "j", r6((F.col("v") - F.col("s") * F.col("t") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


@query()
def frechet_distance(spark, sf_dir):
    value = metrics.frechet(vectors(spark, sf_dir).select((F.col("vec_id") % 2).alias("side"), "e"), "e", 64)
    return spark.createDataFrame([(float(value),)], "distance double").select(r6(F.col("distance")).alias("distance"))


@query(f"""with {E}, u as (select label, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e)), 1e-12)) as u from e), x as (select label, unnest(u) as v, generate_subscripts(u, 1) as i from u), s as (select label, i, sum(v) as s, count(*) as n from x group by label, i)
  select label, any_value(n) as n, {q6('(sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1))')} as diversity from s group by label""")
def pairwise_diversity(spark, sf_dir):
    return metrics.diversity(vectors(spark, sf_dir), ["label"], "e", 64).select("label", "n", r6(F.col("diversity")).alias("diversity"))


FRACTION = "(vec_id % 5) / 4.0::double"


@query(f"with {E}, {NEXT}, c as (select {FRACTION} as fraction, list_cosine_similarity(a, b) as c from p) select fraction, {q6('avg(c)')} as fidelity_mean, {q6('case when count(*) > 1 then stddev_pop(c) else 0 end')} as fidelity_std, count(*) as n from c group by fraction")
def fidelity_by_fraction(spark, sf_dir):
    c = neighbours(spark, sf_dir).select((F.col("vec_id") % 5 / F.lit(4.0)).alias("fraction"), vec.dot(vec.normalise_clamped(F.col("a")), vec.normalise_clamped(F.col("b"))).alias("c"))
    return c.groupBy("fraction").agg(r6(F.avg("c")).alias("fidelity_mean"), r6(F.when(F.count("*") > 1, F.stddev_pop("c")).otherwise(F.lit(0.0))).alias("fidelity_std"), F.count("*").alias("n"))


@query(f"with {E}, {NEXT}, c as (select 100 * list_cosine_similarity(a, b) as c from p) select {q6('avg(c)')} as mean, {q6('sqrt(greatest(avg(c * c) - avg(c) ** 2, 0))')} as std, count(*) as n from c")
def clip_mean_std(spark, sf_dir):
    c = neighbours(spark, sf_dir).select((vec.dot(vec.normalise_clamped(F.col("a")), vec.normalise_clamped(F.col("b"))) * 100.0).alias("c"))
    mean, std = metrics.mean_std(F.col("c"))
    return c.agg(r6(mean).alias("mean"), r6(std).alias("std"), F.count("*").alias("n"))


@query(f"with {E}, {NEXT} select {q6('avg(list_inner_product(a, a) / 64)')} as x0_sq, {q6('avg(list_inner_product(b, b) / 64)')} as x1_sq, {q6('avg(list_inner_product(a, b) / 64)')} as x01, {q6('avg(sqrt(list_inner_product(a, a)))')} as norm0 from p")
def second_moments(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf_dir).agg(r6(F.avg(vec.dot(a, a) / 64)).alias("x0_sq"), r6(F.avg(vec.dot(b, b) / 64)).alias("x1_sq"), r6(F.avg(vec.dot(a, b) / 64)).alias("x01"), r6(F.avg(vec.norm(a))).alias("norm0"))


TURNS = "t as (select a.conv_id, a.turn, a.text as ref, b.text as hyp from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    nxt = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return c.join(nxt, ["conv_id", "turn"])


@query(f"""with {TURNS}, w as (select string_split(ref, ' ') as a, string_split(hyp, ' ') as b from t)
  select {q6("sum(list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: (a[i] = b[i])::int)))::double / sum(least(len(a), len(b)))")} as accuracy, sum(least(len(a), len(b)))::bigint as n_tokens from w""")
def token_accuracy(spark, sf_dir):
    w = turns(spark, sf_dir).select(F.split("ref", " ", -1).alias("a"), F.split("hyp", " ", -1).alias("b")).withColumn("n", F.least(F.size("a"), F.size("b")))
    hits = F.size(F.filter(F.zip_with(F.slice("a", 1, F.col("n")), F.slice("b", 1, F.col("n")), lambda x, y: x == y), lambda h: h))
    return w.agg(r6(F.sum(hits).cast("double") / F.sum("n")).alias("accuracy"), F.sum("n").cast("bigint").alias("n_tokens"))


STOP = "coalesce(nullif(list_position(list_transform(range(8), lambda i: sqrt(list_inner_product({v}[i * 8 + 1 : i * 8 + 8], {v}[i * 8 + 1 : i * 8 + 8])) < 0.25), true), 0) - 1, 8)"


@query(f"with {E}, {NEXT}, s as (select {STOP.format(v='a')} as s, {STOP.format(v='b')} as r, sqrt(list_inner_product(a[1:8], a[1:8])) as f from p) select {q6('avg((s = r)::int::double)')} as exact_rate, {q6('avg(abs(s - r))')} as mae, {q6('avg(f)')} as first_norm from s")
def stop_consistency(spark, sf_dir):
    stop = lambda c: vec.first_true(F.transform(vec.token_norms(F.col(c), 8), lambda x: x < F.lit(0.25)))
    s = neighbours(spark, sf_dir).select(stop("a").alias("s"), stop("b").alias("r"), F.get(vec.token_norms(F.col("a"), 8), F.lit(0)).alias("f"))
    return s.agg(r6(F.avg((F.col("s") == F.col("r")).cast("double"))).alias("exact_rate"), r6(F.avg(F.abs(F.col("s") - F.col("r")).cast("double"))).alias("mae"), r6(F.avg("f")).alias("first_norm"))


WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(f"""with w as (select {WORDS.format(t='text')} as w from documents), v as (select w from w where len(w) >= 2), g as (select unnest(w[1 : len(w) - 1]) as a, unnest(w[2:]) as b from v),
  p as (select a, b, count(*) as n from g group by a, b), c as (select a, sum(n) as c from p group by a), z as (select count(distinct x) as v from (select unnest(w) as x from v))
  select sum(n)::bigint as n_tokens, round(exp(sum(n * -ln((n + 1.0::double) / (c + v))) / sum(n)), 3) as perplexity from p join c using (a), z""")
def ngram_perplexity(spark, sf_dir):
    """Three decimals: of a value of five digits the order of summation leaves no more."""
    return metrics.bigram_perplexity(table(spark, sf_dir, "documents")).select("n_tokens", F.round("perplexity", 3).alias("perplexity"))


@query(f"""with {TURNS}, w as (select conv_id * 1000 + turn as pair_id, {WORDS.format(t='ref')} as r, {WORDS.format(t='hyp')} as h from t), k as (select unnest(range(1, 5)) as n),
  g as (select pair_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], ' '))) as g, 1 as isr from w, k union all select pair_id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i : i + n - 1], ' '))), 0 from w, k),
  tf as (select pair_id, n, g, sum(isr) as r, sum(1 - isr) as h from g group by all), df as (select n, g, count(*) as df from tf where r > 0 group by all), tot as (select count(*)::double as t from w),
  x as (select pair_id, n, r / greatest(1, sum(r) over (partition by pair_id, n))::double * ln(t / greatest(1, coalesce(df, 0))) as gr, h / greatest(1, sum(h) over (partition by pair_id, n))::double * ln(t / greatest(1, coalesce(df, 0))) as gh from tf left join df using (n, g), tot),
  y as (select pair_id, n, sum(gr * gh) as d, sqrt(sum(gr * gr)) as a, sqrt(sum(gh * gh)) as b from x group by all), s as (select pair_id, sum(case when a > 0 and b > 0 then d / (a * b) else 0 end) / 4.0::double * 10 as score from y group by pair_id)
  select pair_id, {q6('coalesce(score, 0)')} as score from w left join s using (pair_id)""")
def cider(spark, sf_dir):
    p = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "ref", "hyp")
    return metrics.cider(p).select("pair_id", r6(F.col("score")).alias("score"))


DAILY = "d as (select day(ts)::int as step, count(*)::double as v from events group by 1)"


def daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("step")).agg(F.count("*").cast("double").alias("v"))


@query(f"""with {DAILY}, m as (select avg(v) as m from d), o as (select step, v < m as slow, row_number() over (order by step) as i from d, m), s as (select step, i - row_number() over (order by step) as g from o where slow)
  select min(step)::int as first_step, max(step)::int as last_step, count(*) as length from s group by g having count(*) >= 2""")
def watchdog_runs(spark, sf_dir):
    d = daily(spark, sf_dir)
    return metrics.slow_runs(d, "step", "v", d.agg(F.avg("v")).first()[0], 2)


@query("""with d as (select event_type as series, dayofyear(ts)::bigint as step, count(*)::double as v from events where event_type is not null and ts is not null group by 1, 2),
  m as (select *, v < (select avg(v) from d) as slow from d), g as (select *, sum((not slow)::int) over (partition by series order by step) as g from m), r as (select series, step, min(step) over (partition by series, g) as first_step, row_number() over (partition by series, g order by step) as length from g where slow)
  select series, step, first_step, length from r where length >= 2""")
def watchdog_stream(spark, sf_dir):
    """Daily counts by type as a stream in three parts, a run of the watchdog after each."""
    base = scratch(spark)
    e = table(spark, sf_dir, "events").filter("event_type is not null and ts is not null")
    d = stage(e.groupBy(F.col("event_type").alias("series"), F.dayofyear("ts").cast("bigint").alias("step")).agg(F.count("*").cast("double").alias("value")))
    mean, low, high = d.agg(F.avg("value"), F.min("step"), F.max("step")).first()
    for k in range(3):
        d.filter(F.floor((F.col("step") - low) * 3 / (high - low + 1)) == k).write.mode("append").parquet(f"{base}/in")
        watchdog.watch(spark, f"{base}/in", f"{base}/out", f"{base}/progress", mean, 2)
    return spark.read.parquet(f"{base}/out").select("series", "step", "first_step", "length")


@query(f"with recursive {DAILY}, o as (select v, row_number() over (order by step) as i from d), s as (select i, v as ema from o where i = 1 union all select o.i, 0.9::double * s.ema + 0.1::double * o.v from s join o on o.i = s.i + 1) select {q6('ema')} as ema, i as n from s order by i desc limit 1")
def ema_series(spark, sf_dir):
    return metrics.ema(daily(spark, sf_dir), "step", "v", 0.9).select(r6(F.col("ema")).alias("ema"), "n")


@query(f"""with {E}, v as (select vec_id as token_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) as u from e where vec_id < 100), q as (select vec_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) as u from e where vec_id >= 100),
  s as (select q.vec_id, arg_min(token_id, (round(list_distance(q.u, v.u) ** 2, 9), token_id)) as token_id from q, v group by q.vec_id) select vec_id, token_id from s""")
def snap_nearest(spark, sf_dir):
    u = vectors(spark, sf_dir).select("vec_id", vec.normalise(F.col("e")).alias("e"))
    near = nearest(u.filter("vec_id >= 100").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), u.filter("vec_id < 100").select(F.col("vec_id").alias("ref_id"), "e"))
    return near.select(F.col("query_id").alias("vec_id"), F.col("ref_id").alias("token_id"))


@query()
def svd_latents(spark, sf_dir):
    values = singular_values(vectors(spark, sf_dir), "e", 64, 8)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "component int, value double")


def shipped(spark, sf_dir):
    """Orders by months of shipping, a sparse matrix of log1p of the quantities shipped."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("col"), F.col("l_quantity").cast("double").alias("q"))
    return li.groupBy("row", "col").agg(F.log1p(F.sum("q")).alias("value"))


@query()
def sparse_svd_values(spark, sf_dir):
    found = sparse_svd(shipped(spark, sf_dir), 4)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(found.values)], "component int, value double")


@query()
def sparse_svd_latents(spark, sf_dir):
    z = sparse_svd(shipped(spark, sf_dir), 4).left
    return z.select(F.col("row").alias("l_orderkey"), F.posexplode("z").alias("component", "value")).select("l_orderkey", "component", r6(F.col("value")).alias("value"))


@query()
def pca_projection(spark, sf_dir):
    return principal(vectors(spark, sf_dir), "vec_id", "e", 64, 2).select("vec_id", r6(F.get("z", F.lit(0))).alias("pc1"), r6(F.get("z", F.lit(1))).alias("pc2"))


@query("select conv_id, arg_min(turn, (length(text), -turn)) as turn from conversations group by conv_id")
def best_attempt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("score"))
    return tokens.best_attempt(c, "conv_id", "turn", "score").select("conv_id", "turn")
