"""Bridge-process queries: closed forms, losses and simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import bridge, det, vec
from quillspark.operators import metrics, simulate
from quillspark.plans.base import E, q6, query, r6, vectors
from quillspark.plans.vectors import NEXT, gauss_sql, neighbours

#: Every vector has a time of its own.
GRID = "g as (select vec_id, (1 + vec_id % 19) / 20.0::double as t from embeddings)"


def grid(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", ((F.lit(1) + F.col("vec_id") % 19) / F.lit(20.0)).alias("t"))


def coefficients(spark, sf_dir, p):
    return grid(spark, sf_dir).select("vec_id", "t", r6(p.sigma(F.col("t"))).alias("sigma"), r6(p.phi(F.col("t"), 1.0)).alias("phi"), r6(p.cov(0.0, F.col("t"), F.col("t"))).alias("c_t"), r6(p.cov(0.0, F.col("t"), 1.0)).alias("c_t1"), r6(p.cov(F.col("t"), 1.0, 1.0)).alias("c_rest"))


def energy_sql(f: str) -> str:
    """Coefficients of a driftless process from its energy f({u})."""
    at = lambda u: "(" + f.format(u=u) + ")"
    return f"{q6(at('t') + ' - ' + at('0.0::double'))} as c_t, {q6(at('t') + ' - ' + at('0.0::double'))} as c_t1, {q6(at('1.0::double') + ' - ' + at('t'))} as c_rest"


PERIODIC = "(3 * 0.9025::double / 8 + 0.95::double * 0.05 + 0.0025) * ({u}) - 0.95::double * 1.05 / (4 * pi()) * sin(2 * pi() * ({u})) + 0.9025::double / (32 * pi()) * sin(4 * pi() * ({u}))"
HALF = "(3 * 0.9025::double / 8 + 0.95::double * 0.05 + 0.0025) * (({u}) - 1) - 0.95::double * 1.05 / (2 * pi()) * sin(pi() * (({u}) - 1)) + 0.9025::double / (16 * pi()) * sin(2 * pi() * (({u}) - 1))"
FALL = "(0.265::double ** 2 + 0.5 * 0.235::double ** 2) * ({u}) + 2 * 0.265::double * 0.235 / pi() * sin(pi() * ({u})) + 0.235::double ** 2 / (4 * pi()) * sin(2 * pi() * ({u}))"


@query(f"with {GRID} select vec_id, t, 0.5::double as sigma, {q6('exp(-(1 - t))')} as phi, {q6('0.25 * exp(-2 * t) * (exp(2 * t) - 1) / 2')} as c_t, {q6('0.25 * exp(-(t + 1)) * (exp(2 * t) - 1) / 2')} as c_t1, {q6('0.25 * exp(-2::double) * (exp(2::double) - exp(2 * t)) / 2')} as c_rest from g")
def sde_coeffs_uniform(spark, sf_dir):
    return coefficients(spark, sf_dir, bridge.Uniform(0.5, 1.0))


@query(f"with {GRID} select vec_id, t, {q6('0.475::double * (1 - cos(2 * pi() * t)) + 0.05')} as sigma, 1.0::double as phi, {energy_sql(PERIODIC)} from g")
def sde_coeffs_periodic(spark, sf_dir):
    return coefficients(spark, sf_dir, bridge.Periodic())


@query(f"with {GRID} select vec_id, t, {q6('0.475::double * (1 + cos(pi() * t)) + 0.05')} as sigma, 1.0::double as phi, {energy_sql(HALF)} from g")
def sde_coeffs_cosine(spark, sf_dir):
    return coefficients(spark, sf_dir, bridge.cosine_decaying())


@query(f"with {GRID} select vec_id, t, {q6('0.03 + 0.235::double * (1 + cos(pi() * t))')} as sigma, 1.0::double as phi, {energy_sql(FALL)} from g")
def sde_coeffs_cosine_k(spark, sf_dir):
    return coefficients(spark, sf_dir, bridge.CosineDecay())


T = "(0.1::double + (vec_id % 9) * 0.1::double)"


def timed(spark, sf_dir):
    return neighbours(spark, sf_dir).withColumn("t", F.lit(0.1) + (F.col("vec_id") % 9) * F.lit(0.1))


@query(f"""with {E}, {NEXT}, m as (select vec_id, {T} as t, a, b, list_transform(range(64), lambda i: {gauss_sql(1, 'eps', 'vec_id', 'i')}) as g from p),
  x as (select vec_id, list_transform(range(1, 65), lambda i: (1 - t) * a[i] + t * b[i] + sqrt(0.25 * t * (1 - t)) * g[i]) as x from m) select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from x""")
def bridge_sample(spark, sf_dir):
    m = timed(spark, sf_dir)
    w0, w1, var = bridge.conditional(bridge.Uniform(0.5), 0.0, F.col("t"), 1.0)
    noise = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: det.gauss(det.digest(1, "eps", F.col("vec_id"), i)))
    m = m.withColumn("w0", w0).withColumn("w1", w1).withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0)))).withColumn("g", noise)
    m = m.withColumn("x", vec.add(vec.axpy(F.col("w0"), F.col("a"), F.col("w1"), F.col("b")), vec.scale(F.col("g"), F.col("sd"))))
    return m.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(vec.total(F.col("x"))).alias("total"))


@query(f"with {E}, {NEXT} select vec_id, {q6(f'(1 - {T}) * a[1] + {T} * b[1]')} as mean0, {q6(f'0.25 * {T} * (1 - {T})')} as variance from p")
def bridge_moments(spark, sf_dir):
    w0, w1, var = bridge.conditional(bridge.Uniform(0.5), 0.0, F.col("t"), 1.0)
    return timed(spark, sf_dir).select("vec_id", r6(w0 * F.get("a", F.lit(0)) + w1 * F.get("b", F.lit(0))).alias("mean0"), r6(var).alias("variance"))


@query(f"""with {E}, {NEXT}, x as (select vec_id, {T} as t, a[1] as a, b[1] as b, (1 - {T}) * a[1] + {T} * b[1] + 0.05::double as x from p)
  select vec_id, {q6('(b - x) / (0.25 * (1 - t))')} as forward, {q6('-(x - a) / (0.25 * t)')} as reverse from x""")
def score_targets(spark, sf_dir):
    p = bridge.Uniform(0.5)
    x = timed(spark, sf_dir).select("vec_id", "t", F.get("a", F.lit(0)).alias("a"), F.get("b", F.lit(0)).alias("b")).withColumn("x", (F.lit(1.0) - F.col("t")) * F.col("a") + F.col("t") * F.col("b") + F.lit(0.05))
    return x.select("vec_id", r6(bridge.forward_score(p, F.col("x"), F.col("b"), F.col("t"), 1.0)).alias("forward"), r6(bridge.reverse_score(p, F.col("x"), F.col("a"), F.col("t"))).alias("reverse"))


@query(f"""with {GRID}, v as (select vec_id, t, (1 - t) ** 2 * 1.5::double + t ** 2 * 2 + 2 * t * (1 - t) * 0.3::double + 0.25 * t * (1 - t) as var from g)
  select vec_id, t, {q6('1 / sqrt(var)')} as c_in, {q6('(t * 2 + (1 - t) * 0.3::double) / var')} as f_skip, {q6('sqrt(2 - (t * 2 + (1 - t) * 0.3::double) ** 2 / var)')} as f_out, {q6('0.25 * (1 - t)')} as f_denom,
   {q6('((1 - t) * 1.5::double + t * 0.3::double) / var')} as r_skip, {q6('sqrt(1.5::double - ((1 - t) * 1.5::double + t * 0.3::double) ** 2 / var)')} as r_out, {q6('0.25 * t')} as r_denom from v""")
def edm_coeffs(spark, sf_dir):
    f, r = (bridge.edm(bridge.Uniform(0.5), F.col("t"), 1.5, 2.0, 0.3, forward=x) for x in (True, False))
    return grid(spark, sf_dir).select("vec_id", "t", r6(f["c_in"]).alias("c_in"), *[r6(d[k]).alias(f"{n}_{s}") for n, d in (("f", f), ("r", r)) for k, s in (("c_skip", "skip"), ("c_out", "out"), ("denom", "denom"))])


@query(f"with {GRID} select vec_id, t, {q6('sqrt(greatest(1 - t * t, 1e-6))')} as alpha, {q6('least(0.999::double, t)')} as sigma from g")
def vp_coeffs(spark, sf_dir):
    a, s = bridge.vp(F.col("t"))
    return grid(spark, sf_dir).select("vec_id", "t", r6(a).alias("alpha"), r6(s).alias("sigma"))


@query(f"with {GRID} select vec_id, t, mode, {q6('w_text')} as w_text, {q6('w_image')} as w_image from (select vec_id, t, 'equal' as mode, 0.5::double as w_text, 0.5::double as w_image from g union all select vec_id, t, 'image_up', 1 - t, t from g union all select vec_id, t, 'text_up', t, 1 - t from g)")
def repa_weights(spark, sf_dir):
    out = None
    for mode in ("equal", "image_up", "text_up"):
        a, b = bridge.repa_weights(F.col("t"), mode)
        x = grid(spark, sf_dir).select("vec_id", "t", F.lit(mode).alias("mode"), r6(a).alias("w_text"), r6(b).alias("w_image"))
        out = x if out is None else out.union(x)
    return out


LOSS = f"x as (select vec_id, {T} as t, unnest(a) as a, unnest(b) as b, generate_subscripts(a, 1) - 1 as i from p)"


def components(spark, sf_dir):
    return timed(spark, sf_dir).select("vec_id", "t", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("vec_id", "t", "i", "z.a", "z.b")


@query(f"""with {E}, {NEXT}, {LOSS}, s as (select t, (b - ((1 - t) * a + t * b + 0.05::double)) / (0.25 * (1 - t)) as target, 0.25 * (1 - t) as w, 0.9::double * (b - a) / 0.25 as pred from x)
  select {q6('avg((pred - target) ** 2 * w)')} as loss, count(*) as n from s""")
def dsm_loss(spark, sf_dir):
    p = bridge.Uniform(0.5)
    x = components(spark, sf_dir).withColumn("x", (F.lit(1.0) - F.col("t")) * F.col("a") + F.col("t") * F.col("b") + F.lit(0.05))
    target = bridge.forward_score(p, F.col("x"), F.col("b"), F.col("t"), 1.0)
    pred = F.lit(0.9) * (F.col("b") - F.col("a")) / F.lit(0.25)
    return x.select(((pred - target) * (pred - target) * bridge.dsm_weight(p, F.col("t"), True)).alias("l")).agg(r6(F.avg("l")).alias("loss"), F.count("*").alias("n"))


@query(f"""with {E}, {NEXT}, {LOSS} select {q6('avg((0.9::double * (b - a) - (b - a)) ** 2)')} as shared, {q6('avg((0.9::double * (b - a) - (a - b)) ** 2)')} as directional_reverse from x""")
def flow_loss(spark, sf_dir):
    x = components(spark, sf_dir).withColumn("pred", F.lit(0.9) * (F.col("b") - F.col("a")))
    d, r = F.col("pred") - (F.col("b") - F.col("a")), F.col("pred") - (F.col("a") - F.col("b"))
    return x.agg(r6(F.avg(d * d)).alias("shared"), r6(F.avg(r * r)).alias("directional_reverse"))


@query(f"""with {E}, {NEXT}, {LOSS} select {q6('avg((0.8::double * a - b) ** 2)')} as forward, {q6('avg((0.8::double * b - a) ** 2)')} as reverse from x""")
def endpoint_loss(spark, sf_dir):
    d, r = F.lit(0.8) * F.col("a") - F.col("b"), F.lit(0.8) * F.col("b") - F.col("a")
    return components(spark, sf_dir).agg(r6(F.avg(d * d)).alias("forward"), r6(F.avg(r * r)).alias("reverse"))


@query(f"""with {E}, {NEXT}, {LOSS}, s as (select a, t, {gauss_sql(2, 'n2d', 'vec_id', 'i')} as e from x), v as (select a, e, sqrt(greatest(1 - t * t, 1e-6)) * a + least(0.999::double, t) * e as x from s) select {q6('avg((0.5::double * x - e) ** 2)')} as loss from v""")
def noise_loss(spark, sf_dir):
    alpha, sigma = bridge.vp(F.col("t"))
    x = components(spark, sf_dir).withColumn("e", det.gauss(det.digest(2, "n2d", F.col("vec_id"), F.col("i"))))
    d = F.lit(0.5) * (alpha * F.col("a") + sigma * F.col("e")) - F.col("e")
    return x.select((d * d).alias("l")).agg(r6(F.avg("l")).alias("loss"))


@query(f"""with {E}, {NEXT}, c as (select vec_id, {T} as t, list_inner_product(a, b) / (greatest(sqrt(list_inner_product(a, a)), 1e-12) * greatest(sqrt(list_inner_product(b, b)), 1e-12)) as c, (vec_id % 3 <> 0)::int::double as m from p)
  select {q6('sum((1 - t) * (1 - c)) / greatest(sum(1 - t), 1e-8)')} as text_loss, {q6('sum(t * m * (1 - c)) / greatest(sum(t * m), 1e-8)')} as image_loss from c""")
def repa_loss(spark, sf_dir):
    c = timed(spark, sf_dir).withColumn("c", F.lit(1.0) - vec.dot(vec.normalise_clamped(F.col("a")), vec.normalise_clamped(F.col("b")))).withColumn("m", (F.col("vec_id") % 3 != 0).cast("double"))
    text, image = bridge.repa_weights(F.col("t"), "image_up")
    return c.agg(r6(metrics.weighted_mean(F.col("c"), text)).alias("text_loss"), r6(metrics.weighted_mean(F.col("c"), image * F.col("m"))).alias("image_loss"))


def pinned(p):
    """Analytic forward score towards column b."""
    return lambda v, t, i: bridge.forward_score(p, v, F.get("b", i), t, 1.0)


@query(f"""with recursive {E}, {NEXT}, s as (select vec_id, 0 as k, a as x, b from p union all select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] + (b[i] - x[i]) / (1 - k / 20.0::double) * 0.05::double), b from s where k < 20)
  select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 20""")
def euler_bridge(spark, sf_dir):
    p = bridge.Uniform(0.5)
    x = neighbours(spark, sf_dir).withColumn("x", simulate.euler(F.col("a"), p, pinned(p), 20))
    return x.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(vec.total(F.col("x"))).alias("total"))


@query(f"""with recursive {E}, {NEXT}, s as (select vec_id, 0 as k, a as x, b from p union all select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] + (0.5::double * b[i] - 0.2::double * x[i] * (k / 20.0::double)) / 20), b from s where k < 20)
  select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 20""")
def euler_flow(spark, sf_dir):
    x = neighbours(spark, sf_dir).withColumn("x", simulate.flow(F.col("a"), lambda v, t, i: F.lit(0.5) * F.get("b", i) - F.lit(0.2) * v * t, 20))
    return x.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(vec.total(F.col("x"))).alias("total"))


@query(f"""with recursive {E}, {NEXT}, s as (select vec_id, 0 as k, a as x, b from p union all select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] + (b[i] - x[i]) / (1 - k / 5.0::double) * 0.2::double), b from s where k < 5)
  select vec_id, k::int as step, {q6('x[1]')} as x0 from s where k = 0 or k % 2 = 0 or k = 5""")
def snapshots(spark, sf_dir):
    p = bridge.Uniform(0.5)
    x = neighbours(spark, sf_dir).withColumn("path", simulate.euler_path(F.col("a"), p, pinned(p), 5)).select("vec_id", F.posexplode("path").alias("step", "x"))
    return x.filter((F.col("step") == 0) | simulate.snapshot(F.col("step") - 1, 5, 2)).select("vec_id", "step", r6(F.get("x", F.lit(0))).alias("x0"))


@query(f"""with recursive {E}, s as (select vec_id, 0 as k, e as x from e union all select vec_id, k + 1, (with c as (select 0.99::double * (1 - k / 10.0::double) as t, 0.99::double * (1 - (k + 1) / 10.0::double) as u) select list_transform(x, lambda v: sqrt(greatest(1 - u * u, 1e-6)) * (v - t * 0.3::double * v) / greatest(sqrt(greatest(1 - t * t, 1e-6)), 1e-3) + u * 0.3::double * v) from c) from s where k < 10)
  select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 10""")
def ddim_sampler(spark, sf_dir):
    x = vectors(spark, sf_dir).withColumn("x", simulate.denoise(F.col("e"), lambda v, t, i: F.lit(0.3) * v, 10))
    return x.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(vec.total(F.col("x"))).alias("total"))


@query(f"""with recursive {E}, {NEXT}, g as (select vec_id, a, b, list_transform(range(10), lambda k: list_transform(range(64), lambda i: sqrt(0.1::double) * {gauss_sql(9, 'crn', 'k', 'i')})) as g from p),
  s as (select vec_id, 0 as k, a as x, b, g from g union all select vec_id, k + 1, list_transform(range(1, 65), lambda i: x[i] + (b[i] - x[i]) / (1 - k / 10.0::double) * 0.1::double + 0.5 * g[k + 1][i]), b, g from s where k < 10)
  select vec_id, {q6('x[1]')} as x0, {q6('list_sum(x)')} as total from s where k = 10""")
def fixed_noise_replay(spark, sf_dir):
    p = bridge.Uniform(0.5)
    noise = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sqrt(F.lit(0.1)) * det.gauss(det.digest(9, "crn", k, i))))
    shared = spark.range(1).select(noise.alias("g"))  # common random numbers: one set for every start
    x = neighbours(spark, sf_dir).crossJoin(F.broadcast(shared)).withColumn("x", simulate.replay(F.col("a"), F.col("g"), p, pinned(p), 10))
    return x.select("vec_id", r6(F.get("x", F.lit(0))).alias("x0"), r6(vec.total(F.col("x"))).alias("total"))


@query(f"""with {E}, {NEXT}, c as (select list_transform(range(1, 65), lambda i: 0.8::double * a[i] + 0.1::double * b[i]) as f, list_transform(range(1, 65), lambda i: 0.8::double * b[i] + 0.1::double * a[i]) as r, a, b from p),
  d as (select *, list_transform(f, lambda v: 0.9::double * v) as rf, list_transform(r, lambda v: 0.9::double * v) as fr from c)
  select {q6('avg(list_distance(f, b) ** 2 / 64)')} as forward_mse, {q6('avg(list_distance(r, a) ** 2 / 64)')} as reverse_mse, {q6('avg(list_distance(rf, a) ** 2 / 64)')} as cycle_start_mse, {q6('avg(list_distance(fr, b) ** 2 / 64)')} as cycle_end_mse from d""")
def cycle_metrics(spark, sf_dir):
    x = neighbours(spark, sf_dir).withColumn("f", vec.axpy(F.lit(0.8), F.col("a"), F.lit(0.1), F.col("b"))).withColumn("r", vec.axpy(F.lit(0.8), F.col("b"), F.lit(0.1), F.col("a")))
    x = x.withColumn("rf", vec.scale(F.col("f"), F.lit(0.9))).withColumn("fr", vec.scale(F.col("r"), F.lit(0.9)))
    mse = lambda u, v: r6(F.avg(vec.total(F.zip_with(u, v, lambda p, q: (p - q) * (p - q))) / F.size(u)))
    return x.agg(mse("f", "b").alias("forward_mse"), mse("r", "a").alias("reverse_mse"), mse("rf", "a").alias("cycle_start_mse"), mse("fr", "b").alias("cycle_end_mse"))


@query("select vec_id, (vec_id % 11) / 10.0::double as fraction, greatest(1, round_even(25 * ((vec_id % 11) / 10.0::double), 0))::int as steps from embeddings")
def nfe_scaling(spark, sf_dir):
    f = vectors(spark, sf_dir).select("vec_id", ((F.col("vec_id") % 11) / F.lit(10.0)).alias("fraction"))
    return f.select("vec_id", "fraction", bridge.nfe(25, F.col("fraction")).alias("steps"))
