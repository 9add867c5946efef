"""Queries of the perturbation and editing sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.config import run_mode
from quillspark.functions import bridge, det, vec
from quillspark.operators import editing, simulate
from quillspark.plans.base import E, q6, query, r6, table, vectors
from quillspark.plans.process import T, components, pinned, timed
from quillspark.plans.vectors import NEXT, gauss_sql, neighbours


def uniform_sql(seed: int, stream: str, *keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', '{stream}', {', '.join(keys)})), 1, 8))::ubigint::double + 0.5) / 4294967296)"


@query("""with p as (select vec_id, unnest(range(1 + vec_id % 8)) as i, vec_id % 8 as v from embeddings), r as (select vec_id, i, row_number() over (partition by vec_id order by md5('4:pick:' || vec_id || ':' || i)) as k from p where v > 0 and i < v)
  select e.vec_id, coalesce(string_agg(i::varchar, ' ' order by i), '') as picked from embeddings e left join (select * from r where k <= 3) r using (vec_id) group by e.vec_id""")
def token_choice(spark, sf_dir):
    p = editing.chosen_positions(F.col("vec_id"), (F.col("vec_id") % 8).cast("int"), 3, 4)
    return vectors(spark, sf_dir).select("vec_id", F.concat_ws(" ", p.cast("array<string>")).alias("picked"))


@query(f"""with {E}, c as (select vec_id, e, (vec_id % 16) // 4 as row, vec_id % 4 as col from e), w as (select vec_id, e, row, col, list_concat(list_transform(range(4), lambda i: sin(col / pow(10000.0::double, i / 4.0::double))), list_transform(range(4), lambda i: cos(col / pow(10000.0::double, i / 4.0::double))),
  list_transform(range(4), lambda i: sin(row / pow(10000.0::double, i / 4.0::double))), list_transform(range(4), lambda i: cos(row / pow(10000.0::double, i / 4.0::double)))) as w from c) select vec_id, row, col, {q6('w[3]')} as third, {q6('list_inner_product(e[1:16], w)')} as product from w""")
def position_table(spark, sf_dir):
    """Each vector with its cell's position: the product of its first 16 components with it."""
    e = vectors(spark, sf_dir).select("vec_id", "e", F.expr("(vec_id % 16) div 4").alias("row"), (F.col("vec_id") % 4).alias("col"))
    held = e.join(F.broadcast(editing.position_table(spark, 4, 16)), ["row", "col"])  # 16 rows
    return held.select("vec_id", "row", "col", r6(F.get("pos", F.lit(2))).alias("third"), r6(vec.dot(F.slice("e", 1, 16), F.col("pos"))).alias("product"))


@query(f"""select vec_id, {q6('0.001::double + ' + uniform_sql(6, 'time', 'vec_id') + ' * 0.998::double')} as uniform, {q6('least(0.999::double, greatest(0.001::double, 1 / (1 + exp(-(' + gauss_sql(6, 'time', 'vec_id') + ')))))')} as logit_normal,
  {uniform_sql(6, 'drop', 'vec_id')} > 0.1 as keeps from embeddings""")
def time_sampling(spark, sf_dir):
    h = det.digest(6, "time", F.col("vec_id"))
    return vectors(spark, sf_dir).select("vec_id", r6(editing.sampled_time(h)).alias("uniform"), r6(editing.sampled_time(h, "logit_normal")).alias("logit_normal"), editing.keeps_condition(det.digest(6, "drop", F.col("vec_id")), 0.1).alias("keeps"))


@query(f"""with {E}, n as (select vec_id, e, 0.1::double + (vec_id % 9) * 0.1::double as t, list_transform(range(64), lambda i: {gauss_sql(8, 'far', 'vec_id', 'i')}) as far, list_transform(range(64), lambda i: {gauss_sql(8, 'eps', 'vec_id', 'i')}) as g from e),
  x as (select vec_id, list_transform(range(1, 65), lambda i: (1 - t) * e[i] + t * far[i] + sqrt(0.25 * t * (1 - t)) * g[i]) as x, list_transform(range(1, 65), lambda i: e[i] + sqrt(0.25 * t) * g[i]) as y from n)
  select vec_id, {q6('list_sum(x)')} as noised, {q6('list_sum(y)')} as augmented from x""")
def analytic_noising(spark, sf_dir):
    noise = lambda s: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: det.gauss(det.digest(8, s, F.col("vec_id"), i)))
    x = vectors(spark, sf_dir).withColumn("t", F.lit(0.1) + (F.col("vec_id") % 9) * F.lit(0.1)).withColumn("far", noise("far")).withColumn("g", noise("eps"))
    p = bridge.Uniform(0.5)
    return x.select("vec_id", r6(vec.total(editing.noised(F.col("e"), F.col("far"), p, F.col("t"), F.col("g")))).alias("noised"), r6(vec.total(editing.augmented(F.col("e"), p, F.col("t"), F.col("g")))).alias("augmented"))


@query(f"""with {E}, {NEXT}, s as (select vec_id, list_transform(range(1, 65), lambda i: (b[i] - a[i]) / 4 / 0.5 - 0.5 * ((b[i] - a[i]) / 0.25) / 4) as d0, a, b from p) select vec_id, {q6('list_sum(d0)')} as first, {q6('sqrt(list_inner_product(d0, d0))')} as norm from s""")
def infer_increments(spark, sf_dir):
    """Increments of the straight path: the pinned score explains all of the first step."""
    path = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.zip_with("a", "b", lambda x, y: x + (y - x) * (k / F.lit(4.0))))
    x = neighbours(spark, sf_dir).withColumn("path", path).withColumn("d", editing.inferred_increments(F.col("path"), bridge.Uniform(0.5), pinned(bridge.Uniform(0.5)), 4))
    return x.select("vec_id", r6(vec.total(F.get("d", F.lit(0)))).alias("first"), r6(vec.norm(F.get("d", F.lit(0)))).alias("norm"))


@query(f"""with {E}, {NEXT} select vec_id, f as fraction, {q6('(1 - f) * list_sum(a) + f * list_sum(b)')} as total from p, (select unnest([0.25, 0.5, 0.75]::double[]) as f)""")
def incremental_corruption(spark, sf_dir):
    x = neighbours(spark, sf_dir)
    p = bridge.Uniform(0.5)
    states = editing.corruption(F.col("a"), p, pinned(p), [0.75, 0.25, 0.5], 20)
    rows = x.select("vec_id", F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), vec.total(s).alias("t")) for f, s in states])).alias("s"))
    return rows.select("vec_id", "s.fraction", r6(F.col("s.t")).alias("total"))


@query(f"""with {E}, {NEXT}, x as (select {T} as t, unnest(a) as a, unnest(b) as b from p), v as (select t, a, b, (1 - t) * a + t * b as x, (1 - t) ** 2 + t ** 2 + 0.25 * t * (1 - t) as var from x)
  select {q6('avg((0.5::double * x - (b - t / var * x) / sqrt(1 - t * t / var)) ** 2)')} as loss from v""")
def edm_loss(spark, sf_dir):
    x = components(spark, sf_dir).withColumn("x", (F.lit(1.0) - F.col("t")) * F.col("a") + F.col("t") * F.col("b"))
    c = bridge.edm(bridge.Uniform(0.5), F.col("t"))
    return x.select(editing.edm_loss(F.lit(0.5) * F.col("x"), F.col("x"), F.col("b"), c).alias("l")).agg(r6(F.avg("l")).alias("loss"))


@query("""select (case when event_id % 2 = 0 then 'd2d' else 'n2d' end) || (case when user_id % 2 = 0 then '_single' else '_two' end) as mode, count(*) as n from events where user_id is not null group by mode""")
def run_modes(spark, sf_dir):
    """Runs by mode, a run an event: its process and its number of models from the ids."""
    modes = spark.createDataFrame([(p, m, run_mode(p, m)) for p in ("data2data", "noise2data") for m in (1, 2)], "process string, models int, mode string")  # 4 rows
    runs = table(spark, sf_dir, "events").filter("user_id is not null").select(F.when(F.col("event_id") % 2 == 0, "data2data").otherwise("noise2data").alias("process"), (F.lit(1) + F.col("user_id") % 2).cast("int").alias("models"))
    return runs.join(F.broadcast(modes), ["process", "models"]).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"""with {E}, {NEXT}, u as (select list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-12)) as a, list_transform(b, lambda x: x / greatest(sqrt(list_inner_product(b, b)), 1e-12)) as b from p), x as (select acos(greatest(-1, least(1, list_inner_product(a, b)))) as x from u)
  select {q6('coalesce(avg(x) filter (x > 1e-3), 0)')} as angle, count(*) filter (x > 1e-3) as n from x""")
def perturbation_angle(spark, sf_dir):
    x = neighbours(spark, sf_dir).select(vec.normalise_clamped(F.col("a")).alias("a"), vec.normalise_clamped(F.col("b")).alias("b"))
    return editing.mean_changed_angle(x, "a", "b").select(r6(F.col("angle")).alias("angle"), "n")


@query(f"""with {E}, {NEXT} select vec_id, {q6('list_sum(a) + 0.25 * (list_sum(b) - list_sum(a))')} as out_total, {q6('0.0')} as back_error from p""")
def restore_path(spark, sf_dir):
    """Out along the pinned bridge to a quarter of the way, and back by the reverse score to where it began."""
    p = bridge.Uniform(0.5)
    out = simulate.euler(F.col("a"), p, pinned(p), 5, start=0.0, stop=0.25)
    x = neighbours(spark, sf_dir).withColumn("out", out)
    back = simulate.euler(F.col("out"), p, lambda v, t, i: bridge.reverse_score(p, v, F.get("a", i), t), 5, reverse=True, start=0.25, stop=0.0)
    x = x.withColumn("back", back)
    return x.select("vec_id", r6(vec.total(F.col("out"))).alias("out_total"), r6(vec.dist(F.col("a"), F.col("back"))).alias("back_error"))
