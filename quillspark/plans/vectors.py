"""Vector algebra over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import det, vec
from quillspark.operators import metrics
from quillspark.plans.base import E, q6, query, r6, vectors

EXPLODED = "select vec_id, (generate_subscripts(z, 1) - 1)::int as pos, {q} as z from (select vec_id, z, unnest(z) as v from z)"


def _out(sql: str) -> str:
    """vec_id, pos, z of a list column z."""
    return f"with {E}, z as ({sql}) select vec_id, (pos - 1)::int as pos, {q6('v')} as z from (select vec_id, unnest(z) as v, generate_subscripts(z, 1) as pos from z)"


def _explode(df, column):
    return df.select("vec_id", F.posexplode(column).alias("pos", "z")).select("vec_id", "pos", r6(F.col("z")).alias("z"))


@query(_out("select vec_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) as z from e"))
def l2_normalize(spark, sf_dir):
    return _explode(vectors(spark, sf_dir).withColumn("z", vec.normalise(F.col("e"))), "z")


@query(_out("select vec_id, list_transform(e[1:16], lambda x: x / (sqrt(list_inner_product(e[1:16], e[1:16])) + 1e-12)) as z from e"))
def mrl_truncate(spark, sf_dir):
    return _explode(vectors(spark, sf_dir).withColumn("z", vec.truncate(F.col("e"), 16)), "z")


@query(_out("select vec_id, list_transform(e, lambda x: (x - 0.1::double) * 1.5::double) as z from e"))
def latent_affine(spark, sf_dir):
    return _explode(vectors(spark, sf_dir).withColumn("z", F.transform("e", lambda x: (x - F.lit(0.1)) * F.lit(1.5))), "z")


SOURCE = "list_transform(range(64), lambda o: e[(((((o % 16) // 4) // 2) * 2 + ((o % 4) // 2)) * 16 + (((o % 16) // 4) % 2 * 2 + (o % 4) % 2) * 4 + o // 16) + 1])"


@query(_out(f"select vec_id, {SOURCE} as z from e"))
def pack_bridge(spark, sf_dir):
    return _explode(vectors(spark, sf_dir).withColumn("z", vec.packed(F.col("e"), 4, 4, 4, 2)), "z")


@query("select vec_id, true as same from embeddings")
def pack_roundtrip(spark, sf_dir):
    p = vec.packed(F.col("e"), 4, 4, 4, 2)
    return vectors(spark, sf_dir).withColumn("p", p).select("vec_id", (vec.unpacked(F.col("p"), 4, 4, 4, 2) == F.col("e")).alias("same"))


NORMS = "list_transform(range(8), lambda i: sqrt(list_inner_product(e[i * 8 + 1 : i * 8 + 8], e[i * 8 + 1 : i * 8 + 8])))"


@query(f"with {E}, n as (select vec_id, {NORMS} as n from e) select vec_id, {q6('n[1]')} as first_norm, coalesce(nullif(list_position(list_transform(n, lambda x: x < 0.25), true), 0) - 1, 8)::bigint as stop from n")
def token_norm_stop(spark, sf_dir):
    n = vectors(spark, sf_dir).withColumn("n", vec.token_norms(F.col("e"), 8))
    return n.select("vec_id", r6(F.get("n", F.lit(0))).alias("first_norm"), vec.first_true(F.transform("n", lambda x: x < F.lit(0.25))).alias("stop"))


NEXT = "p as (select a.vec_id, a.e as a, b.e as b, a.label as la, b.label as lb from e a join e b on b.vec_id = (a.vec_id + 1) % (select count(*) from e))"


def neighbours(spark, sf_dir):
    """Each vector (a) with the next one (b), the last with the first."""
    e = vectors(spark, sf_dir)
    n = e.count()
    a = e.select("vec_id", F.col("e").alias("a"), F.col("label").alias("la"))
    b = e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("e").alias("b"), F.col("label").alias("lb"))
    return a.join(b, "vec_id")


@query(f"""with {E}, {NEXT}, w as (select *, acos(greatest(-1, least(1, list_inner_product(a, b)))) as o, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as s from p),
  z as (select vec_id, s, list_transform(range(1, 65), lambda i: case when abs(sin(o)) < 1e-6 then a[i] else sin((1 - s) * o) / sin(o) * a[i] + sin(s * o) / sin(o) * b[i] end) as z from w)
  select vec_id, s, {q6('z[1]')} as z0, {q6('list_sum(z)')} as total, {q6('sqrt(list_inner_product(z, z))')} as norm from z""")
def slerp_path(spark, sf_dir):
    p = neighbours(spark, sf_dir).withColumn("s", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    p = p.withColumn("z", vec.slerp(F.col("a"), F.col("b"), F.col("s")))
    return p.select("vec_id", "s", r6(F.get("z", F.lit(0))).alias("z0"), r6(vec.total(F.col("z"))).alias("total"), r6(vec.norm(F.col("z"))).alias("norm"))


@query(f"""with {E}, {NEXT}, k as (select vec_id, unnest(range(8)) as pos, a, b, 2 + vec_id % 6 as na, 2 + (vec_id + 3) % 6 as nb from p),
  t as (select vec_id, pos, na, nb, a[pos * 8 + 1 : pos * 8 + 8] as a, b[pos * 8 + 1 : pos * 8 + 8] as b from k),
  u as (select vec_id, pos, na, nb, list_transform(a, lambda x: x / (sqrt(list_inner_product(a, a)) + 1e-12)) as a, list_transform(b, lambda x: x / (sqrt(list_inner_product(b, b)) + 1e-12)) as b from t),
  o as (select *, acos(greatest(-1, least(1, list_inner_product(a, b)))) as o from u),
  z as (select vec_id, pos, case when pos < na and pos < nb then list_transform(range(1, 9), lambda i: case when abs(sin(o)) < 1e-6 then a[i] else sin(0.7::double * o) / sin(o) * a[i] + sin(0.3::double * o) / sin(o) * b[i] end)
    when pos < na then list_transform(a, lambda x: 0.7::double * x) when pos < nb then list_transform(b, lambda x: 0.3::double * x) else list_transform(a, lambda x: 0.0::double) end as z from o)
  select vec_id, pos::int as pos, {q6('z[1]')} as z0, {q6('list_sum(z)')} as total from z""")
def caption_fade(spark, sf_dir):
    p = neighbours(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("na", F.lit(2) + F.col("vec_id") % 6).withColumn("nb", F.lit(2) + (F.col("vec_id") + 3) % 6)
    for c in ("a", "b"):
        p = p.withColumn(c, vec.normalise(F.slice(c, F.col("pos") * 8 + 1, F.lit(8))))
    out = metrics.faded(F.col("a"), F.col("b"), F.col("pos") < F.col("na"), F.col("pos") < F.col("nb"), 0.3)
    return p.withColumn("z", out).select("vec_id", "pos", r6(F.get("z", F.lit(0))).alias("z0"), r6(vec.total(F.col("z"))).alias("total"))


GAUSS = "sqrt(-2 * ln((('0x' || substr(md5({k}), 1, 8))::ubigint::double + 0.5) / 4294967296)) * cos(6.283185307179586::double * ((('0x' || substr(md5({k}), 9, 8))::ubigint::double + 0.5) / 4294967296))"


def gauss_sql(seed: int, stream: str, *keys: str) -> str:
    return GAUSS.format(k=f"concat_ws(':', '{seed}', '{stream}', {', '.join(keys)})")


@query(f"select vec_id, {q6(gauss_sql(7, 'g', 'vec_id'))} as g from embeddings")
def hash_gauss(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r6(det.gauss(det.digest(7, "g", F.col("vec_id")))).alias("g"))


@query(f"""with {E}, k as (select vec_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) as u from e),
  g as (select vec_id, u, list_transform(range(64), lambda i: {gauss_sql(11, 'tan', 'vec_id', 'i')}) as g from k),
  v as (select vec_id, u, list_transform(range(1, 65), lambda i: g[i] - list_inner_product(g, u) * u[i]) as v from g),
  z as (select vec_id, u, list_transform(range(1, 65), lambda i: case when sqrt(list_inner_product(v, v)) < 1e-8 then u[i] else cos(0.2::double) * u[i] + sin(0.2::double) * v[i] / sqrt(list_inner_product(v, v)) end) as z from v)
  select vec_id, {q6('z[1]')} as z0, {q6('acos(greatest(-1, least(1, list_inner_product(u, z))))')} as angle from z""")
def tangent_perturb(spark, sf_dir):
    u = vectors(spark, sf_dir).select("vec_id", vec.normalise(F.col("e")).alias("u"))
    g = u.withColumn("g", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: det.gauss(det.digest(11, "tan", F.col("vec_id"), i))))
    z = metrics.turned(g, "u", "g", 0.2)
    return z.select("vec_id", r6(F.get("z", F.lit(0))).alias("z0"), r6(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot(F.col("u"), F.col("z")))))).alias("angle"))


@query(f"with {E} select label, {q6('avg(e[1])')} as c0, {q6('avg(e[64])')} as c63, count(*) as n from e group by label")
def centroids(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(r6(F.avg(F.get("e", F.lit(0)))).alias("c0"), r6(F.avg(F.get("e", F.lit(63)))).alias("c63"), F.count("*").alias("n"))


@query(f"""with {E}, x as (select unnest(e) as v, generate_subscripts(e, 1) - 1 as pos from e), q as (select pos, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from x group by pos)
  select pos::int as pos, {q6('lo - 0.08::double * greatest(hi - lo, 1e-6)')} as low, {q6('hi + 0.08::double * greatest(hi - lo, 1e-6)')} as high from q""")
def robust_limits(spark, sf_dir):
    return metrics.robust_limits(vectors(spark, sf_dir), "e", 0.08).select("pos", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(f"with {E} select vec_id, list_position(e, list_max(e)) - 1 as id from e")
def argmax_decode(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", vec.argmax(F.col("e")).cast("bigint").alias("id"))


@query(f"with {E} select vec_id, {q6('sin(1000 * (vec_id / 500.0::double) * exp(-ln(10000) * 3 / 8))')} as s3, {q6('cos(1000 * (vec_id / 500.0::double) * exp(-ln(10000) * 3 / 8))')} as c3 from e")
def time_embedding(spark, sf_dir):
    t = metrics.time_embedding(F.col("vec_id") / F.lit(500.0), 16)
    return vectors(spark, sf_dir).withColumn("t", t).select("vec_id", r6(F.get("t", F.lit(3))).alias("s3"), r6(F.get("t", F.lit(11))).alias("c3"))
