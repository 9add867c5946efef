"""Endpoint preparation: cells, clones, labels, genes, pairs, splits, shards, sidecars, ledgers, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import det, vec
from quillspark.operators import indexing, pairing, records, tokens
from quillspark.plans.base import E, q6, query, r6, table, vectors
from quillspark.sources import layouts

CELLS = """cells as (select event_id, user_id, day(ts)::double as t, event_type, props from events
  where user_id is not null and (abs(day(ts)::double - 2) <= 1e-8 + 1e-5 * 2 or abs(day(ts)::double - 6) <= 1e-8 + 1e-5 * 6)),
 sided as (select *, case when t < 4 then 'e' else 'l' end as side from cells)"""


def cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return pairing.endpoints(e, pairing.first_number(F.concat(F.lit("Day "), F.dayofmonth("ts"), F.lit("d"))), "user_id", 2, 6)


@query(f"with {CELLS} select row_number() over (order by event_id) - 1 as compact_id, event_id, user_id, t as time_numeric, side from sided")
def endpoint_cells(spark, sf_dir):
    return indexing.dense_index(cells(spark, sf_dir), "event_id", "compact_id").select("compact_id", "event_id", "user_id", "time_numeric", "side")


@query("""select l_orderkey, n as n_clones, case when n = 1 then c end as clone_id, c as clone_multi from
  (select l_orderkey, count(distinct l_partkey) as n, min(l_partkey) as c from lineitem group by l_orderkey)""")
def clone_assign(spark, sf_dir):
    found = pairing.clone_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return found.select("l_orderkey", "n_clones", F.when(F.col("n_clones") == 1, F.col("first_clone")).alias("clone_id"), F.col("first_clone").alias("clone_multi"))


@query("select l_orderkey, count(distinct l_partkey) as n_clones, min(l_partkey) as clone_id from lineitem where l_partkey is not null group by l_orderkey")
def clone_assign_multi(spark, sf_dir):
    """Rows of several clones go to the first stored one."""
    return pairing.assign_clones(table(spark, sf_dir, "lineitem").filter("l_partkey is not null"), "l_orderkey", "l_partkey", allow_multi=True)


@query("""with x as (select distinct coalesce(event_type, 'unknown') as label from events), y as (select distinct coalesce(json_extract_string(props, '$.k'), 'none') as label from events)
  select 'fate' as kind, label, row_number() over (order by label) - 1 as code from x union all select 'context', label, row_number() over (order by label) - 1 from y""")
def label_encode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.coalesce("event_type", F.lit("unknown")).alias("fate"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("context"))
    return indexing.label_codes(e, "fate").select(F.lit("fate").alias("kind"), "label", "code").union(indexing.label_codes(e, "context").select(F.lit("context"), "label", "code"))


@query(f"""with n as (select count(distinct l_orderkey)::double as n from lineitem),
  g as (select l_partkey, sum(ln(1 + l_quantity * 10000)) as s, sum(ln(1 + l_quantity * 10000) ** 2) as ss from lineitem group by l_partkey),
  v as (select p_partkey, coalesce(ss, 0) / n - (coalesce(s, 0) / n) ** 2 as var, coalesce(s, 0) / n as mean from part left join g on p_partkey = l_partkey, n)
  select p_partkey, {q6('mean')} as mean, {q6('var')} as var from (select *, row_number() over (order by round(var, 9) desc, p_partkey) as r from v) where r <= 100""")
def hvg_topk(spark, sf_dir):
    out = records.variable_columns(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100)
    return out.select("p_partkey", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query(f"""with {E}, x as (select vec_id, unnest(e) as v, generate_subscripts(e, 1) - 1 as pos from e),
  m as (select pos, avg(v) as mu, case when stddev_pop(v) < 1e-6 then 1 else stddev_pop(v) end as sd from x group by pos)
  select vec_id, pos::int as pos, {q6('(v - mu) / sd')} as z from x join m using (pos)""")
def latent_standardize(spark, sf_dir):
    return records.standardised(vectors(spark, sf_dir), "vec_id", "e").select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", r6(F.col("z")).alias("z"))


PAIRS = CELLS + """,
 ok as (select user_id, count(*) filter (side = 'e') as ne, count(*) filter (side = 'l') as nl from sided group by user_id having ne >= 1 and nl >= 1),
 ranked as (select s.user_id, side, event_id, row_number() over (partition by s.user_id, side order by md5('0:rank:' || side || ':' || event_id), event_id) - 1 as r from sided s join ok using (user_id))"""
SAMPLED = PAIRS + """,
 draws as (select user_id, k, case when ne >= 4 then k else ('0x' || substr(md5('0:drawe:' || user_id || ':' || k), 1, 8))::ubigint::bigint % ne end as re,
   case when nl >= 4 then k else ('0x' || substr(md5('0:drawl:' || user_id || ':' || k), 1, 8))::ubigint::bigint % nl end as rl from ok, range(4) as t(k)),
 pairs as (select d.user_id, d.k, a.event_id as early_id, b.event_id as late_id from draws d join ranked a on a.user_id = d.user_id and a.side = 'e' and a.r = d.re join ranked b on b.user_id = d.user_id and b.side = 'l' and b.r = d.rl)"""
SPLIT = """,
 groups as (select distinct user_id from pairs), sizes as (select count(*) as n from groups),
 quota as (select n, least(case when n >= 3 then greatest(1, round_even(n * 0.1::double, 0)) else 0 end, greatest(0, n - 1)) as r from sizes),
 quota2 as (select n, r, least(case when n >= 3 then greatest(1, round_even(n * 0.1::double, 0)) else 0 end, greatest(0, n - 1 - r)) as t from quota),
 split as (select user_id, case when k <= r then 2 when k <= r + t then 1 else 0 end as split from (select user_id, row_number() over (order by md5('0:split:' || user_id), user_id) as k from groups), quota2)"""


def pairs(spark, sf_dir):
    return pairing.sampled_pairs(cells(spark, sf_dir), "user_id", "event_id", 4)


@query(f"with {SAMPLED} select * from pairs")
def clone_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


def _turn_sql() -> str:
    """One turn of the permutation on s(u, k, n, a, b, turn, place): its rounds as selects inside each other."""
    inner = "select u, k, n, a, b, turn, place // b as x, place % b as y from s where turn = 0 or place >= n"
    for r in range(det.ROUNDS):
        known, side, moved, other = ("x", "b", "y", "x") if r % 2 == 0 else ("y", "a", "x", "y")
        inner = f"select u, k, n, a, b, turn, {other}, ({moved} + ('0x' || substr(md5('0:pairs:' || u || ':{r}:' || {known}), 1, 8))::ubigint::bigint % {side}) % {side} as {moved} from ({inner})"
    return f"select u, k, n, a, b, turn + 1, x * b + y from ({inner})"


@query(f"""with recursive {PAIRS}, sized as (select user_id as u, unnest(range(50)) as k, (ne * nl)::bigint as n, ceil(sqrt((ne * nl)::double))::bigint as a from ok where ne * nl > 50),
  s as (select u, k, n, a, (n + a - 1) // a as b, 0 as turn, k as place from sized union all {_turn_sql()}),
  d as (select u as user_id, k, place from s where turn > 0 and place < n union all select user_id, unnest(range(ne * nl)) as k, unnest(range(ne * nl)) as place from ok where ne * nl <= 50)
  select d.user_id, d.k, a.event_id as early_id, b.event_id as late_id from d join ok using (user_id) join ranked a on a.user_id = d.user_id and a.side = 'e' and a.r = d.place // ok.nl join ranked b on b.user_id = d.user_id and b.side = 'l' and b.r = d.place % ok.nl""")
def clone_pairs_all(spark, sf_dir):
    return pairing.all_pairs(cells(spark, sf_dir), "user_id", "event_id", 50)


@query(f"with {SAMPLED}{SPLIT} select user_id, split::int as split from split")
def clone_split(spark, sf_dir):
    return pairing.group_split(pairing.eligible(cells(spark, sf_dir), "user_id", 1).select("user_id"), "user_id")  # each of them has pairs


@query(f"with {SAMPLED}{SPLIT} select split::int as split, count(*) as n_pairs, count(distinct user_id) as n_clones from pairs join split using (user_id) group by split")
def split_counts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.join(clone_split(spark, sf_dir), "user_id").groupBy("split").agg(F.count("*").alias("n_pairs"), F.countDistinct("user_id").alias("n_clones"))


@query(f"""with {SAMPLED}{SPLIT}, {E}, c as (select count(*) as n from e)
  select split::int as split, count(*) as n_rows, {q6('avg(list_distance(a.e, b.e) ** 2 / len(a.e))')} as mse from pairs p join split using (user_id), c, e a, e b
  where a.vec_id = early_id % n and b.vec_id = late_id % n group by split""")
def fate_pairs_mse(spark, sf_dir):
    e = vectors(spark, sf_dir)
    n = e.count()
    p = pairs(spark, sf_dir).join(clone_split(spark, sf_dir), "user_id").withColumn("i", F.pmod("early_id", F.lit(n))).withColumn("j", F.pmod("late_id", F.lit(n)))
    a, b = e.select(F.col("vec_id").alias("i"), F.col("e").alias("x0")), e.select(F.col("vec_id").alias("j"), F.col("e").alias("x1"))
    d = p.join(a, "i").join(b, "j").withColumn("d", vec.total(F.zip_with("x0", "x1", lambda x, y: (x - y) * (x - y))) / F.size("x0"))
    return d.groupBy("split").agg(F.count("*").alias("n_rows"), r6(F.avg("d")).alias("mse"))


@query(f"""with {SAMPLED}, {E}, c as (select count(*) as n from e)
  select user_id, k, {q6('list_distance(a.e, b.e)')} as distance from pairs p, c, e a, e b where a.vec_id = early_id % n and b.vec_id = late_id % n""")
def bucketed_pairs(spark, sf_dir):
    """Distances of the pairs' endpoints, both gathered from one table in buckets: the vectors are written once and not exchanged again."""
    e = vectors(spark, sf_dir).select("vec_id", "e")
    n = e.count()
    held = layouts.bucketed(e, "vec_id", 8)
    p = pairs(spark, sf_dir).withColumn("i", F.pmod("early_id", F.lit(n))).withColumn("j", F.pmod("late_id", F.lit(n)))
    both = layouts.gather(layouts.gather(p, held, "vec_id", {"a": "e"}, "i"), held, "vec_id", {"b": "e"}, "j")
    return both.select("user_id", "k", r6(vec.dist(F.col("a"), F.col("b"))).alias("distance"))


@query(f"with {SAMPLED} select * from pairs order by user_id, k limit 64")
def first_batch(spark, sf_dir):
    return pairs(spark, sf_dir).orderBy("user_id", "k").limit(64)


@query("select doc_id, doc_id // 100 as shard_id, doc_id % 100 as local_row, row_number() over (order by doc_id) - 1 as idx from documents where length(trim(text)) > 0")
def valid_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.length(F.trim("text")) > 0).select("doc_id")
    return records.addressed(indexing.dense_index(d, "doc_id", "idx"), "doc_id", 100).select("doc_id", "shard_id", "local_row", "idx")


@query("select doc_id, doc_id // 100 as shard_id, doc_id % 100 as local_row, 'latents_' || lpad((doc_id // 100)::varchar, 5, '0') as file from documents")
def shard_address(spark, sf_dir):
    d = records.addressed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)
    return d.select("doc_id", "shard_id", "local_row", F.concat(F.lit("latents_"), F.lpad(F.col("shard_id").cast("string"), 5, "0")).alias("file"))


@query("""with s as (select doc_id // 100 as shard_id, count(*) filter (length(text) > 0) as n_filled from documents group by 1),
  c as (select *, coalesce(sum(n_filled) over (order by shard_id rows between unbounded preceding and 1 preceding), 0)::bigint as before, sum(n_filled) over () as total from s)
  select shard_id, n_filled, before from c where before < total * 0.4::double""")
def shard_prefix_percent(spark, sf_dir):
    d = records.addressed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 100)
    return indexing.prefix_percent(d, "shard_id", F.coalesce(F.length("text") > 0, F.lit(False)), 40)


@query("select doc_id, idx, (idx % 8)::int as rank from (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents)")
def rank_round_robin(spark, sf_dir):
    return indexing.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8)


@query("select d.doc_id, l.doc_id is not null as present, coalesce(l.quality::double, 0) as quality, coalesce(l.toxic::double, 0) as toxic from documents d left join labels l using (doc_id)")
def sidecar_attach(spark, sf_dir):
    side = table(spark, sf_dir, "labels").select("doc_id", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("emb"))
    out = records.attach(table(spark, sf_dir, "documents").select("doc_id"), side, "doc_id", "emb", 2)
    return out.select("doc_id", "present", F.get("emb", F.lit(0)).alias("quality"), F.get("emb", F.lit(1)).alias("toxic"))


@query("select doc_id from documents where length(text) > 0 and doc_id not in (select doc_id from labels where doc_id is not null)")
def sidecar_todo(spark, sf_dir):
    return records.todo(table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


VALID = """v as (select page_id, case when page_id % 17 = 0 then '' else url end as key, ['tag', 'short', 'medium', 'long', 'other'][page_id % 5 + 1] as caption_type, case when page_id % 7 = 0 then '' else trim(html) end as caption from pages),
 w as (select page_id, key, case when key = '' then 'bad_record' when caption_type not in ('tag', 'short', 'medium', 'long') or caption = '' then case when caption <> '' then 'bad_caption_type' else 'empty_caption' end end as reason from v)"""


def page_records(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("tag", "short", "medium", "long", "other"))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = p.select("page_id", F.when(F.col("page_id") % 17 == 0, "").otherwise(F.col("url")).alias("key"), kind.alias("caption_type"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.trim("html")).alias("caption"))
    return rows.withColumn("reason", records.reason(F.col("key"), F.col("caption_type"), F.col("caption")))


@query(f"with {VALID} select page_id, reason is null as ok from w")
def record_validation(spark, sf_dir):
    return page_records(spark, sf_dir).select("page_id", F.col("reason").isNull().alias("ok"))


@query(f"with {VALID} select page_id, key, reason from w where reason is not null")
def failure_ledger(spark, sf_dir):
    return page_records(spark, sf_dir).filter("reason is not null").select("page_id", "key", "reason")


@query("""with n as (select count(*) as n from documents) select doc_id, r <= round_even(n * 0.05::double, 0) as is_val from (select doc_id, row_number() over (order by md5('3:val:' || doc_id), doc_id) as r from documents), n""")
def train_val_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    (held,) = indexing.order_cuts(d, det.digest(3, "val", F.col("doc_id")), "doc_id", lambda n: [round(n * 0.05)])
    return d.select("doc_id", held.alias("is_val"))


@query("select vec_id from (select vec_id, row_number() over (order by md5('5:sub:' || vec_id), vec_id) as r from embeddings) where r <= 100 order by vec_id")
def subsample_sorted(spark, sf_dir):
    return indexing.best_by_digest(table(spark, sf_dir, "embeddings").select("vec_id"), det.digest(5, "sub", F.col("vec_id")), "vec_id", 100)


TOKENS = """w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 t as (select doc_id, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 6))::ubigint::int % 400 + 1) as ids from w)"""


@query(f"with {TOKENS} select doc_id, array_to_string(list_concat(ids[1:16], list_transform(range(greatest(0, 16 - len(ids))), lambda x: 0)), ' ') as token_ids, least(len(ids), 16)::bigint as length from t")
def token_pad_mask(spark, sf_dir):
    t = tokens.padded(tokens.hashed_ids(table(spark, sf_dir, "documents"), 400, 16), 16)
    return t.select("doc_id", F.concat_ws(" ", F.col("token_ids").cast("array<string>")).alias("token_ids"), F.col("length").cast("bigint").alias("length"))


@query(f"with {TOKENS} select doc_id, array_to_string(list_concat(ids[1:8], list_transform(range(greatest(0, 8 - len(ids))), lambda x: 999)), ' ') as token_ids, least(len(ids), 8)::bigint as length from t")
def pad_id_remap(spark, sf_dir):
    t = tokens.remapped(tokens.padded(tokens.hashed_ids(table(spark, sf_dir, "documents"), 400, 16), 16), 8, 999)
    return t.select("doc_id", F.concat_ws(" ", F.col("token_ids").cast("array<string>")).alias("token_ids"), F.col("length").cast("bigint").alias("length"))


@query(f"""with {TOKENS}, {E}, x as (select doc_id, unnest(ids[1:8]) as id, generate_subscripts(ids[1:8], 1) - 1 as pos from t),
  u as (select vec_id, list_transform(e[1:16], lambda v: v / (sqrt(list_inner_product(e[1:16], e[1:16])) + 1e-12)) as e from e)
  select doc_id, pos::int as pos, {q6('e[1] * sqrt(16)')} as first, {q6('list_sum(e) * sqrt(16)')} as total from x join u on u.vec_id = x.id""")
def vocab_lookup(spark, sf_dir):
    t = tokens.padded(tokens.hashed_ids(table(spark, sf_dir, "documents"), 400, 8), 8)
    out = tokens.embedded(t, vectors(spark, sf_dir).select(F.col("vec_id").alias("token_id"), F.col("e").alias("vec")), 16)
    return out.select("doc_id", "pos", r6(F.get("unit", F.lit(0)) * 4.0).alias("first"), r6(vec.total(F.col("unit")) * 4.0).alias("total"))


@query("""select a.conv_id, a.turn, (list_sum(list_transform(range(least(len(a.w), len(b.w))), lambda i: (a.w[i + 1] <> b.w[i + 1])::int)) )::bigint is not null as same_shape,
  (coalesce(list_sum(list_transform(range(least(len(a.w), len(b.w))), lambda i: (a.w[i + 1] <> b.w[i + 1])::int)), 0) + abs(len(a.w) - len(b.w)))::bigint as num_diff
  from (select conv_id, turn, string_split(text, ' ') as w from conversations) a join (select conv_id, turn, string_split(text, ' ') as w from conversations) b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def token_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", (F.least(F.size("w"), F.size("v")) > 0).alias("same_shape"), tokens.difference(F.col("w"), F.col("v")).alias("num_diff"))
