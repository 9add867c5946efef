"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from quillspark.llm.alignment import op12_alignment
from quillspark.llm.decontaminate import op2_decontaminate
from quillspark.llm.hard_negatives import op11_hard_negatives
from quillspark.llm.kd_search import op3_kd_search
from quillspark.llm.language_id import op1_language_id
from quillspark.llm.lm_scoring import op10_lm_scoring
from quillspark.llm.near_dup import op7_near_dup
from quillspark.llm.piece_codec import op6_piece_codec
from quillspark.llm.suffix_dedup import op4_suffix_dedup
from quillspark.llm.surrogates import op9_surrogates
from quillspark.llm.token_binary import op5_token_binary
from quillspark.llm.toxicity import op8_toxicity
from quillspark.llm.vector_dedup import op13_vector_dedup

OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score
           from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
     r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


OP4_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
     n as (select doc_id, b, octet_length(b) as n from d),
     w as (select doc_id, s, md5(b[s + 1 : s + 400]) as h from (select doc_id, b, unnest(range(n - 399)) as s from n where n >= 400)),
     c as (select h from w group by h having count(*) > 1),
     r as (select doc_id, s from w where h in (select h from c)),
     g as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 400 then 0 else 1 end as new from r),
     k as (select doc_id, s, sum(new) over (partition by doc_id order by s) as span from g),
     p as (select doc_id, span, min(s) as x, max(s) + 400 as y from k group by doc_id, span),
     q as (select doc_id, count(*) as n_spans, sum(y - x)::bigint as n_removed, list(x order by x) as xs, list(y order by x) as ys from p group by doc_id)
select n.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, coalesce(n_removed, 0) > 0 as repeated, coalesce(n_removed, 0) = 0 as kept,
       case when n_spans is null then sha256(b) else sha256(unhex(array_to_string(list_transform(range(0, n_spans + 1), lambda i: hex(b[case when i = 0 then 1 else ys[i] + 1 end : case when i = n_spans then n else xs[i + 1] end])), ''))) end as kept_sha256
from n left join q on n.doc_id = q.doc_id
"""

OP7_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
     s as (select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
     e as (select doc_id, len(s) as n, unnest(s) as g from s),
     p as (select a.doc_id as u, b.doc_id as v, a.n as n, b.n as m, count(*) as k from e as a join e as b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n),
     l as (select u, v from p where 100 * k >= 80 * (n + m - k)),
     r as (select doc_id as a, doc_id as b from documents union select r.a, l.v from r join l on r.b = l.u),
     c as (select a, min(b) as component_id from r group by a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on doc_id = a
"""


OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_inner_product(a.e, v.e)::bigint as score
           from v as a join v on a.vec_id <> v.vec_id and len(a.e) = len(v.e) where a.vec_id % 100 = 0),
     p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
     n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::integer as rank
           from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


OP13_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
     f as (select vec_id, min(e) as e from v where vec_id is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 group by vec_id),
     l as (select a.vec_id as u, b.vec_id as w from f as a join f as b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
     r as (select vec_id as a, vec_id as b from f union select r.a, l.w from r join l on r.b = l.u),
     c as (select a, min(b) as root from r group by a),
     n as (select u, count(*) as n from l group by u)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(root, v.vec_id) as component_id, coalesce(v.vec_id = coalesce(root, v.vec_id), true) as kept
from v left join c on v.vec_id = a left join n on v.vec_id = u
"""


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_kd_search": op3_kd_search,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_token_binary": op5_token_binary,
        "op6_piece_codec": op6_piece_codec,
        "op7_near_dup": op7_near_dup,
        "op8_toxicity": op8_toxicity,
        "op9_surrogates": op9_surrogates,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_alignment": op12_alignment,
        "op13_vector_dedup": op13_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_kd_search": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op7_near_dup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_vector_dedup": OP13_SQL}
