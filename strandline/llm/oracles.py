"""DuckDB SQL for the queries that SQL can express, run over the same tables."""

from __future__ import annotations

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op2_decontaminate"] = rf"""
with d as (select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') s
        from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
lens as (select distinct k from win),
occ as (select doc_id, p.i, p.k, item_id
        from (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s
              from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, lens where len(w) >= k)) p join win using (s, k)),
hits as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from occ) group by 1),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from occ group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

ORACLES["op4_embedding_dedup"] = """
with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (with recursive t(a, b) as (select a, b from l union select t.a, l.b from t join l on t.b = l.a) select a, min(b) m from t group by a)
select vec_id, (select count(*) from l where l.a = vec_id) n_links, least(vec_id, coalesce(m, vec_id)) component_id, least(vec_id, coalesce(m, vec_id)) = vec_id kept
from embeddings left join r on r.a = vec_id
"""

ORACLES["op7_extendible_shards"] = f"""
with d as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) n_bytes,
                  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) h from documents),
s as (select k, h >> (48 - k) p, sum(n_bytes) b, min(h) lo, max(h) hi from d, (select unnest(range(0, 25)) k) group by all),
f as (select s.k, s.p, s.b from s left join s q on q.k = s.k - 1 and q.p = s.p >> 1
      where (s.b <= {16 << 20} or s.lo = s.hi) and (s.k = 0 or not (q.b <= {16 << 20} or q.lo = q.hi)))
select doc_id, n_bytes, case when k = 0 then '' else lpad(bin(p), cast(k as integer), '0') end shard, cast(0 as bigint) page,
       cast(k as bigint) local_depth, cast(b as bigint) shard_bytes
from d join f on h >> (48 - k) = p
"""

_FIT = "n * power(k / cast(n as double) - m, 2) - m * (1 - m)"


def _strength(table: str) -> str:
    """Moment estimate of the prior strength, as one row s."""
    return f"""(select 1 / least(greatest((coalesce(greatest(sum({_FIT}), 0), 0) + 0.5::double) / (coalesce(sum(m * (1 - m) * (n - 1)) * (count(*) - 1) / greatest(count(*), 1), 0) + 1), 0.001), 0.9) - 1 s
               from {table} where n > 0)"""


ORACLES["op1_url_filter"] = rf"""
with p as (select page_id, coalesce({_AZ.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
o as (select doc_id page_id, max(case when quality is null and toxic is null then null when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) bad
      from labels where doc_id is not null group by 1),
h as (select host, count(bad) n, coalesce(sum(bad), 0) k,
             case when regexp_matches(host, '\.((ac|co|com|edu|gov|net|org)\.[a-z][a-z])$') then regexp_extract(host, '\.((ac|co|com|edu|gov|net|org)\.[a-z][a-z])$', 1)
                  else split_part(host, '.', -1) end suffix
      from p left join o using (page_id) group by host),
hd as (select *, case when length(host) <= length(suffix) + 1 then host
                      else split_part(substr(host, 1, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix end domain from h),
hl as (select *, case when n > 0 then 1 else 0 end l from hd),
t0 as (select sum(n) n0, sum(k) k0, sum(l) l0 from hl),
s0 as (select suffix, sum(n) n, sum(k) k, sum(l) l, (select case when n0 > 0 then (k0 + 0.5) / (n0 + 2.0::double) else 0 end from t0) m from hl group by suffix),
s1 as (select suffix, n n1, k k1, l l1, s e1, (k + s * m) / (n + s) m from s0, {_strength("s0")}),
d0 as (select domain, suffix, sum(n) n, sum(k) k, sum(l) l, any_value(s1.m) m from hl join s1 using (suffix) group by domain, suffix),
d1 as (select domain, n n2, k k2, l l2, s e2, (k + s * m) / (n + s) m from d0, {_strength("d0")}),
h0 as (select host, suffix, domain, n, k, l, m from hl join d1 using (domain)),
h1 as (select host, n, k, l, n0, k0, l0, n1, k1, l1, e1, n2, k2, l2, e2, s e3 from h0 join s1 using (suffix) join d1 using (domain), t0, {_strength("h0")}),
p0 as (select *, case when l0 - l > 0 then (k0 - k + 0.5) / (n0 - n + 2.0::double) else 0.0::double end pm, case when l0 - l > 0 then least(e1, cast(l0 - l as double)) else 1.0::double end pe from h1),
p1 as (select * replace ((k1 - k + pe * pm) / (n1 - n + pe) as pm, least(e2, l1 - l + pe, greatest(l0 - l, 1)) as pe) from p0),
p2 as (select * replace ((k2 - k + pe * pm) / (n2 - n + pe) as pm, least(e3, l2 - l + pe, greatest(l0 - l, 1)) as pe) from p1),
ab as (select host, k + pe * pm a, n - k + pe * (1 - pm) b from p2),
h2 as (select host, case when a + b > 200 then a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.3 when a <= 0 then false when b <= 0 then true
    else list_sum(list_transform(range(0, 402), lambda j: exp(lgamma(a + b + j) - lgamma(a + 1 + j) - lgamma(b) + (a + j) * ln(0.3) + b * ln(0.7)))) < 0.05 end bad from ab),
r(pattern, rhost, rpath, rv) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m as (select page_id, arg_max(pattern, length(pattern)) rule, arg_max(rv, length(pattern)) rv
      from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(rv, case when bad then 'block' else 'allow' end) verdict
from p join h2 using (host) left join m using (page_id)
"""

ORACLES["op5_jaccard_join"] = rf"""
with d as (select doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, g from (
        select doc_id, array_to_string(w[i:i + 3], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 2)) i from d where len(w) >= 4)
        union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3)),
n as (select doc_id, count(*) n from s group by 1),
x as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
r as (with recursive t(a, b) as (select a, b from l union select t.a, l.b from t join l on t.b = l.a) select a, min(b) m from t group by a)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id
from d left join n using (doc_id) left join r on r.a = d.doc_id
"""

ORACLES["op10_line_dedup"] = r"""
with l as (select doc_id, string_split(text, chr(10)) ls from documents),
u as (select doc_id, no, ls[no] line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) no from l)),
e as (select doc_id, no, line from u where regexp_matches(line, '[^\x20\x09-\x0D]')),
f as (select line, min((doc_id, no)) pos from e group by line),
w as (select line, pos, string_split(line, ' ') w from f where len(string_split(line, ' ')) >= 4),
v as (select line, pos, len(w) n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') s from (select line, pos, w, unnest(range(1, len(w) + 1)) i from w where len(w) >= 5)),
near as (select a.line, b.pos from v a join v b on a.s = b.s and a.n = b.n and a.i = b.i and a.line <> b.line
         union all select a.line, b.pos from v a join w b on a.s = array_to_string(b.w, ' ')
         union all select b.line, a.pos from v a join w b on a.s = array_to_string(b.w, ' ')),
c as (select line, min(pos) pos from (select * from f union all select * from near) group by line),
g as (select doc_id, list(no) gone from e join c using (line) where (doc_id, no) > pos group by doc_id),
k as (select doc_id, ls, coalesce(gone, []) gone from l left join g using (doc_id))
select doc_id, cast(coalesce(len(ls), 0) as bigint) n_lines, cast(len(gone) as bigint) n_removed,
       sha256(coalesce(array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i)), chr(10)), '')) kept_sha256
from k
"""

_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _rounds(n: int) -> str:
    """Assignments a0..a{n} to codebooks c0..c{n}: each of n rounds assigns all parts, then moves the entries."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} as (select vec_id, j, any_value(x) x, arg_min(e, (d, e)) e, min(d) d from (
    select p.vec_id, p.j, p.x, c.e, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) d from p join c{i} c using (j)) group by vec_id, j)""")
        if i < n:
            out.append(f"""c{i + 1} as (select c.j, c.e, coalesce(m.x, c.x) x from c{i} c left join (
    select j, e, list(floor(s / n) order by i) x from (select j, e, i, sum(x[i]) s, count(*) n from (select j, e, x, unnest(range(1, len(x) + 1)) i from a{i}) group by j, e, i) group by j, e) m using (j, e))""")
    return ",\n".join(out)


ORACLES["op12_vector_codes"] = f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * cast(x as double))) v from embeddings where {_WHOLE}),
p as (select vec_id, j, v[j * (len(v) // 8) + 1:(j + 1) * (len(v) // 8)] x from (select vec_id, v, unnest(range(0, 8)) j from k)),
f as (select vec_id, row_number() over (order by vec_id) - 1 e from k order by vec_id limit 16),
c0 as (select j, e, x from p join f using (vec_id)),
{_rounds(6)},
b as (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by j, e, i)) codebooks_sha256 from (select j, e, unnest(x) v, unnest(range(0, len(x))) i from c6)),
r as (select vec_id, string_agg(printf('%02x', e), '' order by j) code, cast(sum(d) as bigint) error from a6 group by vec_id),
l as (select vec_id, code, error, label from r join k using (vec_id))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from l, b
"""

ORACLES["op13_hard_negatives"] = f"""
with k as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end y, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
    from embeddings where label is not null and {_WHOLE}),
s as (select a.vec_id anchor_id, k.vec_id id, a.y = k.y same, cast(list_inner_product(a.v, k.v) as bigint) s from k a join k on a.vec_id <> k.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id, s from s where same qualify row_number() over (partition by anchor_id order by s desc, id) <= 5),
n as (select anchor_id, p.id positive_id, s.id negative_id, p.s positive_score, s.s negative_score from p join s using (anchor_id) where not same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select anchor_id, positive_id, cast(row_number() over w as integer) rank, negative_id, positive_score, negative_score from n
window w as (partition by anchor_id, positive_id order by negative_score desc, negative_id) qualify rank <= 3
"""
