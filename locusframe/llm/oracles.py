"""SQL of the operators' results, for an engine with list functions over the same tables."""

WORD_RE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '{WORD_RE}'), []) as w from documents),
win as (
  select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as s
  from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select s from win group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) as p from win where s in (select s from rep)),
ws as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select ws.r, string_agg(ws.word, ' ' order by ws.p) as text, count(*) as n
  from ws left join gone on ws.r = gone.r and ws.p = gone.p where gone.p is null group by ws.r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from d left join kept k on d.r = k.r
"""

OP5 = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (
  select item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null),
bw as (
  select distinct cast(item_id as varchar) as item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (
  select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
hit as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
pos as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join pos on d.r = pos.r left join its on d.r = its.r
"""

OP2 = rf"""
with recursive d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{WORD_RE}'), []) as w from documents),
sh as (
  select distinct r, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as s
  from (select r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select r, count(*) as n from sh group by r),
inter as (
  select a.r as x, b.r as y, count(*) as c from sh a join sh b on a.s = b.s and a.r < b.r
  group by a.r, b.r),
link as (
  select x, y from inter join n nx on nx.r = x join n ny on ny.r = y where 100 * c >= 75 * (nx.n + ny.n - c)),
edge as (select x, y from link union select y, x from link),
reach(a, b) as (select r, r from d union select reach.a, edge.y from reach join edge on reach.b = edge.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles,
       (select min(e.doc_id) from reach join d e on e.r = reach.b where reach.a = d.r) as component_id
from d left join n on n.r = d.r
"""

OP10 = """
with c as (
  select row_number() over () as r, vec_id, embedding from embeddings where vec_id is not null and embedding is not null),
u as (select r, vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as i, len(embedding) as n from c),
bad as (select distinct r from u where x is null or not isfinite(x)),
e as (select vec_id, cast(floor(64 * x) as bigint) as x, i, n from u where r not in (select r from bad)),
p as (
  select a.vec_id as query_id, b.vec_id as vec_id, cast(sum(a.x * b.x) as bigint) as score
  from e a join e b on a.i = b.i and a.n = b.n and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1, 2)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20
"""

OP9 = rf"""
with recursive d as (
  select row_number() over () as r, doc_id, text, source, cast(coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0) as bigint) as size from documents),
m as (
  select *, (cast(cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u,
         cast(floor(sqrt(cast(size as double)) * 1024) as bigint) as w
  from d),
s as (
  select source, cast(sum(size) as double) as size, cast(sum(w * size) as double) as mass,
         [3.0, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3) + 1]::double as weight
  from m group by source),
level(i, x) as (
  select 0, (select 1.5 * sum(size) / sum(weight) from s)
  union all
  select i + 1, (select (1.5 * sum(s.size) - coalesce(sum(2 * s.size) filter (2 * s.size <= level.x * s.weight), 0)) / sum(s.weight) filter (2 * s.size > level.x * s.weight) from s)
  from level where i < (select count(*) from s) and exists (select 1 from s where 2 * s.size > level.x * s.weight)),
t as (select *, least(2 * size, (select max(x) from level) * weight) as target from s),
p as (
  select *, floor(case when size > 0 then least(2.0, target / size) else 0 end + 1e-9) as whole from t),
q as (select *, greatest(0, floor(target - whole * size + 1e-6)) as due from p),
k as (
  select m.r, m.doc_id, m.text, m.source, m.size, q.due,
         least(1 - 1e-9, greatest(1e-9, (case when q.mass > 0 then q.due / q.mass else 0 end) * m.w)) as inc, m.u
  from m join q on m.source is not distinct from q.source where m.size > 0 and q.due > 0),
o as (select *, (u / (1 - u)) / (inc / (1 - inc)) as odds from k),
g as (
  select source, doc_id, text, floor(odds / (1 + odds) * 4503599627370496.0) as place, sum(size) as words, any_value(size) as size, any_value(due) as due
  from o group by source, doc_id, text, odds),
n as (select *, row_number() over (partition by source order by place) as i from g),
walk(source, doc_id, text, i, rest, most, round, taken) as (
  select distinct source, cast(null as bigint), cast(null as varchar), 0, due, due, 1, false from n
  union all
  select n.source, n.doc_id, n.text, n.i,
         case when n.size <= w.most and n.words <= w.rest then w.rest - n.words else w.rest end,
         case when n.size <= w.most and n.words > w.rest then w.rest else w.most end,
         case when n.size <= w.most and n.words > w.rest then w.round + 1 else w.round end,
         n.size <= w.most and n.words <= w.rest and w.round <= 4
  from walk w join n on n.source is not distinct from w.source and n.i = w.i + 1),
x as (select * from walk where taken)
select m.doc_id, m.size, cast(q.size as bigint) as source_size, q.target, cast(m.size * least(2, q.whole + (x.i is not null)::int) as bigint) as taken
from m join q on m.source is not distinct from q.source
left join x on x.source is not distinct from m.source and x.doc_id is not distinct from m.doc_id and x.text is not distinct from m.text
"""


def _op12(rounds: int = 6) -> str:
    """Lloyd rounds as a chain of assignments a0, a1, ... and codebooks b0, b1, ..."""
    near = """{a} as materialized (select rid, p, arg_min(e, d * 16 + e) as e, min(d) as d from (
  select c.rid, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) as d from part c join {b} b on b.p = c.p and b.j = c.j group by c.rid, c.p, b.e) group by rid, p)"""
    mean = """{b} as materialized (select o.p, o.e, o.j, coalesce(m.x, o.x) as x from {old} o left join (
  select a.p, a.e, c.j, (sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) as x
  from part c join {a} a on a.rid = c.rid and a.p = c.p group by a.p, a.e, c.j) m on m.p = o.p and m.e = o.e and m.j = o.j)"""
    steps = [x for i in range(rounds) for x in (near.format(a=f"a{i}", b=f"b{i}"), mean.format(a=f"a{i}", b=f"b{i + 1}", old=f"b{i}"))]
    steps.append(near.format(a="a", b=f"b{rounds}"))
    return """with kept as materialized (select row_number() over () as rid, vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select rid, vec_id, (j - 1) // (n // 8) as p, (j - 1) %% (n // 8) as j, x
  from (select rid, vec_id, unnest(range(1, len(v) + 1)) as j, len(v) as n, unnest(list_transform(v, lambda x: floor(4096 * x::double)::hugeint)) as x from kept)),
firsts as (select rid, row_number() over (order by vec_id) - 1 as e from kept qualify e < 16),
b0 as materialized (select p, e, j, x from part join firsts on firsts.rid = part.rid),
%s,
codes as (select rid, string_agg(printf('%%02x', e), '' order by p) as code, sum(d) as error from a group by rid),
named as (select k.vec_id, k.label, c.code, c.error from kept k join codes c on c.rid = k.rid),
tot as (select label, sum(error) as t from named group by label)
select vec_id, code, error::bigint as error, t::bigint as label_error, (select sha256(string_agg(x::varchar, ',' order by p, e, j)) from b%d) as codebooks_sha256
from named n join tot on tot.label is not distinct from n.label""" % (",\n".join(steps), rounds)


OP12 = _op12()

_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = """with words as materialized (select row_number() over () as r, doc_id, unnest(%s) as t from documents where text is not null),
tf as materialized (select r, any_value(doc_id) as doc_id, t, count(*) as tf from words group by r, t),
size as materialized (select r, count(*) as n from words group by r),
tot as materialized (select count(*) as docs, sum(n)::bigint as l from size),
df as (select t, count(*) as df from tf group by t),
w as materialized (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, tot),
asked as (select row_number() over () as i, item_id, unnest(%s) as t from benchmark where text is not null),
q as materialized (select i, any_value(item_id) as item_id, t, count(*) as k from asked group by i, t),
m as materialized (select r, 25 + (75 * n * docs) // l as m from size, tot),
s as (select i, any_value(q.item_id) as item_id, tf.r, any_value(tf.doc_id) as doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from q join w on w.t = q.t join tf on tf.t = q.t join m on m.r = tf.r group by i, tf.r)
select item_id, rank::integer as rank, doc_id, score from (
  select *, row_number() over (partition by i order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""" % (_TERMS.format(t="text"), _TERMS.format(t="text"))
