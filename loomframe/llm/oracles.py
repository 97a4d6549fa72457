"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LINE = r"""
with l as (
  select doc_id, pos, line, lower_az(key) as key from (
    select doc_id, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as key
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents))
), d as (select key, min(doc_id) as first_doc from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select l.doc_id, l.pos, l.line, coalesce(d.first_doc <> l.doc_id, false) as gone from l left join d on l.key = d.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS = f"""
with i as (select item_id, {_WORDS} as w from benchmark),
w as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1)) as p from i where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
x as (select doc_id, p, s.n, array_to_string(list_slice(d.w, p, p + s.n - 1), ' ') as win
  from (select doc_id, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) as p from d cross join (select distinct n from w)) d join (select distinct n from w) s on s.n = d.n),
h as (select x.doc_id, x.p, x.n, w.item_id from x join w on w.n = x.n and w.win = x.win),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)"""

_NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + 2), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
r as (select doc_id as node, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as component_id from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id"""

_VECTORS = r"""
with recursive v as (select vec_id, label, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r as (select vec_id as node, vec_id as root from v union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as component_id from r group by node),
k as (select a, count(*) as n from e group by a)
select v.vec_id, coalesce(k.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.node = v.vec_id left join k on k.a = v.vec_id"""

#: Strings of 200 bytes are told apart by md5; `numbered` gives repeated rows numbers of their own.
_REPEATS = r"""
with numbered as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as t from documents),
w as (select r, unnest(range(0, octet_length(t) - 199)) as p, t from numbered where octet_length(t) >= 200),
k as (select r, p, md5(t[p + 1:p + 200]) as h from w),
again as (select h from k group by h having count(*) > 1),
s as (select r, p, coalesce(p - lag(p) over (partition by r order by p) > 200, true)::int as new from k semi join again using (h)),
i as (select r, p, sum(new) over (partition by r order by p) as island from s),
c as (select r, island, min(p) as a, max(p) + 200 as b from i group by r, island),
kept as (select c.r, c.a as stop, coalesce(lag(c.b) over (partition by c.r order by c.a), 0) as start from c
  union all select numbered.r, octet_length(t), coalesce(max(c.b), 0) from numbered left join c on c.r = numbered.r group by numbered.r, t),
text as (select kept.r, string_agg(substr(hex(t), 2 * start + 1, 2 * (stop - start)), '' order by start) as x from kept join numbered on numbered.r = kept.r group by kept.r),
n as (select r, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from c group by r)
select doc_id, octet_length(t)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(x)) as kept_sha256
from numbered join text using (r) left join n using (r)"""


def lower_az(sql: str) -> str:
    """Replace lower_az(x) by translate() over A-Z alone: lower() also changes other letters."""
    return sql.replace("lower_az(", "translate_az(").replace("translate_az(key)", "translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


ORACLES: dict[str, str] = {"op2_suffix_dedup": _REPEATS, "op5_near_dedup": _NEAR, "op7_embedding_dedup": _VECTORS, "op8_decontamination": _LEAKS, "op9_line_dedup": lower_az(_LINE)}
