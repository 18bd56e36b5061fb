"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from plumbline.llm.url_filter import DEFAULT, RULES

OP1 = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents
), g as (
  select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256
from t join g using (text_sha256)
"""


OP7 = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select payload_digest, max(page_id) as largest from p where payload_bytes >= 1000 group by payload_digest having count(*) > 1
)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when g.largest is null or p.page_id = g.largest then 'response' else 'revisit' end as record_type,
  case when p.page_id <> g.largest then g.largest end as refers_to
from p left join g using (payload_digest)
"""


OP11 = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as digest from documents
), u as (
  select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
    [cast('0x' || substr(digest, 8 * i + 1, 8) as bigint) for i in [0, 1, 2, 3]] as h
  from t
), c as (
  select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from u
), p as (
  select *, array_to_string(units[:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c
)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


#: Strings of 400 bytes are 800 hexadecimal digits; a removed run ends where the next start is more than 400 bytes on.
OP12 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n_bytes from documents),
places as (select doc_id, x, unnest(range(0, n_bytes - 399)) as spot from d where n_bytes >= 400),
strings as (select doc_id, spot, md5_number(substr(x, 2 * spot + 1, 800)) as h from places),
again as (select h from strings group by h having count(*) > 1),
marks as (select doc_id, spot, case when spot - lag(spot) over (partition by doc_id order by spot) <= 400 then 0 else 1 end as fresh from strings semi join again using (h)),
runs as (select doc_id, spot, sum(fresh) over (partition by doc_id order by spot) as run from marks),
spans as (select doc_id, run, min(spot) as a, max(spot) + 400 as b from runs group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
ends as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last from spans group by doc_id),
kept as (select doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as front from gaps join d using (doc_id) group by doc_id)
select d.doc_id, n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then x else front || substr(x, 2 * last + 1) end)) as kept_sha256
from d left join ends using (doc_id) left join kept using (doc_id)
"""


def op10() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for r in RULES)
    return f"""
with r(verdict, host, path, rule) as (values {rules}),
rest as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), u as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path
  from rest
), m as (
  select u.page_id, u.host, u.path, r.rule, r.verdict,
    row_number() over (partition by u.page_id order by length(r.rule) desc nulls last, length(r.host) desc nulls last) as n
  from u left join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') as verdict from m where n = 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DEDUP = rf"""
with recursive words as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words
),
sizes as (select doc_id, len(s) as n from sets),
members as (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from members a join members b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, other) as (select a, b from both_ways union select r.node, l.b from reach r join both_ways l on l.a = r.other),
least as (select node, min(other) as other from reach group by node)
select d.doc_id, cast(n as bigint) as n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) as component_id, d.doc_id <= coalesce(l.other, d.doc_id) as kept
from sizes d left join least l on l.node = d.doc_id
"""

TOP_K = """
with pairs as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: cast((x[1] > 0) <> (x[2] > 0) as bigint))) as distance
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0
)
select query_id, rank, vec_id, cast(distance as bigint) as distance
from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs) where rank <= 10
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1, "op2_near_dedup": NEAR_DEDUP, "op7_warc": OP7, "op9_top_k": TOP_K, "op10_url_filter": op10(), "op11_fill_in_middle": OP11, "op12_repeat_removal": OP12}
