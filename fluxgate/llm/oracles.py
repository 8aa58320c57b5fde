"""DuckDB twins of those contract queries that SQL can express on whole tables.

Not expressible, and held against brute force in tests/llm instead: op2 (a k-d
tree), op4 (a trained field), op5 (tokenizers), op7 (a trained net)."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS
from .url_filter import RULES as URL_RULES

_WORD = r"'[^\x20\x09-\x0D]+'"


def _rule_case(host: str, path: str, what: str) -> str:
    """The longest fitting rule's string or verdict."""
    order = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    whens = [f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}') then '{h + p if what == 'rule' else v}'" for v, h, p in order]
    return "case " + " ".join(whens) + " end"


def _host(u: str) -> str:
    return rf"(case when contains({u}, '://') then translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end)"


def _path(u: str) -> str:
    return rf"(case when contains({u}, '://') then regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') else '' end)"


def _node(u: str) -> str:
    return rf"(case when contains({u}, '://') then regexp_replace({_host(u)}, ':(80|443)$', '') || regexp_replace({_path(u)}, '/+$', '') || regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1, 's') end)"


_ATTR = r"""\s*=\s*["'']?([^"''\s>]+)"""
OP1 = rf"""
with recursive p as (select page_id, url, html, {_host('coalesce(url, chr(0))')} as host, {_path('coalesce(url, chr(0))')} as path, {_node('url')} as node from pages),
j as (select page_id, host, path, node, {_rule_case('host', 'path', 'rule')} as rule, {_rule_case('host', 'path', 'verdict')} as own from p),
tags as (select url, tag from (select url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^<>]*>')) as tag from p)
  where regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') or regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
links as (select url, case when tag ilike '<link%' then regexp_extract(tag, '(?i)\bhref{_ATTR}', 1) else regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) end as link from tags),
absolute as (select url, case when link = '' or starts_with(link, '#') then null when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then split_part(url, '://', 1) || ':' || link
  when starts_with(link, '/') then regexp_extract(url, '^.*?://[^/?#]*') || link else regexp_replace(regexp_extract(url, '^.*?://[^/?#]*(?:/[^?#]*/|/)?'), '/?$', '/') || link end as target from links),
e as (select {_node('url')} as a, {_node('target')} as b from absolute where target is not null),
s as (select a, b from e union select b, a from e),
reach(n, m) as (select a, a from s union select r.n, s.b from reach r join s on s.a = r.m),
said as (select node as n, own as v from j where own is not null and node is not null union select {_node('u')}, {_rule_case(_host('u'), _path('u'), 'verdict')} from (select url as u from absolute where target is not null union select target from absolute where target is not null)),
near as (select n, m from reach union select node, node from j where node is not null),
fate as (select near.n, bool_or(v = 'allow') as allowed, bool_or(v = 'block') as blocked from near join said on said.n = near.m where v is not null group by 1)
select page_id, host, path, rule, coalesce(own, case when blocked and not allowed then 'block' else 'allow' end) as verdict from j left join fate on fate.n = j.node"""

OP3 = """
with v as (select vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] as q from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)])::BIGINT as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::INT as rank, vec_id, score from s qualify rank <= 10"""

OP6 = r"""
with l as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
c as (select k, max(doc_id) as keep from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines, count(*) filter (c.k is not null and doc_id <> keep) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (c.k is null or doc_id = keep), '')) as kept_sha256 from l left join c using (k) group by doc_id"""


def _rules() -> str:
    out = []
    for name, low, high in RULES:
        out += [f"coalesce({name} >= {low}, true)"] * (low is not None) + [f"coalesce({name} <= {high}, true)"] * (high is not None)
    return " and ".join(out)


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
OP8 = rf"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORD}) as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
r as (select doc_id, count(distinct i + k) as n from (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1), range(0, 8) x(k) group by 1),
m as (select doc_id, len(w)::BIGINT as n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines, coalesce(r.n, 0)::BIGINT as n_repeat_words,
  len(list_filter(w, lambda x: list_contains({_STOP}, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) as n_stop,
  len(list_filter(w, lambda x: regexp_matches(x, '^[\p{{Lu}}\p{{N}}\p{{P}}\p{{S}}]*\p{{Lu}}[\p{{Lu}}\p{{N}}\p{{P}}\p{{S}}]+$'))) as n_upper, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•·]'))) as n_bullet, len(lines) as n_lines from w left join r using (doc_id)),
f as (select *, word_chars / nullif(n_words, 0) as mean_word_chars, n_symbols / nullif(n_words, 0) as symbols_per_word, n_stop / nullif(n_words, 0) as stop_word_share, n_upper / nullif(n_words, 0) as upper_word_share,
  n_dup_lines / nullif(n_lines, 0) as repeated_line_share, n_repeat_words / nullif(n_words, 0) as repeated_word_share, n_bullet / nullif(n_lines, 0) as bullet_line_share from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {_rules()} as kept from f"""

OP9 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
u as (select a, b from e union select b, a from e),
reach(i, j) as (select doc_id, doc_id from documents union select r.i, u.b from reach r join u on u.a = r.j)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, c.component_id from documents d left join n using (doc_id) join (select i as doc_id, min(j) as component_id from reach group by 1) c using (doc_id)"""

OP10 = rf"""
with d as (select doc_id, source, size, floor(sqrt(size) * 16)::BIGINT as w, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || h || '|mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 as u
  from (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT as size, md5(coalesce(text, '')) as h from documents)),
s as (select source, sum(size)::BIGINT as source_size, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 as weight from d group by 1),
c as (select *, 3 * source_size as cap from s),
o as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as ws from c),
p as (select *, cap * ws <= weight * lft as stops from o),
t as (select source, source_size, case when stops then cap::DOUBLE else weight::DOUBLE * (sum(source_size) over () - coalesce(sum(cap) filter (stops) over (), 0))::BIGINT / (sum(weight) filter (not stops) over ())::BIGINT end as target from p),
k as (select d.source, w, any_value(target) as target, sum(size)::BIGINT as words from d join t on d.source is not distinct from t.source where size > 0 group by 1, 2),
l as (select source, w, (target - 3 * coalesce(sum(words) over (partition by source order by w desc rows between unbounded preceding and 1 preceding), 0)::BIGINT)
  / (sum(words * w) over (partition by source order by w desc rows between current row and unbounded following))::BIGINT as rate from k),
r as (select source, coalesce(arg_max(rate, w) filter (rate * w < 3 - 1e-9), 3.0::DOUBLE) as rate from l group by 1),
q as (select d.doc_id, d.source, size, source_size, target, u, case when size > 0 then least(3.0::DOUBLE, rate * w) else 0.0::DOUBLE end as e from d join t on d.source is not distinct from t.source left join r on d.source is not distinct from r.source),
x as (select *, floor(e)::BIGINT as certain, case when e > floor(e) then (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) end as odds from q),
m as (select source, any_value(target) - sum(certain * size)::BIGINT as more from x group by 1),
y as (select x.*, more, sum(size) over (partition by x.source order by odds, doc_id rows unbounded preceding) as upto from x join m on x.source is not distinct from m.source where odds is not null),
z as (select *, upto <= more as taken_whole from y),
g as (select source, any_value(more) - coalesce(max(upto) filter (taken_whole), 0) as gap from z group by 1),
h as (select z.source, arg_min((z.doc_id, size), (abs(gap - size), odds, z.doc_id)) as fit, any_value(gap) as gap from z join g on z.source is not distinct from g.source where not taken_whole and abs(gap - size) < gap group by 1),
i as (select source, fit[1] as doc, gap - fit[2] as gap from h),
j as (select z.source, arg_min(z.doc_id, (abs(gap - size), odds, z.doc_id)) as doc from z join i on z.source is not distinct from i.source where not taken_whole and z.doc_id <> i.doc and abs(gap - size) < gap group by 1)
select x.doc_id, x.size, x.source_size, x.target, (x.certain + (coalesce(z.taken_whole, false) or coalesce(i.doc = x.doc_id, false) or coalesce(j.doc = x.doc_id, false))::INT) * x.size as taken
  from x left join z on z.doc_id = x.doc_id left join i on i.source is not distinct from x.source left join j on j.source is not distinct from x.source"""

ORACLES = {
    "op1_redirect_url_filter": OP1,
    "op3_bit_sliced_top_k": OP3,
    "op6_levelled_line_dedup": OP6,
    "op8_quality_rules": OP8,
    "op9_parity_sketch_join": OP9,
    "op10_pareto_mix": OP10,
}
