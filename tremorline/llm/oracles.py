"""The corpus queries that SQL can express, for DuckDB."""
from __future__ import annotations

_UNIFORM = "(('0x' || substr(md5({key}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0"
_ID = "coalesce(doc_id::varchar, '~')"

# The CRC-32 table follows from its polynomial: eight shift-and-xor steps for each byte value.
_CRC = """
  crc_step(k, step, c) as (
    select k, 0, k from range(0, 256) t(k)
    union all
    select k, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_step where step < 8),
  crc_table as (select list(c order by k) as crc from crc_step where step = 8),
  bytes as (
    select *, hex(encode(coalesce(text, ''))) as hexed from documents),
  sized as (
    select doc_id, text, source, strlen(coalesce(text, ''))::bigint + 1 as size,
      xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, (length(hexed) / 2)::bigint),
        lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::bigint)),
        lambda acc, b: xor(crc[(xor(acc, b) & 255) + 1], acc >> 8)), 4294967295::bigint) as text_crc32
    from bytes, crc_table)"""


def _won(names: str, of: int) -> str:
    """Which of the ``of`` nodes of weight ``w`` named by ``n`` has the least draw."""
    u = _UNIFORM.format(key=f"'place 0|' || {_ID} || '|' || {names}")
    return f"list_min(list_transform(range(0, {of}), lambda n: {{'draw': -ln({u}) / w, 'node': n}})).node"


ORACLES: dict[str, str] = {
    "op1_hash_tree_shards": f"""
with recursive {_CRC},
regions as (select *, 8.0::double as w from sized),
in_region as (select * exclude w, {_won("n::varchar", 2)} as region, 4.0::double as w from regions),
in_rack as (select * exclude w, {_won("region::varchar || '/' || n::varchar", 2)} as rack, 1.0::double as w from in_region),
placed as (
  select *, region * 8 + rack * 4 + {_won("region::varchar || '/' || rack::varchar || '/' || (region * 8 + rack * 4 + n)::varchar", 4)} as shard,
    {_UNIFORM.format(key=f"'place 0|' || {_ID} || '|change 0'")} < 1.0::double / 17 as moves,
    ('0x' || substr(md5('piece|' || {_ID} || '|' || size::varchar || '|' || text_crc32::varchar), 1, 8))::bigint % 4096
      as piece
  from in_rack)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by piece, doc_id nulls first, size, text_crc32) - 1 as slot,
  (case when moves then 16 else shard end)::int as grown_shard, region::int as region, rack::int as rack
from placed""",
    "op2_poisson_mixture": f"""
with recursive {_CRC},
sources as (
  select source, sum(size)::bigint as bytes, round(sqrt(sum(size)::double) * 1000)::bigint as weight from sized group by 1),
rates as (
  select source, weight::double / (select sum(weight)::double from sources) * (select sum(bytes)::double from sources) * 1.0
    / bytes::double as rate from sources),
parts as (select source, rate, greatest(ceil(rate / 16.0), 1)::int as parts from rates),
terms as (
  select source, rate, parts, 0 as k, exp(-(rate / parts)) as term, exp(-(rate / parts)) as total from parts
  union all
  select source, rate, parts, k + 1, term * (rate / parts) / (k + 1)::double, total + term * (rate / parts) / (k + 1)::double
  from terms where k < 100),
draws as (
  select d.doc_id, d.text, d.source, d.text_crc32, p.rate, x.part,
    {_UNIFORM.format(key=f"'copies 0|' || {_ID} || '|' || x.part::varchar")} as u
  from sized d join parts p on d.source is not distinct from p.source, lateral (select unnest(range(1, p.parts + 1)) as part) x),
drawn as (
  select w.doc_id, w.part, (select count(*) from terms t where t.source is not distinct from w.source and t.total < w.u) as n
  from draws w),
counts as (select doc_id, sum(n)::bigint as n from drawn group by 1)
select o.doc_id, o.text, o.lang, o.source, o.n_chars, c.copy::int as copy, r.rate,
  md5('order 0|' || coalesce(o.doc_id::varchar, '~') || '|' || c.copy::varchar || '|' || s.text_crc32::varchar) as mix_key
from documents o join sized s on s.doc_id = o.doc_id join rates r on r.source is not distinct from o.source
join (select doc_id, unnest(range(1, n + 1)) as copy from counts where n > 0) c on c.doc_id = o.doc_id""",
    "op11_prefix_trie": """
with recursive crc_step(k, step, c) as (
    select k, 0, k from range(0, 256) t(k)
    union all
    select k, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_step where step < 8),
crc_table as (select list(c order by k) as crc from crc_step where step = 8),
keyed as (
  select conv_id, turn, coalesce(text, '') as text, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key
  from conversations where conv_id is not null),
own as (
  select conv_id, list({'key': key, 'size': length(text)} order by turn nulls first, key) as turns from keyed group by 1),
shared as (
  select conv_id, turns, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), lambda acc, b: xor(crc[(xor(acc, b) & 255) + 1], acc >> 8)), 4294967295::bigint) % 6)::bigint as h
  from own, crc_table),
rebuilt as (
  select s.conv_id, list_concat(coalesce(b.turns[1:s.h], []), s.turns[s.h + 1:]) as turns
  from shared s left join own b on b.conv_id = s.conv_id - s.conv_id % 100),
steps as (
  select conv_id, len(turns) as length, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt),
placed as (
  select conv_id, length, depth, list_aggregate(list_transform(turns[1:depth], lambda t: t.key), 'string_agg', '') as path,
    case when depth > 0 then turns[depth].size else 0 end as size,
    list_transform(range(0, depth + 1), lambda d: coalesce(list_aggregate(list_transform(turns[1:d], lambda t: t.key), 'string_agg', ''), '')) as above
  from steps),
nodes as (
  select coalesce(path, '') as path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    any_value(above) as above, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '')) as ends_sha256
  from placed group by 1),
children as (select above[-2] as path, count(*) as n from nodes where depth > 0 group by 1),
told as (
  select n.*, coalesce(c.n, 0) as n_children, p.conv_id as parent_conv_id from nodes n left join children c on c.path = n.path
  left join nodes p on n.depth > 0 and p.path = n.above[-2]),
below as (
  select top, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * size) as saved
  from (select unnest(above) as top, n_children, n_convs, size from told) group by 1)
select t.conv_id, t.depth::bigint as depth, t.parent_conv_id, t.n_convs::bigint as n_convs, t.n_children::bigint as n_children,
  b.n_leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, t.ends_sha256
from told t join below b on b.top = t.path""",
    "op12_prefix_refined_audit": """
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents),
held as (select doc, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as n from held group by all having count(distinct doc) >= 3),
sizes as (
  select g.lang, coalesce(k.v, 0)::hugeint as v, coalesce(k.n, 0)::hugeint as n
  from (select distinct lang from docs) g left join (select lang, count(*) as v, sum(n) as n from kept group by 1) k on k.lang = g.lang),
counts as (select h.lang, h.source, h.term, count(*)::hugeint as n from held h join kept k on k.lang = h.lang and k.term = h.term group by all),
totals as (
  select g.lang, g.source, s.v, coalesce(c.n, 0)::hugeint as n from (select distinct lang, source from docs) g join sizes s on s.lang = g.lang
  left join (select lang, source, sum(n) as n from counts group by all) c on c.lang = g.lang and c.source = g.source),
shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.n + t.v) as p
  from totals t join kept k on k.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
summed as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from shares a join shares b on b.lang = a.lang and b.term = a.term and b.source != a.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from totals a join totals b on b.lang = a.lang and b.source != a.source
  left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
lang_shares as (
  select k.lang, k.term, 1 + 1000000000::hugeint * (k.n + 1) // (s.n + s.v) as q from kept k join sizes s on s.lang = k.lang),
telling as (
  select a.lang, a.source, 'term' as part, a.term as item, ((a.p - l.q) * (a.p - l.q) // l.q)::bigint as value
  from shares a join lang_shares l on l.lang = a.lang and l.term = a.term where a.n > 0 and a.p > l.q),
ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
  from (select * from pairs union all select * from telling))
select * from ranked where part = 'pair' or rank <= 200""",
}
