"""DuckDB SQL of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {WORDS} as w from documents),
tri as (select r, i, w[i:i + 2] as g from d, unnest(range(1, len(w) - 1)) t(i)),
rep as (select r, g from tri group by r, g having count(*) > 1),
cov as (select r, count(distinct p) as n from (select tri.r, unnest([i, i + 1, i + 2]) as p from tri join rep using (r, g)) group by r),
dup as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
c as (select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from d left join dup using (r) left join cov using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
f as (select source, rule, (case when rule = 'short' then n_words < 50 else 100 * n_repeat_words > 50 * n_words end)::int as bad from b, (values ('short'), ('repeats')) x(rule)),
h as (select source, rule, count(*)::double as n, sum(bad)::double as k from f group by 1, 2),
m as (select rule, count(*)::double as h, sum(n) as n, sum(n * n) as nn, sum(k) / sum(n) as m, sum(k * k / n) as kk from h group by 1),
o as (select rule, m, case when m * (1 - m) > 0 and n - nn / n - (h - 1) > 0 then ((kk - n * m * m) / (m * (1 - m)) - (h - 1)) / (n - nn / n - (h - 1)) else 0.0 end as rho from m),
s as (select rule, m, 1 / least(0.5, greatest(1e-4, rho)) - 1 as s from o),
v as (select source as host, max((k + m * s) / (n + s)) as worst, max(case when rule = 'short' then (k + m * s) / (n + s) end) as a, max(case when rule = 'repeats' then (k + m * s) / (n + s) end) as b from h join s using (rule) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and worst <= 0.5 as kept, round(v.a, 6) as host_short_rate, round(v.b, 6) as host_repeats_rate
from b join v on source is not distinct from host"""

DECONTAMINATION = rf"""
with it as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
iw as (select distinct item_id, least(len(w), 10) as l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s from it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select r, l, i, array_to_string(w[i:i + l - 1], ' ') as s from d, (select distinct l from iw), unnest(range(1, len(w) - l + 2)) t(i)),
h as (select r, i, l, item_id from dw join iw using (l, s)),
p as (select r, count(distinct q)::bigint as n from (select r, unnest(range(i, i + l)) as q from h) group by r),
n as (select r, count(distinct item_id)::bigint as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(p.n, 0) as n_hit, coalesce(n.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, p.n is not null as contaminated from d left join p using (r) left join n using (r)"""

MIXING = rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
k as (select *, md5('mix-1:' || coalesce(doc_id::varchar, 'null-' || size) || ':' || row_number() over (partition by doc_id, source, size)) as seeded from d),
w as (select *, row_number() over (order by source asc nulls last) - 1 as place, 1 + place % 3 as weight, ceil(source_size / 8)::bigint as blocks from (select source, sum(size)::bigint as source_size from d group by 1)),
-- whichever sources are taken as capped, the others' share of what is left is no more than the level: the largest is it
l as (select sum(source_size) over () - coalesce(sum(3 * source_size) over o, 0) as ls, sum(weight) over () - coalesce(sum(weight) over o, 0) as lw from w
  window o as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)),
v as (select ls::bigint as ls, lw::bigint as lw from l order by ls / lw desc limit 1),
t as (select w.*, least((3 * source_size)::double, weight * ls / lw) as target, case when source_size > 0 then target * blocks / source_size else 0.0::double end as votes from w, v),
z as (select round(sum(round(votes, 6)::decimal(28, 6)))::bigint as seats from t),
won as (select place as wp, count(*)::bigint as quota from (select place from t, unnest(range(1, 3 * blocks + 1)) u(seat) where votes > 0
  qualify row_number() over (order by votes / (2 * seat - 1) desc, place, seat) <= (select seats from z)) group by 1),
x as (select k.*, t.source_size, target, place, greatest(blocks, 1) as n, coalesce(quota, 0) as quota, coalesce(quota, 0) // n as passes, coalesce(quota, 0) % n as rest,
  sum(size) over (partition by k.source order by seeded rows unbounded preceding)::bigint - size as b4 from k join t on k.source is not distinct from t.source left join won on place = wp),
y as (select x.*, b, b // 4096 as s, s * 4096 as f, least(f + 4096, n) as e, e - f as m, e::hugeint * rest // n - f::hugeint * rest // n as q from x, unnest(range(b4 // 8, (b4 + size - 1) // 8 + 1)) u(b) where size > 0),
c as (select seeded, sum(least((b + 1) * 8, b4 + size) - greatest(b * 8, b4)) as part from y
  where ((b - f) * ([2654435761, 2246822519, 3266489917, 668265263, 374761393][(s + place) % 5 + 1] % m) + (s * 104729 + place * 7919) % m) % m < q group by 1)
select x.doc_id, x.size, source_size, round(target, 6) as target, (passes * x.size + coalesce(part, 0))::bigint as taken from x left join c using (seeded)"""

REVISITS = r"""
with e as (select page_id as n, url, length(html)::varchar as size, md5(regexp_extract(url, '//[^/]+/([a-z]+)/', 1)) as edition from pages),
r as (select 2 * n as record_id, n, url, 2 * n as ts, 'response' as kind, case when n % 2 = 0 then edition end as etag, size as lm, size as len, edition from e
  union all select 2 * n + 1, n, 'HTTP://WWW.' || regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://(www\.)?', '') || case when contains(url, '?') then '&' else '?' end || 'utm_medium=feed#again',
    2 * n + case when n % 7 = 0 then -1 else 1001 end, 'revisit', case when n % 2 = 0 then case when n % 6 = 0 then 'other' else edition end end, case when n % 5 > 0 then size end, '0', edition from e),
b as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '(?i)^https?://(www\.)?', '') as bare from r),
c as (select *, split_part(bare, '?', 1) as p, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(split_part(x, '=', 1), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$'))) as q from b),
u as (select *, regexp_replace(lower(regexp_extract(p, '^[^/]*')), ':(80|443)$', '') || regexp_replace(regexp_extract(p, '/.*$'), '/+$', '') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as canonical from c),
l as (select *, last_value(case when kind = 'response' then record_id end ignore nulls) over (partition by canonical order by ts, record_id rows between unbounded preceding and 1 preceding) as b_id from u),
j as (select l.*, x.etag as b_etag, x.lm as b_lm, x.len as b_len from l left join u x on x.record_id = b_id),
s as (select *, case when kind = 'response' then 'full' when b_id is null then 'unresolved' when etag is not null and b_etag is not null then case when etag = b_etag then 'validated' else 'mismatch' end
  when lm is not null and b_lm is not null then case when lm = b_lm then 'validated' else 'mismatch' end else 'unchecked' end as status from j)
select record_id, canonical, kind, case when kind = 'revisit' then b_id end as refers_to, status, 'content-length=' || case when status in ('validated', 'unchecked') then b_len else len end || '&date=' || ts || '&etag=' || edition as headers from s"""

#: op6 without n_links: the links that were needed to connect a group are not for SQL to tell.
COMPONENTS = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from g group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * n_both >= 80 * (x.n + y.n - n_both)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as low from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id from d left join n using (doc_id) left join m on m.a = d.doc_id"""

HARD_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as score from v a, v r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5"""

EXACT_DEDUP = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256 from d"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": QUALITY_RULES, "op6_ngram_join": COMPONENTS, "op8_mixing": MIXING, "op9_revisits": REVISITS, "op10_decontamination": DECONTAMINATION, "op11_hard_negatives": HARD_NEGATIVES, "op13_exact_dedup": EXACT_DEDUP,
}
