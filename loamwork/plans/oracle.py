"""DuckDB SQL of the queries, by name. Doubles are rounded as the queries round them."""

PRED = """
p as (select l_returnflag, l_extendedprice as y, l_quantity * u as f from lineitem
  join (select l_returnflag, avg(l_extendedprice / l_quantity) as u from lineitem group by 1) using (l_returnflag))"""
DRAWS = "dr as (select l_suppkey as query_id, l_extendedprice as value from lineitem), tr as (select s_suppkey as query_id, s_acctbal * 4 + 10000 as observed from supplier)"
PICP = f"""with {DRAWS}, lv as (select round(0.05 * i, 2)::double as level from range(1, 20) t(i)),
c as (select query_id, level, any_value(lo) as lo, any_value(hi) as hi from (
  select query_id, level,
    list_sort(v)[1 + floor((n - 1) * a)::int] + ((n - 1) * a - floor((n - 1) * a)) * (list_sort(v)[least(n, 2 + floor((n - 1) * a)::int)] - list_sort(v)[1 + floor((n - 1) * a)::int]) as lo,
    list_sort(v)[1 + floor((n - 1) * b)::int] + ((n - 1) * b - floor((n - 1) * b)) * (list_sort(v)[least(n, 2 + floor((n - 1) * b)::int)] - list_sort(v)[1 + floor((n - 1) * b)::int]) as hi
  from (select query_id, list(value) as v, count(*) as n from dr group by 1), (select level, round((1 - level) / 2, 6) as a, round(1 - (1 - level) / 2, 6) as b from lv)) group by 1, 2)
select level, round(avg(case when observed between lo and hi then 1.0 else 0.0 end), 4) as picp, {{last}} from c join tr using (query_id) group by 1"""

LABEL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[-\\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"
TRANS = """tr as (select * from (select lag(event_type) over (partition by user_id order by ts, event_id) as cause, event_type as effect,
  'user ' || (user_id % 10) as source, 'e' || (event_id % 3) as evidence, round(value / (1 + abs(value)), 6) as confidence,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as "timestamp" from events) where cause is not null)"""
PTS = "pt as (select vec_id as k, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
KNN = f"""{PTS}, e as (select a.k as src, b.k as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as distance from pt a join pt b on a.k <> b.k),
nn as (select *, row_number() over (partition by src order by distance, dst) as rank from e qualify rank <= 8),
nw as (select src, dst, rank, (1 / (distance + 1e-9)) / sum(1 / (distance + 1e-9)) over (partition by src) as weight from nn)"""
VOTERS = """vt as (select doc_id // 40 as k, v as voter, source as cause, 'e' || ((doc_id * i) % 4) as effect, ((doc_id * 7 + i * 3) % 10) / 10.0 as confidence, doc_id as ord
  from documents, (values ('a', 1), ('b', 2), ('c', 3)) t(v, i)),
fi as (select * from vt qualify row_number() over (partition by k, voter, cause, effect order by ord) = 1),
g as (select k, cause, effect, count(*)::bigint as n_voters, round(avg(confidence), 4) as mean_confidence, sum(confidence * case voter when 'a' then 1.0 when 'b' then 2.0 else 0.5 end) as ws,
  string_agg(voter, ' | ' order by voter) as voters from fi group by 1, 2, 3)
select k, cause, effect, n_voters, mean_confidence, voters from g where """
MATCH = """p as (select doc_id % 20 as abstract_id, 'node_' || (doc_id % 7) as cause, 'effect_' || quality as effect, count(*) as np from labels group by all),
g as (select doc_id % 20 as abstract_id, 'node_' || (doc_id % 7) as cause, 'effect_' || greatest(quality, toxic) as effect, count(*) as ng from labels group by all),
b as (select abstract_id, cause, effect, coalesce(np, 0) as np, coalesce(ng, 0) as ng from p full join g using (abstract_id, cause, effect)),
m as (select abstract_id, cause, effect, o as outcome, (case o when 'tp' then least(np, ng) when 'fp' then greatest(np - ng, 0) else greatest(ng - np, 0) end)::bigint as n from b, (values ('tp'), ('fp'), ('fn')) t(o))"""
GRID = "gr as (select p_size::bigint as row, substr(p_brand, 7, 2)::bigint as col, round(avg(p_retailprice), 4) as gain, round(coalesce(stddev_samp(p_retailprice), 0.0), 4) as sd from part group by 1, 2)"
FOLDS = "fo as (select c_custkey, c_nationkey, c_acctbal, ((row_number() over (partition by c_nationkey order by c_custkey) + dense_rank() over (order by c_nationkey) - 2) % 5 + 1)::bigint as fold from customer)"
TERM_ROWS = "(values ('standard'), ('large_brass'), ('promo_burnished_copper'), ('economy'), ('small_plated_tin'), ('medium_polished_steal'), ('copper'), ('nickle')) t(term)"

TAPER = "greatest(0, case when {0} <= 1 then 1 - 5/3*{0}**2 + 5/8*{0}**3 + {0}**4/2 - {0}**5/4 when {0} <= 2 then 4 - 5*{0} + 5/3*{0}**2 + 5/8*{0}**3 - {0}**4/2 + {0}**5/12 - 2/(3*{0}) else 0 end)"


def tile_step(name: str, before: str, n: int) -> str:
    """Each tile's ensemble after its n-th observation."""
    return f"""{name}s as (select e.*, value - avg(value) over (partition by tile, row, col) as dev from {before} e),
{name}o as (select s.tile, s.member, s.value as h, s.dev as d, o.observed, o.row as orow, var_samp(s.value) over (partition by s.tile) + 0.25 as s from {name}s s join ob o on s.tile = o.tile and s.row = o.row and s.col = 2 and o.n = {n}),
{name}k as (select tile, row, col, sum(s.dev * o.d) / (count(*) - 1) / any_value(o.s) as gain, sqrt((row - any_value(orow))**2 + (col - 2)**2) / 2.0 as z from {name}s s join {name}o o using (tile, member) group by 1, 2, 3),
{name} as (select s.tile, s.member, s.row, s.col, s.value + (o.observed - o.h) * k.gain * {TAPER.format("k.z")} as value from {name}s s join {name}o o using (tile, member) join {name}k k on s.tile = k.tile and s.row = k.row and s.col = k.col)"""


def pick_step(k: int) -> str:
    """The k-th pick by uncertainty and distance, and the distances after it."""
    far = f"case when isfinite(max(d) over ()) and max(d) over () > min(d) over () then (d - min(d) over ()) / (max(d) over () - min(d) over ()) else 1.0 end"
    return f"""s{k} as materialized (select *, case when taken then -1e9 else 0.7 * u + 0.3 * ({far}) end as score from d{k}),
p{k} as materialized (select s_suppkey as pk, a as pa, b as pb, taken as over from s{k} order by score desc, s_suppkey limit 1),
d{k + 1} as materialized (select s_suppkey, a, b, u, least(d, sqrt((a - pa) * (a - pa) + (b - pb) * (b - pb))) as d, taken or s_suppkey = pk as taken from d{k}, p{k})"""


def joint_step(k: int) -> str:
    """The k-th row of the greatest variance given those before, and the variances after it."""
    return f"""p{k} as materialized (select k as pk, a as pa, f as pf, v as pv, taken as over from j{k} order by taken, v desc, k limit 1),
j{k + 1} as materialized (select k, a, list_append(f, c) as f, greatest(v - c * c, 1e-12) as v, taken or k = pk as taken, pk from (select *, (list_dot_product(a, pa) - {"list_dot_product(f, pf)" if k else "0"}) / sqrt(pv) as c from (select k, a, f, v, taken from j{k}), p{k}))"""


SQL: dict[str, str] = {
    "greedy_selection": f"""with d0 as materialized (select s_suppkey, (s_acctbal - avg(s_acctbal) over ()) / stddev_samp(s_acctbal) over () as a, (s_nationkey - avg(s_nationkey) over ()) / stddev_samp(s_nationkey) over () as b,
        (abs(s_acctbal) - min(abs(s_acctbal)) over ()) / (max(abs(s_acctbal)) over () - min(abs(s_acctbal)) over ()) as u, 'inf'::double as d, false as taken from supplier),
      {", ".join(map(pick_step, range(10)))}
      {" union all ".join(f"select {k}::bigint as pick, pk as s_suppkey from p{k} where not over" for k in range(10))}""",
    "sliding_event_totals": """select strftime(time_bucket(interval 2 hour, ts::timestamp) - k * interval 2 hour, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::bigint as n, round(sum(value), 3) as total
      from events, range(3) t(k) group by 1, 2""",
    "session_events": """with e as (select user_id, ts::timestamp as ts, value, case when ts::timestamp < lag(ts::timestamp) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as fresh from events),
      s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from e)
      select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as "end", count(*)::bigint as n, round(sum(value), 3) as total from s group by user_id, s""",
    "cycle_edges": """with recursive e as (select 'n' || c_custkey as cause, 'n' || (c_custkey * 2 % (select max(c_custkey) + 1 from customer)) as effect from customer),
      r(a, b) as (select cause, effect from e union select r.a, e.effect from r join e on r.b = e.cause), c as (select a as n from r where a = b),
      fed as (select n from c union select b from r join c on a = n), feeding as (select n from c union select a from r join c on b = n)
      select cause, effect from e where cause in (select n from fed) and effect in (select n from feeding)""",
    "snapshot_merges": f"""with {TRANS} select cause, effect, count(*)::bigint as n_claims, string_agg(distinct source, ' | ' order by source) as sources, string_agg(distinct evidence, ' | ' order by evidence) as evidence,
      round(max(confidence), 6) as confidence, max("timestamp") as "timestamp" from tr where cause <> effect group by 1, 2""",
    "resampled_orders": """with c as (select o_custkey, row_number() over (order by o_custkey) - 1 as k from (select distinct o_custkey from orders)), n as (select count(*) as n from c),
      p as (select draw, floor(('0x' || substr(md5('7:' || draw || ':' || i), 1, 12))::bigint / 281474976710656.0 * n)::bigint as k from n, range(3) d(draw), range(n) t(i))
      select draw, o_custkey, count(*)::bigint as times from p join c using (k) group by 1, 2""",
    "bootstrap_slope": """with c as (select c_nationkey, row_number() over (order by c_nationkey) - 1 as k from (select distinct c_nationkey from customer)), n as (select count(*) as n from c),
      p as (select draw, floor(('0x' || substr(md5('1:' || draw || ':' || i), 1, 12))::bigint / 281474976710656.0 * n)::bigint as k from n, range(50) d(draw), range(n) t(i)),
      w as (select draw, c_nationkey, count(*) as w from p join c using (k) group by 1, 2),
      s as (select draw, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from w join (select c_nationkey, c_acctbal as y, (c_custkey % 13)::double as x from customer) using (c_nationkey) group by 1)
      select draw, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 5) as slope from s""",
    "price_quantiles": f"""select l_returnflag, count(*)::bigint as n, {", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) as q{i}" for i, p in enumerate((0.0, 0.05, 0.5, 0.999, 1.0)))} from lineitem group by 1""",
    "joint_picks": f"""with m as (select l_partkey % 60 as k, l_linenumber, avg(l_extendedprice / 1000) as m from lineitem where l_linenumber <= 4 group by 1, 2),
      g as (select k, list((m - mu) / sqrt(3) order by l_linenumber) as a from (select *, avg(m) over (partition by k) as mu, count(*) over (partition by k) as n from m) where n = 4 group by k),
      j0 as materialized (select k, a, []::double[] as f, list_dot_product(a, a) + 0.01 as v, false as taken from g),
      {", ".join(map(joint_step, range(6)))}
      {" union all ".join(f"select {k}::bigint as pick, pk as k from p{k} where not over" for k in range(6))}""",
    "claim_match_greedy": """with recursive l as (select doc_id % 20 as d, 'node_' || (doc_id % 7) as c, 'effect_' || quality as pe, 'effect_' || greatest(quality, toxic) as ge, row_number() over (partition by doc_id % 20 order by doc_id) as i from labels),
      k as (select distinct p.c, p.pe, g.c as gc, g.ge from (select distinct c, pe from l) p, (select distinct c, ge from l) g where levenshtein(p.c, g.c) + levenshtein(pe, ge) <= 2),
      w as (select p.d, p.i, list(g.i order by g.i) as wants from l p join k on p.c = k.c and p.pe = k.pe join l g on g.d = p.d and g.c = k.gc and g.ge = k.ge group by 1, 2),
      m(d, i, taken, hit) as (select d, 0::bigint, []::bigint[], null::bigint from l group by d union all
        select m.d, m.i + 1, case when h is null then taken else list_append(taken, h) end, h from (select m.d, m.i, taken, list_filter(coalesce(w.wants, []), lambda x: not list_contains(taken, x))[1] as h from m join l on l.d = m.d and l.i = m.i + 1 left join w on w.d = m.d and w.i = m.i + 1) m)
      select l.d as abstract_id, l.c as cause, pe as effect, case when hit is null then 'fp' else 'tp' end as outcome from l join m using (d, i)
      union all select d, c, ge, 'fn' from l where not exists (select 1 from m where m.d = l.d and m.hit = l.i)""",
    # the engine's distance lets a swapped pair be edited again, which no pair here needs
    "swapped_labels": f"""with l as (select distinct label from (select {LABEL.format("p_type")} as label from part)),
      s as (select substr(label, 1, 2) || substr(label, 4, 1) || substr(label, 3, 1) || substr(label, 5) as t, length(label) as n from l),
      t as (select distinct case when n > 20 then left(t, length(t) - 1) else t end as term from s)
      select label, term, damerau_levenshtein(label, term) as distance from l, t where damerau_levenshtein(label, term) <= 2""",
    "assimilated_cells": f"""with ens as (select l_orderkey % 12 as member, l_partkey % 4 as row, l_suppkey % 4 as col, avg(l_quantity) as value from lineitem group by all),
      a as (select *, value - avg(value) over (partition by row, col) as dev from ens),
      o1 as (select member, value as h, dev as d from a where row = 2 and col = 3), o2 as (select member, value as h, dev as d from a where row = 0 and col = 1),
      s as (select var_samp(o1.h) + 0.25 as s11, var_samp(o2.h) + 0.25 as s22, covar_samp(o1.h, o2.h) as s12 from o1 join o2 using (member)),
      k as (select row, col, sum(a.dev * o1.d) / 11 as c1, sum(a.dev * o2.d) / 11 as c2, sqrt((row - 2)**2 + (col - 3)**2) / 2.0 as z1, sqrt(row**2 + (col - 1)**2) / 2.0 as z2 from a join o1 using (member) join o2 using (member) group by row, col),
      g as (select row, col, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) * {TAPER.format("z1")} as g1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) * {TAPER.format("z2")} as g2 from k, s)
      select row, col, round(avg(value + (30 - o1.h) * g1 + (20 - o2.h) * g2), 4) as mean, round(any_value(sqrt(g1 * g1 + g2 * g2)), 4) as gain, round(stddev_samp(value + (30 - o1.h) * g1 + (20 - o2.h) * g2), 4) as sd
      from a join g using (row, col) join o1 using (member) join o2 using (member) group by row, col""",
    "aligned_bands": """with src as (select 'price' as band, 1.0::double as size, p_size - 1 as row, p_partkey % 40 as col, sqrt(avg(p_retailprice)) as v from part group by all
        union all select 'balance', 2.0::double, c_nationkey, c_custkey % 20, sqrt(avg(c_acctbal) + 1000) from customer group by all),
      t as (select r as row, c as col, 50.0 - (r + 0.5) * 0.8 as y, (c + 0.5) * 0.8 as x from range(63) a(r), range(50) b(c)),
      f as (select t.row, t.col, band, v, (50.0 - y) / size - 0.5 as fy, x / size - 0.5 as fx, s.row as sr, s.col as sc from t, src s where y > 0 and x < 40 and abs((50.0 - y) / size - 0.5 - s.row) < 1 and abs(x / size - 0.5 - s.col) < 1),
      w as (select row, col, band, v, (1 - abs(fy - sr)) * (1 - abs(fx - sc)) as w from f)
      select row, col, band, round(sum(w * v) / sum(w), 6) as value from w group by all""",
    "tile_steps": f"""with ens as (select l_returnflag as tile, l_orderkey % 12 as member, l_partkey % 3 as row, l_suppkey % 3 as col, avg(l_quantity) as value from lineitem group by all),
      ob as (select l_returnflag as tile, l_linenumber as n, l_linenumber - 1 as row, avg(l_quantity) as observed from lineitem where l_linenumber <= 2 group by all),
      {tile_step("one", "ens", 1)}, {tile_step("two", "one", 2)}
      select tile, '2024-01-0' || n as t, row, col, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd, 1::bigint as n_obs from (select 1 as n, * from one union all select 2, * from two) group by all""",
    "metrics_by_flag": f"""with {PRED} select l_returnflag, count(*)::bigint as n, round(sqrt(avg((y - f) * (y - f))), 4) as rmse, round(avg(abs(y - f)), 4) as mae,
      round(1 - avg((y - f) * (y - f)) / var_pop(y), 4) as r2, round(avg(y - f), 4) as bias, round(avg(case when y between 0.8 * f and 1.2 * f then 1.0 else 0.0 end), 4) as picp,
      round(avg(0.4 * f + 20 * greatest(0.8 * f - y, 0) + 20 * greatest(y - 1.2 * f, 0)), 4) as interval_score from p group by 1""",
    "ece_levels": """with q as (select p_brand, 0.1 as level, quantile_cont(p_retailprice, 0.1) as q from part group by 1
      union all select p_brand, 0.25, quantile_cont(p_retailprice, 0.25) from part group by 1 union all select p_brand, 0.5, quantile_cont(p_retailprice, 0.5) from part group by 1
      union all select p_brand, 0.75, quantile_cont(p_retailprice, 0.75) from part group by 1 union all select p_brand, 0.9, quantile_cont(p_retailprice, 0.9) from part group by 1)
      select level::double as level, round(avg(case when p_retailprice <= q then 1.0 else 0.0 end), 4) as share, round(abs(avg(case when p_retailprice <= q then 1.0 else 0.0 end) - level), 4) as gap from part join q using (p_brand) group by level""",
    "posterior_summary": f"""with {DRAWS} select query_id, count(*)::bigint as n_draws, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd,
      round(quantile_cont(value, 0.05), 4) as q05, round(quantile_cont(value, 0.5), 4) as q50, round(quantile_cont(value, 0.95), 4) as q95 from dr group by 1""",
    "crps_by_query": f"""with {DRAWS}, r as (select query_id, value, observed, row_number() over (partition by query_id order by value) as i, count(*) over (partition by query_id) as s from dr join tr using (query_id))
      select query_id, round(avg(abs(value - observed)) - sum((2 * i - s - 1) * value) / (any_value(s) * any_value(s)), 4) as crps from r group by 1""",
    "picp_mpiw": PICP.format(last="round(avg(hi - lo), 1) as mpiw"),
    "interval_reliability": PICP.format(last="round(avg(case when observed between lo and hi then 1.0 else 0.0 end) - level, 4) as gap"),
    "minmax_constant_rules": """with s as (select p_partkey, p_retailprice as v, min(p_retailprice) over w as lo, max(p_retailprice) over w as hi from part window w as (partition by p_size))
      select p_partkey, round(case when hi > lo then (v - lo) / (hi - lo) else 1.0 end, 6) as scaled_one, round(case when hi > lo then (v - lo) / (hi - lo) else 0.0 end, 6) as scaled_zero,
      round(case when hi > lo then (v - lo) / (hi - lo) else 0.5 end, 6) as scaled_middle from s""",
    "ols_slope_adjusted": """with m as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as naive, covar_pop(l_extendedprice, l_quantity) as yx, covar_pop(l_extendedprice, l_discount) as yw,
      covar_pop(l_quantity, l_discount) as xw, var_pop(l_quantity) as xx, var_pop(l_discount) as ww from lineitem group by 1)
      select l_returnflag, round(naive, 3) as naive, round((yx * ww - yw * xw) / (xx * ww - xw * xw), 3) as adjusted from m""",
    "ols_by_group": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 3) as r2 from lineitem group by 1",
    "iv_2sls": "select round(covar_pop(l_extendedprice, l_discount) / covar_pop(l_quantity, l_discount), 2) as effect, count(*)::bigint as n from lineitem",
    "iv_first_stage_f": "select round(corr(l_extendedprice, l_quantity) ** 2 / (1 - corr(l_extendedprice, l_quantity) ** 2) * (count(*) - 2), 1) as f, round(corr(l_extendedprice, l_quantity) ** 2, 4) as partial_r2 from lineitem",
    "iv_sargan": """with c as (select l_extendedprice - avg(l_extendedprice) over () as y, l_quantity - avg(l_quantity) over () as x, l_discount - avg(l_discount) over () as a, l_tax - avg(l_tax) over () as b from lineitem),
      m as (select count(*) as n, sum(a*a) as aa, sum(a*b) as ab, sum(b*b) as bb, sum(a*x) as ax, sum(b*x) as bx, sum(a*y) as ay, sum(b*y) as zy, sum(x*x) as xx, sum(x*y) as xy, sum(y*y) as yy from c),
      p as (select *, aa*bb - ab*ab as d from m),
      e as (select *, (ax*(bb*ay - ab*zy) + bx*(aa*zy - ab*ay)) / (ax*(bb*ax - ab*bx) + bx*(aa*bx - ab*ax)) as t from p),
      r as (select *, ay - t*ax as ea, zy - t*bx as eb, yy - 2*t*xy + t*t*xx as rss from e)
      select 1::bigint as sargan_df, round(n * (ea*(bb*ea - ab*eb) + eb*(aa*eb - ab*ea)) / d / rss, 4) as sargan from r""",
    "sensitivity_grid": """select l_discount as r2_outcome, l_tax as r2_exposure, n, round(b, 6) as bias, round(1.0 - b, 6) as adjusted from (
      select l_discount, l_tax, count(*)::bigint as n, 0.5 * sqrt(l_discount * l_tax / (1 - l_tax)) * sqrt(100.0::double) as b from lineitem group by 1, 2)""",
    "rolling_effect": """with dy as (select ts::date as day, value as y, (user_id % 17)::double as x from events), ix as (select day, row_number() over (order by day) - 1 as i from (select distinct day from dy)),
      st as (select unnest(range(0, greatest(0, (select count(*) from ix) - 12) + 1, 3)) as s)
      select s::bigint as start, min(case when i = s + 6 then day end) as centre, count(*)::bigint as n, round(case when count(*) >= 10 then regr_slope(y, x) end, 4) as slope from dy join ix using (day) join st on i between s and s + 11 group by s""",
    "mann_kendall": """with d as (select ts::date as day, round(avg(value), 6) as v from events group by 1), n as (select count(*)::bigint as n from d), s as (select sum(sign(b.v - a.v))::double as s from d a join d b on a.day < b.day)
      select n, s, round(s / (n * (n - 1) / 2), 4) as tau, round(n * (n - 1) * (2 * n + 5) / 18, 4) as var from n, s""",
    "leverage_topk": """with m as (select count(*) as n, avg(l_quantity) as mx, avg(l_discount) as mw, var_pop(l_quantity) as xx, var_pop(l_discount) as ww, covar_pop(l_quantity, l_discount) as xw from lineitem)
      select l_orderkey, l_linenumber::bigint as l_linenumber, round(1e4 * (1.0 / n + ((l_quantity - mx) ** 2 * ww - 2 * (l_quantity - mx) * (l_discount - mw) * xw + (l_discount - mw) ** 2 * xx) / (xx * ww - xw * xw) / n), 5) as leverage
      from lineitem, m order by 3 desc, 1, 2 limit 20""",
    "corpus_dedupe": "select min(doc_id) as doc_id from documents where text is not null group by lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) union all select doc_id from documents where text is null",
    "label_normalise": f"select p_partkey, {LABEL.format('p_name || chr(32) || chr(45) || chr(32) || p_brand || chr(32) || chr(45) || chr(32) || p_type')} as label from part",
    "edge_merge": f"""with {TRANS} select cause, effect, count(*)::bigint as n_claims, string_agg(distinct source, ' | ' order by source) as sources, string_agg(distinct evidence, ' | ' order by evidence) as evidence,
      round(max(confidence), 6) as confidence, max("timestamp") as "timestamp" from tr where cause <> effect group by 1, 2""",
    "edge_rank": f"with {TRANS} select cause, effect, count(distinct source)::bigint as n_sources, round(avg(confidence), 4) as mean_confidence, round(max(confidence), 4) as max_confidence from tr group by 1, 2",
    "edge_rename": f"""with {TRANS}, nm as (select * from (values ('click', 'act'), ('view', 'act'), ('purchase', 'buy')) t(label, target))
      select coalesce(a.target, cause) as cause, coalesce(b.target, effect) as effect, count(*)::bigint as n from tr left join nm a on a.label = cause left join nm b on b.label = effect
      where coalesce(a.target, cause) <> coalesce(b.target, effect) group by 1, 2""",
    "align_cascade": f"""with w as (select distinct {LABEL.format("p_type")} as label from part), v as (select * from {TERM_ROWS}), ex as (select label, term as target, 'exact' as method from w join v on label = term),
      su as (select label, term as target, 'substring' as method from w join v on contains('_' || label || '_', '_' || term || '_') or contains('_' || term || '_', '_' || label || '_') where label not in (select label from ex)
        qualify row_number() over (partition by label order by length(term) desc, term) = 1),
      ed as (select label, term as target, 'edit_distance' as method from w join v on levenshtein(label, term) <= 4 where label not in (select label from ex) and label not in (select label from su) qualify row_number() over (partition by label order by levenshtein(label, term), term) = 1)
      select * from ex union all select * from su union all select * from ed""",
    "align_edit_distance": f"""with w as (select distinct {LABEL.format("p_type")} as label from part), v as (select * from (values ('econmy'), ('stndard'), ('promo'), ('medum'), ('smal')) t(term))
      select label, term, levenshtein(label, term)::bigint as distance from w join v on levenshtein(label, term) <= 4 qualify row_number() over (partition by label order by levenshtein(label, term), term) = 1""",
    "vote_majority": f"with {VOTERS} n_voters >= 2",
    "vote_weighted": f"with {VOTERS} ws >= 1.75",
    "vote_intersection": f"with {VOTERS} n_voters = 3",
    "claim_match_exact": f"with {MATCH} select * from m where n > 0",
    "prf1": f"""with {MATCH}, c as (select coalesce(abstract_id, -1)::bigint as abstract_id, sum(case when outcome = 'tp' then n else 0 end)::bigint as tp, sum(case when outcome = 'fp' then n else 0 end)::bigint as fp, sum(case when outcome = 'fn' then n else 0 end)::bigint as fn
      from m group by rollup(abstract_id)) select *, round(tp / nullif(tp + fp, 0), 4) as precision, round(tp / nullif(tp + fn, 0), 4) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) as f1 from c""",
    "kappa": """with k as (select doc_id, (quality = 1)::int as quality, (toxic = 0)::int as clean, (doc_id % 2 = 0)::int as even from labels),
      ps as (select 'clean' as rater_a, 'even' as rater_b, clean as a, even as b from k union all select 'clean', 'quality', clean, quality from k union all select 'even', 'quality', even, quality from k),
      s as (select rater_a, rater_b, avg((a + b = 2)::int) as po, avg(a) as pa, avg(b) as pb from ps where a + b > 0 group by 1, 2)
      select rater_a, rater_b, round(case when abs(1 - (pa * pb + (1 - pa) * (1 - pb))) >= 1e-10 then (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end, 4) as kappa from s""",
    "token_cost": """select model, n, round(n * (700 * pi + 110 * po) / 1e6, 4) as cost from (select count(*)::bigint as n from documents), (values ('small', 0.15::double, 0.6::double), ('large', 3.0, 15.0), ('local', 0.0, 0.0)) t(model, pi, po)""",
    "json_claims": "select event_id, lower(event_type) as cause, 'x' || (user_id % 3) as effect, 0.5::double as confidence from events",
    "inverted_index_roundtrip": "select doc_id, md5(text) as text_md5 from documents where text is not null",
    "shd_edges": """with li as (select * from (select n_name as a, lag(n_name) over (partition by n_regionkey order by n_nationkey) as b, n_nationkey as k from nation) where b is not null),
      bb as (select case when k % 3 = 0 then b else a end as a, case when k % 3 = 0 then a else b end as b from li where k % 4 <> 1),
      p as (select least(a, b) as x, greatest(a, b) as y, list_sort(list_distinct(list(case when s = 1 then a || '>' || b end))) as l1, list_sort(list_distinct(list(case when s = 2 then a || '>' || b end))) as l2 from (select a, b, 1 as s from li union all select a, b, 2 from bb) group by 1, 2)
      select count(*) filter (len(l2) = 0)::bigint as only_a, count(*) filter (len(l1) = 0)::bigint as only_b, count(*) filter (len(l1) > 0 and len(l2) > 0 and l1 <> l2)::bigint as turned,
      count(*) filter (len(l2) = 0 or len(l1) = 0 or l1 <> l2)::bigint as distance from p""",
    "knn_graph": f"with {KNN} select src, dst, rank::bigint as rank from nn",
    "knn_weights": f"with {KNN} select src, dst, round(weight, 4) as weight from nw",
    "attention_softmax": f"""with {KNN}, sc as (select src, dst, ((src * 3 + dst * 5) % 11 - 5) / 2.0::double as s, weight from nw), lk as (select src, dst, (case when s > 0 then s else 0.2 * s end) * weight as e from sc)
      select src, dst, round(exp(e) / sum(exp(e)) over (partition by src), 4) as alpha from lk""",
    "min_distance_select": """with ch as (select embedding as c from embeddings where label = 0)
      select vec_id, round(min(list_distance(embedding::double[], c::double[])), 4) as distance from embeddings, ch group by 1 order by 2 desc, 1 limit 25""",
    "topk_priority": f"with {GRID} select row, col, round(gain * sd, 2) as score from gr order by gain * sd desc, col, row limit 25",
    "semi_join_candidates": f"with {GRID} select row, col, round(gain, 2) as score from gr where (row, col) in (select p_size, substr(p_brand, 7, 2)::bigint from part where p_retailprice % 10 < 1) order by gain desc, col, row limit 25",
    "lag_mass_balance": """with s as (select user_id, value as v, lag(value) over (partition by user_id order by ts, event_id) as b from events)
      select user_id, count(b)::bigint as n_steps, round(avg(((v - b) + 0.1 * (b - 5.0)) ** 2), 3) as loss from s group by 1""",
    "gap_fill_linear": """with ev as (select event_type, epoch(date_trunc('hour', ts))::bigint as t, value from events), h as (select event_type, t, avg(value) as v from ev group by 1, 2),
      cal as (select event_type, t from (select distinct event_type from ev), (select unnest(range(min(t), max(t) + 1, 3600)) as t from ev)), j as (select event_type, t, v from cal left join h using (event_type, t)),
      f as (select *, last_value(case when v is not null then t end ignore nulls) over a as ta, last_value(v ignore nulls) over a as va, first_value(case when v is not null then t end ignore nulls) over b as tb, first_value(v ignore nulls) over b as vb from j
        window a as (partition by event_type order by t rows between unbounded preceding and current row), b as (partition by event_type order by t rows between current row and unbounded following))
      select event_type, t, round(case when v is not null then v when ta is null then vb when tb is null then va else va + (vb - va) * (t - ta) / (tb - ta) end, 6) as filled from f""",
    "topsoil_first_row": "select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_discount <= 0.05 qualify row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) = 1",
    "fold_round_robin": f"with {FOLDS} select c_custkey, fold from fo",
    "cv_summary": f"with {FOLDS}, b as (select c_nationkey, fold, avg(c_acctbal) as score from fo group by 1, 2) select c_nationkey::bigint as c_nationkey, count(*)::bigint as n_folds, round(avg(score), 3) as score_mean, round(stddev_samp(score), 3) as score_sd from b group by 1",
    "rbf_gram": """with e as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), p as (select label, i, avg(v) as v from e group by 1, 2)
      select a.label::bigint as i, b.label::bigint as j, round(exp(-0.5 * sum((a.v - b.v) ** 2)), 5) as k from p a join p b on a.i = b.i and a.label < b.label group by 1, 2""",
    "kernel_1qubit": "select vec_id, round(cos(embedding[1]::double - embedding[2]::double) ** 2, 6) as k from embeddings",
    "cosine_schedule": "select p_partkey, p_size::bigint as t, round(greatest(1e-8, least(0.9999, cos((p_size / 50.0 + 0.008) / 1.008 * pi() / 2) ** 2 / cos(0.008 / 1.008 * pi() / 2) ** 2)), 6) as alphabar from part",
    "profile_closed_form": "select p_partkey, z::double as depth, round(100 + (p_retailprice - 100) * exp(-(0.05 * (1 - exp(-(p_size / 1000.0) * z)) / (p_size / 1000.0))), 3) as y from part, (values (0.0::double), (5), (15), (30), (60), (100)) t(z)",
    "taper_gaspari_cohn": f"""select c_custkey, round(d, 9) as distance, round({TAPER.format("z")}, 9) as taper from (select c_custkey, abs(c_acctbal) / 2000 as d, abs(c_acctbal) / 4000 as z from customer)""",
    "zscore_features": "select s_suppkey, round((s_acctbal - avg(s_acctbal) over ()) / stddev_samp(s_acctbal) over (), 5) as s_acctbal from supplier",
    "robustness_values": "select s_suppkey, round(0.5 * (sqrt(f * f + 4 * f) - f), 6) as rv from (select s_suppkey, (abs(s_acctbal / 1000) ** 2) / 100 as f from supplier)",
    "graph_stats": f"""with {TRANS}, t as (select * from tr where cause <> effect), n as (select count(*)::bigint as n_nodes from (select cause from t union select effect from t))
      select n_nodes, count(*)::bigint as n_edges, count(distinct source)::bigint as n_sources, round(quantile_cont(confidence, 0.0), 4) as confidence_0, round(quantile_cont(confidence, 0.25), 4) as confidence_25, round(quantile_cont(confidence, 0.5), 4) as confidence_50,
      round(quantile_cont(confidence, 0.75), 4) as confidence_75, round(quantile_cont(confidence, 1.0), 4) as confidence_100 from t, n group by n_nodes""",
    "window_event_counts": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*)::bigint as n, round(sum(value), 3) as total from events group by 1, 2",
    "resumable_ingest": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "record_hashes": "select doc_id, md5(doc_id || ' ' || substr(coalesce(text, ''), 1, 200)) as hash from documents",
    "dag_lines": f"with {TRANS} select distinct cause || ' -> ' || effect as line from tr where cause <> effect and confidence >= 0.99",
    "curie_names": """select p_partkey, case when regexp_matches(p_name, '^[A-Za-z]') then regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') else 'n_' || regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') end as curie,
      '"' || p_name || '"' as literal from part""",
    "median_scale": """with m as (select p_brand, median(p_retailprice) as m from part group by 1) select p_brand, round(m, 3) as median, round(greatest(1e-6, median(abs(p_retailprice - m))), 3) as deviation from part join m using (p_brand) group by p_brand, m""",
    "monthly_means": "select o_orderstatus, strftime(o_orderdate, '%Y-%m') as month, round(avg(o_totalprice), 7) as mean from orders group by 1, 2",
    "points_in_polygon": f"""with {PTS} select k as vec_id from pt where x between -1 and 1 and y between -1 and 1 and
      (case when (-1.0 > y) <> (1.0 > y) and x < 1.0 then 1 else 0 end + case when (1.0 > y) <> (0.1 > y) and x < (0.0 - 1.0) * (y - 1.0) / (0.1::double - 1.0) + 1.0 then 1 else 0 end
      + case when (0.1::double > y) <> (1.0 > y) and x < (-1.0 - 0.0) * (y - 0.1::double) / (1.0 - 0.1::double) + 0.0 then 1 else 0 end + case when (1.0 > y) <> (-1.0 > y) and x < -1.0 then 1 else 0 end) % 2 = 1""",
    "quality_range": "select event_id from events where event_id % 5 <> 0 and value between 10 and 50",
    "top_values": "select p_type, count(*)::bigint as n from part group by 1 order by 2 desc, 1 limit 5",
    "physics_gate": """select p_partkey from part where p_retailprice between 900 + p_size * 2.0::double - 0.25 * greatest(abs((950 + p_size * 4.0::double) - (900 + p_size * 2.0::double)), 1e-9)
      and 950 + p_size * 4.0::double + 0.25 * greatest(abs((950 + p_size * 4.0::double) - (900 + p_size * 2.0::double)), 1e-9)""",
    "annotation_checks": "select doc_id::varchar as abstract_id, (case when toxic = 0 then 0 else 1 end + case when quality = 1 then 0 else 1 end + case when doc_id % 4 / 2.0 between 0 and 1 then 0 else 1 end)::bigint as n_errors from labels",
    "turtle_lines": f"""with {TRANS}, m as (select cause, effect, string_agg(distinct source, ' | ' order by source) as s, string_agg(distinct evidence, ' | ' order by evidence) as e, max(confidence) as c from tr where cause <> effect group by 1, 2),
      v as (select 'edge:' || cause || '__' || effect || ' a rdf:Statement ; rdf:subject node:' || cause || ' ; rdf:predicate edge:causes ; rdf:object node:' || effect || ' ; edge:confidence "' || printf('%.6f', c)
        || '"^^xsd:float ; edge:source "' || replace(s, ' | ', '", "') || '" ; edge:evidence "' || e || '" .' as line from m union all
        select * from (values ('@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .'), ('@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .'), ('@prefix node: <http://example.org/kg#node/> .'), ('@prefix edge: <http://example.org/kg#edge/> .')))
      select md5(line) as line_md5 from v""",
    "covering_design": """with q as (select quantile_disc(c_acctbal, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as a, quantile_disc(c_nationkey, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as n from customer)
      select 8::bigint as n_rows, count(distinct len(list_filter(a, lambda x: x < c_acctbal)))::bigint as balance_ranges, count(distinct len(list_filter(n, lambda x: x < c_nationkey)))::bigint as nation_ranges from customer, q""",
    "profile_fits": "select s_suppkey, 20.0::double + s_suppkey % 7 as y0, 3.0::double as y_inf, round(0.03 + 0.01 * (s_suppkey % 3), 3)::double as rate, 0.01::double as decay from supplier",
    "effect_sensitivity": """with m as (select count(*) as n, covar_pop(l_extendedprice, l_discount) as yd, covar_pop(l_extendedprice, l_quantity) as yq, covar_pop(l_discount, l_quantity) as dq, var_pop(l_discount) as dd, var_pop(l_quantity) as qq, var_pop(l_extendedprice) as yy from lineitem where l_returnflag = 'A'),
      b as (select *, (yd * qq - yq * dq) / (dd * qq - dq * dq) as bd, (yq * dd - yd * dq) / (dd * qq - dq * dq) as bq from m),
      t as (select n, bd / sqrt((yy - bd * yd - bq * yq) * n / (n - 3) * qq / (dd * qq - dq * dq) / n) as t from b)
      select round(t, 4) as t, round(0.5 * (sqrt((t * t / (n - 3)) ** 2 + 4 * t * t / (n - 3)) - t * t / (n - 3)), 4) as rv from t""",
    "edge_origins": f"""with {TRANS}, t as (select cause, effect, max(confidence) as c from tr where cause <> effect group by 1, 2) select cause, effect, case when c >= 0.994 then 'base' else 'graph' end as origin from t""",
    "covariance_pairs": """select a, b, round(c * 1e4, 4) as covariance, n from (select 'l_quantity' as a, 'l_quantity' as b, var_pop(l_quantity) as c, count(*)::bigint as n from lineitem union all
      select 'l_quantity', 'l_discount', covar_pop(l_quantity, l_discount), count(*) from lineitem union all select 'l_quantity', 'l_tax', covar_pop(l_quantity, l_tax), count(*) from lineitem union all
      select 'l_discount', 'l_discount', var_pop(l_discount), count(*) from lineitem union all select 'l_discount', 'l_tax', covar_pop(l_discount, l_tax), count(*) from lineitem union all
      select 'l_tax', 'l_tax', var_pop(l_tax), count(*) from lineitem)""",
    "sample_priority": """with c as (select event_id % 6 as s, (user_id % 7)::bigint as row, (user_id // 7 % 5)::bigint as col, round(avg(value), 6) as v from events group by 1, 2, 3)
      select row, col, round(stddev_samp(v), 4) as score from c group by 1, 2 order by stddev_samp(v) desc nulls last, row, col limit 10""",
    "unit_table": "select p_partkey, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ())::double, 6) as p_size, round((p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 6) as p_retailprice from part",
    "posterior_parts": f"""with {DRAWS} select query_id, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as epistemic_sd, 100.0::double as aleatoric_sd, round(sqrt(stddev_samp(value) ** 2 + 10000), 4) as total_sd from dr group by 1""",
    "posterior_overview": f"""with {DRAWS}, s as (select avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.95) as q95 from dr group by query_id),
      u as (select 'mean' as name, mean as v from s union all select 'sd', sd from s union all select 'q05', q05 from s union all select 'q50', q50 from s union all select 'q95', q95 from s)
      select name, round(min(v), 4) as least, round(median(v), 4) as median, round(max(v), 4) as most from u group by 1""",
    "posterior_rmse": f"with {DRAWS}, m as (select query_id, avg(value) as m from dr group by 1) select round(sqrt(avg((m - observed) * (m - observed))), 4) as point_rmse from m join tr using (query_id)",
    "numbered_orders": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey)::bigint as position from orders",
    "side_by_side": "select n_nationkey::bigint as n_nationkey, name from (select n_nationkey, row_number() over (order by n_nationkey) as i from nation) join (select n_name as name, row_number() over (order by n_name) as i from nation) using (i)",
    "annotated_lines": """select md5(printf('edge:stmt_%06d', row_number() over (order by doc_id)) || ' a rdf:Statement ; rdf:subject node:rain ; rdf:predicate edge:causes ; rdf:object node:soil_' || (doc_id % 3)
      || ' ; edge:polarity "' || case when quality = 1 then '+' else '-' end || '" ; edge:confidence "' || printf('%.3f', doc_id % 4 / 4.0) || '"^^xsd:float .') as line_md5 from labels""",
    "terrain_slopes": f"""with {GRID}, s as (select row, col, gain as g, case when lag(col) over a = col - 1 then lag(gain) over a end as w, case when lead(col) over a = col + 1 then lead(gain) over a end as e,
      case when lag(row) over b = row - 1 then lag(gain) over b end as n, case when lead(row) over b = row + 1 then lead(gain) over b end as o from gr window a as (partition by row order by col), b as (partition by col order by row))
      select row, col, round(degrees(atan(sqrt(coalesce((e - w) / 20, (e - g) / 10, (g - w) / 10, 0.0) ** 2 + coalesce((o - n) / 20, (o - g) / 10, (g - n) / 10, 0.0) ** 2))), 4) as slope from s""",
    "prototype_kernel": f"""with {PTS}, p as (select label::bigint as l, avg(embedding[1]::double) as x, avg(embedding[2]::double) as y from embeddings group by 1),
      e as (select l, case when max(x) over () > min(x) over () then pi() * (x - min(x) over ()) / (max(x) over () - min(x) over ()) else pi() / 2 end as a, case when max(y) over () > min(y) over () then pi() * (y - min(y) over ()) / (max(y) over () - min(y) over ()) else pi() / 2 end as b from p),
      f as (select l, s::int as s, 2 * a * ((s & 1) - 0.5::double) + 2 * b * ((s >> 1) - 0.5::double) + 2 * (pi() - a) * (pi() - b) * (xor(s & 1, s >> 1) - 0.5::double) as t from e, range(4) r(s)),
      h as (select f.l, f.s, f.t, sum((case when bit_count(f.s & g.s) % 2 = 1 then -1 else 1 end) * cos(g.t)) / 4 as re, sum((case when bit_count(f.s & g.s) % 2 = 1 then -1 else 1 end) * sin(g.t)) / 4 as im from f join f g on f.l = g.l group by 1, 2, 3),
      z as (select l, s, cos(t) * re - sin(t) * im as re, sin(t) * re + cos(t) * im as im from h)
      select a.l as i, b.l as j, round(sum(a.re * b.re + a.im * b.im) ** 2 + sum(a.re * b.im - a.im * b.re) ** 2, 5) as k from z a join z b on a.s = b.s and a.l > b.l group by 1, 2""",
    "dag_adjustment": """with m as (select covar_pop(l_extendedprice, l_quantity) as yx, covar_pop(l_extendedprice, l_discount) as yw, covar_pop(l_quantity, l_discount) as xw, var_pop(l_quantity) as xx, var_pop(l_discount) as ww from lineitem)
      select 'l_discount' as adjusted_for, round((yx * ww - yw * xw) / (xx * ww - xw * xw), 2) as effect from m""",
}
