"""Shared parts of the oracle SQL: the driver's tables seen as results, scores and suggestions."""

RESULTS = """res as (
  select *, case when status in ('UNK', 'ERR') then null else price end as objective from (
    select o_orderpriority as problem, case o_orderpriority when '1-URGENT' then 'SAT' when '2-HIGH' then 'MAX' else 'MIN' end as category,
      cast(o_orderkey as varchar) as instance, 's' || l_suppkey as solver, l_extendedprice as price, l_linenumber as place,
      case l_returnflag || l_linestatus when 'NO' then 'S' when 'RF' then 'SC' when 'RO' then 'UNK' when 'AF' then 'ERR' when 'AO' then 'C' when 'NF' then 'S' end as status
    from lineitem join orders on l_orderkey = o_orderkey))"""


def scored(name: str = "sco", mode: str = "code", where: str = "true") -> str:
    up = "(best - objective)" if mode == "code" else "(objective - worst)"
    more = "" if mode == "code" else "when derived = 'SAT' and best = worst then 0.75::double when derived in ('C', 'UNSAT') then 1::double"
    return f"""{name}_v as (select *, case when status in ('S', 'SC') then objective end as solved from res where {where}),
{name}_b as (select *, case when category = 'MIN' then min(solved) over w else max(solved) over w end as best,
  case when category = 'MIN' then max(solved) over w else min(solved) over w end as worst from {name}_v window w as (partition by problem, instance)),
{name}_d as (select *, case when status in ('UNK', 'ERR') then 'UNK' when status in ('S', 'SC') and category = 'SAT' then 'OPT'
  when status = 'SC' and ((category = 'MIN' and objective <= best) or (category = 'MAX' and objective >= best)) then 'OPT'
  when status in ('S', 'SC') then 'SAT' else status end as derived from {name}_b),
{name} as (select *, case when derived = 'UNK' then 0::double when derived = 'OPT' then 1::double
  when derived = 'SAT' and category = 'MIN' and best <> worst then 0.25::double + 0.5::double * (objective - worst) / (best - worst)
  when derived = 'SAT' and category = 'MAX' and best <> worst then 0.25::double + 0.5::double * {up} / (best - worst) {more} end as score from {name}_d)"""


SUGGESTIONS = """ranked as (select l_orderkey, 's' || l_suppkey as s, row_number() over (partition by l_orderkey order by l_quantity desc, l_suppkey) as rn from lineitem),
lists as (select l_orderkey, list(s order by rn) as found from ranked where rn <= 3 group by 1),
sug as (select r_name as provider, c_mktsegment as model, 'v' || (o_orderkey % 4) as variant, (o_orderkey % 5) / 10.0::double as temperature,
  o_orderpriority as problem, cast(o_orderkey as varchar) as instance,
  case when o_orderkey % 97 = 0 then null else coalesce(found, []::varchar[]) end as top3
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join lists on o_orderkey = l_orderkey)"""


def top3(name: str = "t3", scores: str = "sco", where: str = "true") -> str:
    return f"""{name}_e as (select provider, model, problem, instance, coalesce(x, 'nan') as solver from (select * from sug where top3 is not null) s left join lateral (select unnest(top3) as x) u on true),
{name}_d as (select e.provider, e.model, e.problem, e.instance, max(coalesce(c.score, 0)) as best_score
  from (select * from {name}_e where {where}) e left join {scores} c on e.problem = c.problem and e.instance = c.instance and e.solver = c.solver group by all),
{name} as (select provider, model, sum(best_score) as total, count(distinct instance) as covered from {name}_d group by 1, 2)"""


def top1(name: str = "t1", scores: str = "sco", where: str = "true") -> str:
    return f"""{name}_d as (select f.*, c.score from (select provider, model, variant, temperature, problem, instance, top3[1] as solver from sug where top3[1] is not null) f
  left join {scores} c on f.problem = c.problem and f.instance = c.instance and f.solver = c.solver where {where}),
{name} as (select provider, model, coalesce(sum(score), 0) as total, avg(score) as average, count(distinct instance) as covered from {name}_d group by 1, 2)"""


def query(*parts: str) -> str:
    return "with " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


BASE = (RESULTS, scored())
BOTH = (RESULTS, scored(), SUGGESTIONS)
TOTALS = """tot as (select solver, coalesce(sum(score), 0) as total, count(*) filter (score = 1) as optimal from sco group by 1),
sbs as (select solver, total as sbs from tot order by round(total, 6) desc, solver limit 1),
vbs as (select sum(s) as vbs from (select max(score) as s from sco group by problem, instance))"""
GAP = """gap as (select provider, model, a.total, covered, sbs, vbs, (a.total - sbs) / nullif(vbs - sbs, 0) as gap
  from (select provider, model, coalesce(sum(score), 0) as total, count(distinct (problem, instance)) as covered from t1_d group by 1, 2) a, sbs, vbs)"""
