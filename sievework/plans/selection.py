"""Queries of the scoring and selection core (results and suggestions made from orders and line items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.text import evaluation, percent
from sievework.operators import selection as sel
from sievework.operators.adapters import results, suggestions
from sievework.operators.scoring import best_and_worst, restrict, score
from sievework.plans.sql import BASE, BOTH, GAP, RESULTS, SUGGESTIONS, TOTALS, query, scored, top1, top3
from sievework.rounds import Rounds

QUERIES, ORACLES = {}, {}
#: A portfolio: the suppliers 1 to 40.
PORTFOLIO = [f"s{k}" for k in range(1, 41)]
IN_PORTFOLIO = "solver in (" + ", ".join(f"'{s}'" for s in PORTFOLIO) + ")"


def query_of(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def _sco(spark, d, mode="code"):
    return score(results(spark, d), mode)


def _kept(spark, d):
    """The scores alone, written once: for measures that read them several times."""
    return Rounds(spark).kept(_sco(spark, d).select("problem", "instance", "solver", "score"))


SCORE_SQL = "select problem, instance, solver, status, derived, count(*) as n, round(sum(score), 6) as total, round(max(best), 2) as best, round(max(worst), 2) as worst from sco group by 1, 2, 3, 4, 5"


def _score_rows(df):
    return df.groupBy("problem", "instance", "solver", "status", "derived").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("best"), 2).alias("best"), F.round(F.max("worst"), 2).alias("worst"))


@query_of(query(*BASE, SCORE_SQL))
def score_results(spark, d):
    return _score_rows(_sco(spark, d))


@query_of(query(RESULTS, scored(mode="paper"), SCORE_SQL))
def score_results_paper(spark, d):
    return _score_rows(_sco(spark, d, "paper"))


@query_of(query(RESULTS, scored(where=IN_PORTFOLIO), SCORE_SQL))
def score_subset(spark, d):
    return _score_rows(score(restrict(results(spark, d), PORTFOLIO)))


@query_of(query(*BASE, "select problem, instance, max(best) as best, max(worst) as worst from sco group by 1, 2"))
def best_worst(spark, d):
    return best_and_worst(results(spark, d)).groupBy("problem", "instance").agg(F.max("best").alias("best"), F.max("worst").alias("worst"))


TOP3_SQL = "select provider, model, round(total, 6) as total, covered, round(total / covered, 6) as average from t3"
TOP1_SQL = "select provider, model, round(total, 6) as total, round(average, 6) as average, covered from t1"


def _top3_rows(df):
    return df.select("provider", "model", r6("total"), "covered", r6("average"))


def _top1_rows(df):
    return df.select("provider", "model", r6("total"), r6("average"), "covered")


@query_of(query(*BOTH, top3(), TOP3_SQL))
def llm_top3_summary(spark, d):
    return _top3_rows(sel.top3_summary(suggestions(spark, d), _sco(spark, d)))


@query_of(query(*BOTH, top1(), TOP1_SQL))
def llm_top1_summary(spark, d):
    return _top1_rows(sel.top1_summary(sel.top1(suggestions(spark, d), _sco(spark, d))))


@query_of(query(RESULTS, scored(where=IN_PORTFOLIO), SUGGESTIONS, top3(where=IN_PORTFOLIO), TOP3_SQL))
def llm_top3_subset(spark, d):
    return _top3_rows(sel.top3_summary(suggestions(spark, d), score(restrict(results(spark, d), PORTFOLIO)), PORTFOLIO))


@query_of(query(RESULTS, scored(where=IN_PORTFOLIO), SUGGESTIONS, top1(where="f." + IN_PORTFOLIO), TOP1_SQL))
def llm_top1_subset(spark, d):
    return _top1_rows(sel.top1_summary(sel.top1(suggestions(spark, d), score(restrict(results(spark, d), PORTFOLIO)), PORTFOLIO)))


@query_of(query(*BASE, TOTALS, "select round(vbs, 6) as vbs from vbs"))
def vbs_total(spark, d):
    return sel.virtual_best(_sco(spark, d)).select(r6("vbs"))


@query_of(query(*BASE, TOTALS, "select solver, round(sbs, 6) as sbs from sbs"))
def sbs_auto(spark, d):
    return sel.single_best(_sco(spark, d)).select("solver", r6("sbs"))


@query_of(query(*BASE, TOTALS, "select solver, round(total, 6) as sbs from tot where solver = 's7'"))
def sbs_fixed(spark, d):
    return sel.single_best(_sco(spark, d), "s7").select("solver", r6("sbs"))


@query_of(query(*BOTH, TOTALS, top1(), GAP, "select provider, model, round(total, 6) as total, covered, round(gap, 6) as gap from gap"))
def closed_gap(spark, d):
    s = _kept(spark, d)
    return sel.closed_gap(sel.top1(suggestions(spark, d), s), s).select("provider", "model", r6("total"), "covered", r6("gap"))


@query_of(query(*BOTH, top1(), "select provider, model, round((60.303673::double - total) / (60.303673::double - 83.75::double), 6) as gap from t1"))
def closed_gap_literal(spark, d):
    t = sel.top1_summary(sel.top1(suggestions(spark, d), _sco(spark, d)))
    return t.select("provider", "model", r6((F.lit(60.303673) - F.col("total")) / (60.303673 - 83.75), "gap"))


@query_of(query(*BASE, TOTALS, "select solver, round(total, 6) as total, optimal from tot"))
def single_solver_scores(spark, d):
    return sel.solver_totals(_sco(spark, d)).select("solver", r6("total"), "optimal")


@query_of(query(*BOTH, TOTALS, top3(), top1(), GAP, "select provider, model, round(coalesce(t3.total, 0), 6) as parallel_score, round(coalesce(t1.total, 0), 6) as single_score, round(gap, 6) as closed_gap from t3 full join t1 using (provider, model) full join (select provider, model, gap from gap) using (provider, model)"))
def performance_table(spark, d):
    """Suggestions and scores are made once each, though several measures read them."""
    s, llm = _kept(spark, d), suggestions(spark, d)
    first = Rounds(spark).kept(sel.top1(llm, s))
    out = sel.performance_table(sel.top3_summary(llm, s), sel.top1_summary(first), sel.closed_gap(first, s))
    return out.select("provider", "model", r6("parallel_score"), r6("single_score"), r6("closed_gap"))


BY_VARIANT = "select provider, model, variant, coalesce(sum(score), 0) as total, avg(score) as average, count(distinct instance) as covered from t1_d group by 1, 2, 3"


def _by_variant(spark, d):
    first = sel.top1(suggestions(spark, d), _sco(spark, d), keep=["variant"])
    return sel.top1_summary(first, ["provider", "model", "variant"])


@query_of(query(*BOTH, top1(), f"bv as ({BY_VARIANT})", "select provider, model, variant, round(total, 6) as total, round(average, 6) as average, covered, model || ' (' || variant || ')' as model_variant from bv"))
def variant_union(spark, d):
    out = sel.variant_names(_by_variant(spark, d), "variant")
    return out.select("provider", "model", "variant", r6("total"), r6("average"), "covered", "model_variant")


@query_of(query(*BASE, TOTALS, "nw as (select solver, total + 1 as total, optimal from tot where optimal < 3)", "select solver, round(total, 6) as total, optimal from nw union all select solver, round(total, 6), optimal from tot where solver not in (select solver from nw)"))
def variant_upsert(spark, d):
    old = sel.solver_totals(_sco(spark, d))
    return sel.upsert(old, old.filter("optimal < 3").withColumn("total", F.col("total") + 1), "solver").select("solver", r6("total"), "optimal")


DIFFICULTY = "dif as (select problem, instance, sum(coalesce(score, 0)) as total, count(distinct model) as models, count(solver) as predictions from t1_d group by 1, 2)"


def _difficulty(spark, d):
    return sel.top1(suggestions(spark, d), _sco(spark, d)).groupBy("problem", "instance").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"), F.count_distinct("model").alias("models"), F.count("solver").alias("predictions"))


@query_of(query(*BOTH, top1(), DIFFICULTY, "select problem, instance, round(total, 6) as total, models, predictions from dif"))
def instance_difficulty(spark, d):
    return _difficulty(spark, d).withColumn("total", F.round("total", 6))


@query_of(query(*BOTH, top1(), DIFFICULTY, "select problem, category, round(sum(total), 6) as total, count(distinct instance) as instances from dif left join (select distinct problem, category from res) using (problem) group by 1, 2"))
def problem_rollup(spark, d):
    dim = results(spark, d).select("problem", "category").distinct()
    return _difficulty(spark, d).join(dim, "problem", "left").groupBy("problem", "category").agg(F.round(F.sum("total"), 6).alias("total"), F.count_distinct("instance").alias("instances"))


APPEAR = """app as (select variant, model, solver, count(*) as appearances from (select variant, model, top3[1] as solver from sug where top3[1] is not null) group by 1, 2, 3),
den as (select variant, model, count(distinct instance) as covered from sug group by 1, 2),
pct as (select *, cast(round_even(100.0::double * appearances / covered, 2) as varchar) || '%' as share from app join den using (variant, model))"""


def _appearances(spark, d):
    llm = suggestions(spark, d)
    first = llm.select("variant", "model", F.get("top3", F.lit(0)).alias("solver")).filter("solver is not null")
    app = first.groupBy("variant", "model", "solver").agg(F.count("*").alias("appearances"))
    den = llm.groupBy("variant", "model").agg(F.count_distinct("instance").alias("covered"))
    return app.join(den, ["variant", "model"], "left").withColumn("share", percent(F.col("appearances"), F.col("covered")))


@query_of(query(SUGGESTIONS, APPEAR, "select variant, model, solver, appearances, covered, share from pct"))
def solver_appearances(spark, d):
    return _appearances(spark, d).select("variant", "model", "solver", "appearances", "covered", "share")


@query_of(query(*BOTH, TOTALS, APPEAR, "select variant, model, appearances, covered, share from pct where solver in (select solver from sbs)"))
def sbs_appearances(spark, d):
    best = sel.single_best(_sco(spark, d)).select("solver")
    return _appearances(spark, d).join(F.broadcast(best), "solver", "left_semi").select("variant", "model", "appearances", "covered", "share")


@query_of(query(SUGGESTIONS, APPEAR, "select variant, model, solver, share from pct order by share desc, variant, model, solver limit 20"))
def appearances_by_text(spark, d):
    """The percentages are text and sort as text."""
    return _appearances(spark, d).orderBy(F.desc("share"), "variant", "model", "solver").limit(20).select("variant", "model", "solver", "share")


@query_of(query(*BOTH, top1(), "select distinct problem, instance from res where (problem, instance) not in (select (problem, instance) from t1_d where model = 'BUILDING')"))
def missing_instances(spark, d):
    """Instances that one model has no suggestion for."""
    has = sel.top1(suggestions(spark, d), _sco(spark, d)).filter("model = 'BUILDING'").select("problem", "instance")
    return results(spark, d).select("problem", "instance").distinct().join(has, ["problem", "instance"], "left_anti")


@query_of(query(*BOTH, top1(), "select provider, model, count(distinct instance) as instances, count(*) as n from t1_d where score is null group by 1, 2"))
def missing_summary(spark, d):
    lost = sel.top1(suggestions(spark, d), _sco(spark, d)).filter("score is null")
    return lost.groupBy("provider", "model").agg(F.count_distinct("instance").alias("instances"), F.count("*").alias("n"))


@query_of(query(*BOTH, top1(), "l as (select distinct problem, instance from t1_d where score is null)", f"h as (select problem, instance, list_sort(list(distinct solver)).array_to_string(',') as s from res where {IN_PORTFOLIO} group by 1, 2)", "select l.problem, l.instance, coalesce(s, '') as solvers from l left join h on l.problem = h.problem and l.instance = h.instance"))
def candidate_solvers(spark, d):
    """The portfolio's solvers with a result for each instance that a first choice has no score for; many have none."""
    lost = sel.top1(suggestions(spark, d), _sco(spark, d)).filter("score is null").select("problem", "instance").distinct()
    return sel.candidates(lost, restrict(results(spark, d), PORTFOLIO)).select("problem", "instance", F.array_join("solvers", ",").alias("solvers"))


@query_of(query(RESULTS, SUGGESTIONS, "(select distinct problem, instance from sug) except (select distinct problem, instance from res)"))
def uncovered_pairs(spark, d):
    return suggestions(spark, d).select("problem", "instance").subtract(results(spark, d).select("problem", "instance"))


PORT = f"last as (select problem, instance, solver, max(coalesce(score, 0)) as score from sco where {IN_PORTFOLIO} group by 1, 2, 3)"


@query_of(query(*BASE, PORT, "b as (select problem, instance, max(score) as s from last group by 1, 2), i as (select distinct problem, instance from res)", "select i.problem, round(sum(coalesce(s, 0)), 6) as portfolio_best, count(*) as instances from i left join b on i.problem = b.problem and i.instance = b.instance group by 1"))
def portfolio_scores(spark, d):
    s = _sco(spark, d)
    best = sel.largest_score(restrict(s, PORTFOLIO)).groupBy("problem", "instance").agg(F.max("score").alias("s"))
    every = s.select("problem", "instance").distinct()
    return every.join(best, ["problem", "instance"], "left").groupBy("problem").agg(F.round(F.sum(F.coalesce("s", F.lit(0.0))), 6).alias("portfolio_best"), F.count("*").alias("instances"))


@query_of(query(*BASE, PORT, "select problem, solver, round(coalesce(sum(score), 0), 6) as total from last group by 1, 2"))
def portfolio_breakdown(spark, d):
    return sel.largest_score(restrict(_sco(spark, d), PORTFOLIO)).groupBy("problem", "solver").agg(F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("total"))


@query_of(query(*BASE, PORT, "select round(sum(score), 6) as total, count(*) as n from last"))
def portfolio_grand_total(spark, d):
    return sel.largest_score(restrict(_sco(spark, d), PORTFOLIO)).agg(F.round(F.sum("score"), 6).alias("total"), F.count("*").alias("n"))


TEMPS = "tv as (select variant, temperature, model, coalesce(sum(score), 0) as total, avg(score) as average from t1_d group by 1, 2, 3)"


def _by_temperature(spark, d):
    first = sel.top1(suggestions(spark, d), _sco(spark, d), keep=["variant", "temperature"])
    return first.groupBy("variant", "temperature", "model").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.avg("score").alias("average"))


@query_of(query(*BOTH, top1(), TEMPS, "select variant, temperature, model, round(total, 6) as total from (select *, row_number() over (partition by variant, temperature order by round(total, 6) desc, model) as rn from tv) where rn = 1"))
def best_per_variant_temp(spark, d):
    t = _by_temperature(spark, d).withColumn("total", F.round("total", 6))
    return sel.first_of(t, ["variant", "temperature"], F.desc_nulls_last("total"), "model").select("variant", "temperature", "model", "total")


@query_of(query(*BOTH, top1(), TEMPS, "select variant, " + ", ".join(f"round(avg(total) filter (temperature = {t}), 6) as t{i}" for i, t in enumerate((0.0, 0.1, 0.2, 0.3, 0.4))) + " from tv group by 1"))
def variant_temp_pivot(spark, d):
    wide = _by_temperature(spark, d).withColumn("c", F.concat(F.lit("t"), F.round(F.col("temperature") * 10).cast("int"))).groupBy("variant").pivot("c", ["t0", "t1", "t2", "t3", "t4"]).agg(F.avg("total"))
    return wide.select("variant", *(r6(f"t{i}") for i in range(5)))


@query_of(query(*BOTH, top1(), TEMPS, "a as (select variant, max(total) as best from tv group by 1), b as (select variant, max(average) as best_average from tv where temperature > 0 group by 1)", "select variant, round(best, 6) as best, round(best_average, 6) as best_average from a full join b using (variant)"))
def summary_merge(spark, d):
    t = _by_temperature(spark, d)
    return t.groupBy("variant").agg(F.max("total").alias("best")).join(t.filter("temperature > 0").groupBy("variant").agg(F.max("average").alias("best_average")), "variant", "full").select("variant", r6("best"), r6("best_average"))


@query_of(query(*BASE, TOTALS, "r as (select min(total) as lo, max(total) as hi from tot)", "select least(30, cast(floor((total - lo) / (hi - lo) * 30) as bigint) + 1) as bin, count(*) as n from tot, r group by 1"))
def total_histogram(spark, d):
    """How many solvers have a total in each of 30 bins that span the totals there are."""
    return sel.histogram(sel.solver_totals(_sco(spark, d)), "total")


@query_of(query(*BASE, "r as (select min(score) as lo, max(score) as hi from sco)", "select least(30, cast(floor((score - lo) / (hi - lo) * 30) as bigint) + 1) as bin, count(*) as n from sco, r where score is not null group by 1"))
def score_histogram(spark, d):
    return sel.histogram(_sco(spark, d), "score")


@query_of(query(*BOTH, top1(), DIFFICULTY, "select problem, instance, round(total, 6) as total from dif order by round(total, 6), problem, instance limit 10"))
def worst_instances_topk(spark, d):
    t = _difficulty(spark, d).withColumn("total", F.round("total", 6))
    return t.orderBy("total", "problem", "instance").limit(10).select("problem", "instance", "total")


@query_of(query(*BOTH, top3(), top1(), "a as (select provider, model, total from t3), b as (select provider, model, average from t1 where covered >= 100)", "select coalesce(a.provider, b.provider) as provider, a.model, round(total, 6) as total, round(average, 6) as average from a join b on a.provider = b.provider and a.model = b.model order by round(total, 6) desc, provider, a.model limit 5"))
def top_models(spark, d):
    s, llm = _sco(spark, d), suggestions(spark, d)
    t1 = sel.top1_summary(sel.top1(llm, s)).filter("covered >= 100").select("provider", "model", "average")
    out = sel.top3_summary(llm, s).select("provider", "model", "total").join(t1, ["provider", "model"]).select("provider", "model", r6("total"), r6("average"))
    return out.orderBy(F.desc("total"), "provider", "model").limit(5)


TRUE = "tru as (select problem, instance, list(solver order by rn) as truth from (select *, row_number() over (partition by problem, instance order by round(score, 6) desc, solver) as rn from (select problem, instance, solver, max(score) as score from sco where score is not null group by 1, 2, 3)) where rn <= 3 group by 1, 2)"


@query_of(query(*BOTH, TRUE, "e as (select provider, model, list_sum(list_transform(generate_series(1, greatest(len(top3), len(truth))), lambda i: case when top3[i] = truth[i] then 1 else 0 end))::bigint as places, len(list_intersect(top3, truth))::bigint as anywhere, len(truth) as t, len(top3) as a from sug join tru using (problem, instance) where top3 is not null and len(top3) > 0)", "select provider, model, case when places = t and a = t then 'exact' when anywhere = t then 'permuted' when anywhere > 0 then 'partial' else 'none' end as verdict, count(*) as n, sum(places)::bigint as places, sum(anywhere)::bigint as anywhere from e group by 1, 2, 3"))
def answer_evaluation(spark, d):
    best = _sco(spark, d).filter("score is not null").groupBy("problem", "instance", "solver").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(sel.Window.partitionBy("problem", "instance").orderBy(F.desc(F.round("score", 6)), "solver"))).filter("r <= 3")
    truth = best.groupBy("problem", "instance").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "solver"))), lambda x: x.solver).alias("truth"))
    e = suggestions(spark, d).filter("top3 is not null and size(top3) > 0").join(truth, ["problem", "instance"])
    e = e.select("provider", "model", *(c.alias(n) for n, c in evaluation(F.col("top3"), F.col("truth")).items()))
    return e.groupBy("provider", "model", "verdict").agg(F.count("*").alias("n"), F.sum("places").alias("places"), F.sum("anywhere").alias("anywhere"))


@query_of(query(*BOTH, "last as (select problem, instance, solver, list(score order by place, coalesce(score, -1))[-1] as score from sco group by 1, 2, 3)", "x as (select provider, model, problem, instance, unnest(top3) as solver, generate_subscripts(top3, 1) as pos from sug where top3 is not null)", "select provider, model, x.problem, x.instance, string_agg(cast(cast(round(coalesce(score, 0), 3) * 1000 as bigint) as varchar), ',' order by pos) as scores, round(max(coalesce(score, 0)), 6) as best from x left join last on x.problem = last.problem and x.instance = last.instance and x.solver = last.solver group by 1, 2, 3, 4"))
def array_score_lookup(spark, d):
    x = suggestions(spark, d).filter("top3 is not null").select("provider", "model", "problem", "instance", F.posexplode("top3").alias("pos", "solver"))
    x = x.join(sel.last_score(_sco(spark, d)), ["problem", "instance", "solver"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    text = F.transform(F.sort_array(F.collect_list(F.struct("pos", "score"))), lambda v: (F.round(v.score, 3) * 1000).cast("long").cast("string"))
    return x.groupBy("provider", "model", "problem", "instance").agg(F.array_join(text, ",").alias("scores"), F.round(F.max("score"), 6).alias("best"))


@query_of(query(RESULTS, "select problem, category, count(distinct instance) as instances, count(distinct solver) as solvers, count(*) filter (objective is null) as no_objective from res where solver like '%1' group by 1, 2"))
def result_profile(spark, d):
    """Suffix filter, distinct counts and conditional counts."""
    r = results(spark, d).filter(F.col("solver").endswith("1"))
    return r.groupBy("problem", "category").agg(F.count_distinct("instance").alias("instances"), F.count_distinct("solver").alias("solvers"), F.count_if(F.col("objective").isNull()).alias("no_objective"))
