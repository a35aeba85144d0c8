"""Queries of tables: measures merged, results in HTML, entries merged, categories counted, constraints by type, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import arrays, flatzinc, taxonomy
from sievework.operators import selection as sel
from sievework.operators.adapters import results, suggestions, table
from sievework.operators.scoring import score
from sievework.plans.models import _files, _nested
from sievework.plans.sql import BOTH, RESULTS, query, top1, top3
from sievework.rounds import Rounds
from sievework.sources import documents, files, sinks

QUERIES, ORACLES = {}, {}


def query_of(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query_of(query(*BOTH, top3(), top1(), "v as (select model || ' (' || variant || ')' as model, coalesce(sum(score), 0) as total from t1_d group by model, variant)", """select 'models' as kind, a.model || ' (' || a.provider || ')' as model, round(coalesce(b.total, -1), 6) as single_score, round(a.total, 6) as parallel_score, null::double as closed_gap from t3 a left join (select * from t1 where provider <> 'ASIA') b on a.provider = b.provider and a.model = b.model
union all select 'variants', model, round(total, 6), null, round(total / 100, 6) from v"""))
def metric_tables(spark, d):
    """Tables of measures: by model with older names, the provider and scores filled; by variant with a measure missing."""
    s, llm = score(results(spark, d)), suggestions(spark, d)
    three = sel.top3_summary(llm, s).withColumnRenamed("total", "TotalScore")
    first = sel.top1(llm, s, keep=["variant"])
    one = sel.top1_summary(first).filter("provider <> 'ASIA'").withColumnRenamed("total", "LLM_Top1_TotalScore")
    models = sel.metric_table(one, three, provider=True, fill=-1)
    by = first.withColumn("model_variant", F.concat("model", F.lit(" ("), "variant", F.lit(")"))).groupBy("model_variant").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("SingleScore"))
    variants = sel.metric_table(by, gap=by.withColumn("ClosedGap", F.col("SingleScore") / 100), sort_by="Closed Gap")
    out = models.withColumn("kind", F.lit("models")).unionByName(variants.withColumn("kind", F.lit("variants")))
    return out.select("kind", "model", *(F.round(c, 6).alias(c) for c in ("single_score", "parallel_score", "closed_gap")))


@query_of("select p_brand, max(case when p_size % 3 = 0 then p_size::double when p_size % 3 = 1 then p_retailprice end) as value from part where p_brand = (select min(p_brand) from part) group by 1")
def metric_maximum(spark, d):
    """The largest number of a column of texts, some of which are none."""
    p = table(spark, d, "part")
    brand = p.agg(F.min("p_brand").alias("p_brand"))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.col("p_retailprice").cast("string")).otherwise("n/a")
    mine = p.join(F.broadcast(brand), "p_brand").select(text.alias("x"))
    return brand.join(F.broadcast(sel.metric_max(mine, "x"))).select("p_brand", "value")


@query_of("with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) as rn, l_suppkey, l_quantity from lineitem) select '/o/' || l_orderkey as url, rn::bigint as row, 'p' || l_orderkey as problem, 'i' || (rn - 1) // 2 as instance, 's' || l_suppkey as solver, l_quantity as objective from l")
def html_results(spark, d):
    """Results of each order as an HTML table, blank cells for what is as above, read back."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))).alias("l"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = lambda x, i: F.concat(F.lit("<tr>"), cell(F.when(i == 0, F.concat(F.lit(" p"), F.col("l_orderkey"))).otherwise(" ")), cell(F.when(i % 2 == 0, F.concat(F.lit("i"), (i / 2).cast("int"))).otherwise("")), cell(F.concat(F.lit("<b>s"), x.l_suppkey, F.lit("</b>"))), cell(F.lit("&#83;&lt;C")), cell(F.lit("1")), cell(x.l_quantity.cast("string")), *[cell(F.lit("0"))] * 3, F.lit("</tr>"))
    body = F.array_join(F.transform("l", row), "\n")
    html = F.concat(F.lit("<table><thead><tr><td>head</td></tr></thead><tbody><tr><td>short</td></tr>"), body, F.lit("<tr><td>TOTAL</td>"), F.repeat(F.lit("<td>9</td>"), 8), F.lit("</tr></tbody></table>"))
    found = files.result_tables(lines.select(F.concat(F.lit("/o/"), "l_orderkey").alias("url"), html.alias("html"))).filter("status = 'S<C'")
    return found.select("url", "row", "problem", "instance", "solver", F.col("objective").try_cast("double").alias("objective"))


@query_of("with a as (select p_partkey::varchar as key, p_name as a from part where p_size % 3 <> 0), b as (select p_partkey::varchar as key, p_brand as b from part where p_size % 2 = 0) select key, coalesce(a, b) as kept, coalesce(b, a) as overwritten from a full join b using (key)")
def entries_merged(spark, d):
    """Entries of two maps, by whose value stays where both have a key."""
    p = table(spark, d, "part")
    key = F.col("p_partkey").cast("string").alias("key")
    old, new = p.filter("p_size % 3 <> 0").select(key, F.col("p_name").alias("value")), p.filter("p_size % 2 = 0").select(key, F.col("p_brand").alias("value"))
    kept, over = (sinks.merge(old, new, overwrite=o).withColumnRenamed("value", n) for o, n in ((False, "kept"), (True, "overwritten")))
    return kept.join(over, "key")


@query_of("select user_id, event_type, arg_max(event_id, event_id) as event_id from events group by 1, 2")
def entries_latest(spark, d):
    """The last entry of each key."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.concat_ws("|", "user_id", "event_type").alias("key"))
    return sinks.upsert_latest(e, "key", "event_id").select("user_id", "event_type", "event_id")


@query_of(query(RESULTS, "a as (select problem, instance, solver, case when problem like '3%' then '' else category end as category from res where solver like '%1'), b as (select problem, instance, solver, 'LATE' as category from res where solver like '%2')", "f as (select problem, coalesce(min(nullif(category, '')), 'LATE') as category, min(category) as x from a group by 1)", "select problem, coalesce(f.category, 'LATE') as category, count(*) as n, count(distinct solver) as solvers from (select problem, solver from a union all select problem, solver from b) left join f using (problem) group by 1, 2"))
def results_union(spark, d):
    """Results of two documents in one: a problem's category is the first document's, unless that is blank."""
    r = results(spark, d).select("problem", "category", "instance", "solver")
    first = r.filter(F.col("solver").endswith("1")).withColumn("category", F.when(F.col("problem").startswith("3"), " ").otherwise(F.col("category")))
    out = documents.merged(first, r.filter(F.col("solver").endswith("2")).withColumn("category", F.lit("LATE")))
    return out.groupBy("problem", "category").agg(F.count("*").alias("n"), F.count_distinct("solver").alias("solvers"))


@query_of("with n as (select distinct p_name as name from part), c as (select distinct p_brand as category, p_name as member from part where p_size % 3 > 0), x as (select distinct name, coalesce(category, 'Uncategorized') as category from n left join c on name = member), y as (select name, count(*) as n from x group by 1) select category, count(*) as names, count(*) filter (n > 1) as several from x join y using (name) group by 1")
def category_counts(spark, d):
    """Names by category, those with several categories, and those with none."""
    p = table(spark, d, "part")
    found = taxonomy.categorized(p.select(F.col("p_name").alias("name")), p.filter("p_size % 3 > 0").select(F.col("p_brand").alias("category"), F.col("p_name").alias("member")))
    return taxonomy.category_report(found)


@query_of("""with l as (select l_orderkey as k, count(*) filter (cast(l_quantity as int) > 1) as n, min(cast(l_quantity as int)) > 1 as x0 from lineitem group by 1),
c as (select k, 'int_lin_eq' as type, n + 1 as arity from l union all select k, 'fzn_all_different_int', n from l union all select k + 1000000000, 'int_lin_eq', n + 1 from l union all select k + 1000000000, 'int_lin_eq', 2 + x0::int from l union all select k + 1000000000, 'int_max', 2 + x0::int from l union all select k + 1000000000, 'int_plus', 2 + x0::int from l),
t as (select k, type, count(*) as constraints, avg(arity) as arity from c group by 1, 2),
h as (select k, case type when 'int_max' then 'Uncategorized' when 'fzn_all_different_int' then 'global' else 'arithmetic' end as category, count(*) as types, sum(constraints) as constraints, sum(constraints * arity) / sum(constraints) as arity from t group by 1, 2)
select category, count(*) as models, sum(types)::bigint as types, sum(constraints)::bigint as constraints, round(sum(arity), 4) as arity from h group by 1""")
def fzn_constraint_types(spark, d):
    """Types of constraints by their category in each model, with the mean number of variables, added up over the models."""
    both = _files(spark, d).union(_nested(spark, d).withColumn("file", F.concat(F.lit("nested "), "file")))
    rounds = Rounds(spark)
    counts = rounds.kept_by(flatzinc.type_counts(flatzinc.kept_tables(both, rounds)), "file")
    categories = spark.createDataFrame([("arithmetic", "int_lin_eq"), ("arithmetic", "int_plus"), ("global", "fzn_all_different_int"), ("zz", "int_lin_eq")], "category string, member string")
    h = flatzinc.type_headers(counts, categories)
    return h.groupBy("category").agg(F.count("*").alias("models"), F.sum("types").alias("types"), F.sum("constraints").alias("constraints"), F.round(F.sum("arity"), 4).alias("arity"))


@query_of("select p_brand, md5(rpad('P_PARTKEY', 24, ' ') || ' ' || 'P_SIZE' || ' P_NAME\\n' || repeat('=', 58) || '\\n' || string_agg(rpad(p_partkey::varchar, 24, ' ') || ' ' || rpad(p_size::varchar, 4, ' ') || ' ' || p_name, '\\n' order by p_partkey)) as text from part group by 1")
def aligned_report(spark, d):
    """A report in columns of fixed width for each brand."""
    rows = arrays.aligned(table(spark, d, "part"), "p_brand", "p_partkey", ["p_partkey", "p_size"], [24, 4], "p_name")
    return rows.select("p_brand", F.md5("text").alias("text"))


@query_of(query(*BOTH, top1(), "select provider, model, printf('%.2f', total) as total, printf('%.3f', average) as average, printf('%.0f', covered::double) as covered from t1"))
def styled_summary(spark, d):
    """A summary with its numbers as text."""
    t = sel.top1_summary(sel.top1(suggestions(spark, d), score(results(spark, d))))
    return sinks.styled(t, others={"total": 2, "covered": 0}).select("provider", "model", "total", "average", "covered")


@query_of("with l as (select l_orderkey, count(*) as n from lineitem group by 1), x as (select unnest([4, 3, 2, 1]) as degree, unnest([1, 1, 2, n - 1]) as c from l) select degree::bigint as degree, sum(c)::bigint as variables from x where c > 0 group by 1")
def fzn_degrees(spark, d):
    """How many variables of the nested models are named so often in constraints."""
    rounds = Rounds(spark)
    t = flatzinc.kept_tables(_nested(spark, d), rounds)
    return rounds.kept_by(flatzinc.degree_table(t), "file").groupBy("degree").agg(F.count("*").alias("variables"))


@query_of("select l_orderkey::varchar as file, 'xs' as name, count(*) as elements, 1::bigint as low, max(cast(l_quantity as int))::bigint as high from lineitem group by 1")
def fzn_array_spans(spark, d):
    """What the domains of each model's array of variables span."""
    rounds = Rounds(spark)
    return rounds.kept_by(flatzinc.array_spans(flatzinc.kept_tables(_files(spark, d), rounds)), "file")


@query_of("select o_orderpriority as model, o_orderstatus as status, 'Top' as variant, 0.2::double as temperature, count(*) as n from orders where o_orderkey % 3 > 0 and o_orderkey % 5 > 0 group by 1, 2")
def labelled_rows(spark, d):
    """Rows without nulls in the columns that count, with a run's variant and temperature."""
    o = table(spark, d, "orders")
    blank = lambda c, k: F.when(F.col("o_orderkey") % k > 0, F.col(c))
    rows = o.select(blank("o_orderpriority", 3).alias("model"), blank("o_orderstatus", 5).alias("status"), F.lit(None).cast("string").alias("other"))
    out = sel.with_metadata(sel.complete(rows, ["model", "status", "missing"]), variant="Top", temperature=0.2)
    return out.groupBy("model", "status", "variant", "temperature").agg(F.count("*").alias("n"))
