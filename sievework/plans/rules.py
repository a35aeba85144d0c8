"""Queries of rules that carry state or data of their own: retries, names, traversal, dialects, annotations, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import arrays, attempts, prompts, taxonomy, templates
from sievework.operators.adapters import table
from sievework.plans.text import MESSAGES, POLICY
from sievework.sources import docs, files

QUERIES, ORACLES = {}, {}


def query_of(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query_of("select event_id, case when event_id % 4 = 3 or event_id % 13 = 1 then null when event_id % 7 = 5 then 60 * (1 + event_id % 3) + 3 when event_id % 300 = 0 then null else floor((event_id % 3) * 3600 + (event_id % 60) * 60 + (event_id % 50) + 0.25)::bigint end as seconds from events")
def retry_seconds(spark, d):
    """Durations in error texts: of several parts, with a unit twice, after another word, and of nothing."""
    k = F.col("event_id")
    message = F.when(k % 4 == 3, "Quota reached in 5m").when(k % 13 == 1, "please TRY AGAIN IN 0s").when(k % 7 == 5, F.concat(F.lit("Busy for 2h. Try again after 1m "), k % 3, F.lit("m 3.5s, please")))
    message = message.when(k % 300 == 0, "try again in 0h0m0s").otherwise(F.concat(F.lit("Limit. Please try again in "), k % 3, F.lit("h"), k % 60, F.lit("m"), k % 50, F.lit(".25s. More")))
    return table(spark, d, "events").select("event_id", tx.seconds(message).alias("seconds"))


@query_of(f"""with recursive m as (select user_id, lower(case when event_id % 5 > 2 then {MESSAGES} end) as m, case when event_id % 5 > 2 then {MESSAGES} end as text, row_number() over (partition by user_id order by event_id) as rn from events),
p as (select *, case when m is null then null else ({POLICY}) end as policy from m),
f as (select user_id, 0::bigint as rn, 'open' as state, 0 as attempts, 0 as retries, 0::bigint as waited, null::varchar as error from (select distinct user_id from events) union all
  select f.user_id, p.rn, case when p.policy is null then 'done' when p.policy = 'other' then 'failed' when (p.policy = 'unavailable' or contains(p.text, '413')) and f.retries + 1 > 3 then 'given up' else 'open' end, f.attempts + 1,
    f.retries + (case when coalesce(p.policy, 'other') <> 'other' then 1 else 0 end), f.waited + (case when p.policy is null or p.policy = 'other' or ((p.policy = 'unavailable' or contains(p.text, '413')) and f.retries + 1 > 3) then 0 when p.policy in ('rate', 'too_large') then 60 else 30 end),
    case when p.policy = 'other' then 'Non-retryable: ' || p.text when (p.policy = 'unavailable' or contains(p.text, '413')) and f.retries + 1 > 3 then (case when p.policy = 'unavailable' then '503' else '413 too large' end) || ' after 3 retries: ' || p.text end
  from f join p on p.user_id = f.user_id and p.rn = f.rn + 1 where f.state = 'open')
select user_id, arg_max(state, rn) as state, max(attempts) as attempts, max(retries) as retries, max(waited) as waited, max(error) as error from f group by 1""")
def retry_outcomes(spark, d):
    """What becomes of each task after its attempts: three of five are answered, the others fail in one way or another."""
    tried = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 > 2, F.expr(MESSAGES)).alias("error"))
    return attempts.outcomes(tried, "user_id", "event_id")


GROUPS = """{g} as (select definition, names, rn, wish, list_transform(list_sort(list_transform(names, lambda x: row(length(x), x))), lambda x: x[2]) as others from (
  select *, row_number() over (order by len(names), definition) as rn from (select trim(definition) as definition, list_sort(list(distinct name)) as names, case when count(distinct name) = 1 then min(name) else regexp_extract(min(name), '{wish}', 1) end as wish from n group by 1)))"""
WALK = """{w}(rn, used, unified) as (select 0::bigint, []::varchar[], null::varchar union all select rn, list_append(used, pick), pick from (
  select g.rn, w.used, list_filter(list_concat([g.wish], g.others, list_transform(generate_series(2, len(w.used) + 2), lambda i: g.wish || '__' || i)), lambda x: not list_contains(w.used, x))[1] as pick from {w} w join {g} g on g.rn = w.rn + 1))"""


@query_of(f"""with recursive n as (select distinct 'int_' || lower(p_type) || '_k' || p_partkey % 2 as name, ' ' || p_type || case when p_size % 10 > 0 then '-' || p_size % 10 else '' end as definition from part union select 'int_' || lower(p_type), p_type || '!' from part where p_size % 3 = 0),
{GROUPS.format(g="g", wish="(.*)_k.$")}, {GROUPS.format(g="h", wish="int_(.*)_k.$")}, {WALK.format(w="w", g="g")}, {WALK.format(w="v", g="h")}
select g.definition, array_to_string(g.names, ',') as names, w.unified, v.unified as untyped from g join w using (rn) join v using (rn)""")
def unify_names(spark, d):
    """A name for each definition, many of which want the same and share all their names; with and without types in front."""
    p = table(spark, d, "part")
    kind = F.lower("p_type")
    names = p.select(F.concat(F.lit("int_"), kind, F.lit("_k"), F.col("p_partkey") % 2).alias("name"), F.concat(F.lit(" "), "p_type", F.when(F.col("p_size") % 10 > 0, F.concat(F.lit("-"), F.col("p_size") % 10)).otherwise("")).alias("definition"))
    names = names.union(p.filter("p_size % 3 = 0").select(F.concat(F.lit("int_"), kind), F.concat("p_type", F.lit("!")))).distinct()
    bare = taxonomy.unified(names, drop_types=True).select("definition", F.col("unified").alias("untyped"))
    return taxonomy.unified(names).join(bare, "definition").select("definition", F.array_join("names", ",").alias("names"), "unified", "untyped")


@query_of("""with recursive site as (select '/' || regexp_extract(html, '<title>([^ <]*)', 1) as url, arg_min(html, page_id) as html from pages group by 1),
l as (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 as place from site),
e as (select url, regexp_replace(link, '#.*$', '') as link, min(place) as place from l group by all),
b(level, seen, front) as (select 0, [min(url)], [row(min(url), []::bigint[])] from site union all
  select level + 1, list_concat(seen, list(url)), list(row(url, path)) from (select level, seen, e.link as url, min(list_append(f[2], e.place)) as path from (select level, seen, unnest(front) as f from b) x join e on e.url = f[1] where not list_contains(seen, e.link) group by all) group by level, seen),
r as (select level, unnest(front) as f from b)
select f[1] as url, level, array_to_string(f[2], '.') as path from r""")
def page_traversal(spark, d):
    """The pages, addressed by the first word of their titles, that links lead to from the first address, in the order of a walk."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("/"), F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("url"), "page_id", "html")
    site = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    links = docs.read(site).select("url", F.explode("links").alias("l")).select("url", "l.place", "l.link")
    start = site.agg(F.min("url")).first()[0]
    return docs.traversed(links, start).select("url", "level", F.array_join("path", ".").alias("path"))


CSV = """select p_brand as file, p_partkey, p_name as name, case when p_partkey % 4 = 0 then 'a' || sep || 'b "q" ' || p_size when p_partkey % 4 = 1 then '' else 'n' || p_size end as note, p_size * 1.5 as price from (select *, [',', ';', chr(9), '|'][ascii(right(p_brand, 1)) % 4 + 1] as sep from part)"""


@query_of(f"with c as ({CSV}) select file, (p_partkey::varchar) as id, 4::int as n, md5(name || '~' || note || '~' || (price::double)::varchar) as cells from c")
def csv_dialects(spark, d):
    """Lines of files that are each written with a delimiter of its own, cells with delimiters and quotes among them, read back."""
    part = table(spark, d, "part").withColumn("sep", F.element_at(F.array(*map(F.lit, files.DELIMITERS)), F.ascii(F.right("p_brand", F.lit(1))) % 4 + 1))
    note = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("a"), "sep", F.lit('b "q" '), "p_size")).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.concat(F.lit("n"), "p_size"))
    parts = F.array(F.col("p_partkey").cast("string"), "p_name", note, (F.col("p_size") * F.lit(1.5)).cast("string"))
    found = files.csv_cells(part.select(F.col("p_brand").alias("file"), files.joined(parts, F.col("sep")).alias("value")))
    c = lambda k: F.get("cells", F.lit(k))
    return found.select("file", c(0).alias("id"), F.size("cells").alias("n"), F.md5(F.concat_ws("~", c(1), c(2), c(3))).alias("cells"))


@query_of("select p_partkey, 'var int: x' || p_partkey || case p_partkey % 4 when 3 then '(y)' else '' end || ' = f((' || p_size || '));' || chr(10) || 'solve satisfy;' as text from part")
def annotation_free(spark, d):
    """Declarations without their annotations, whose brackets are nested up to 20 deep and hold marks of annotations themselves."""
    k, deep = F.col("p_partkey"), (F.col("p_partkey") % 20 + 1).cast("int")
    inside = F.concat(F.repeat(F.lit("("), deep), F.lit("a, b :: c"), F.repeat(F.lit(")"), deep))
    note = F.when(k % 4 == 0, F.concat(F.lit(" :: "), inside)).when(k % 4 == 1, F.concat(F.lit("  :: seq.search:x "), inside, F.lit(" :: output_var"))).when(k % 4 == 2, " ::defines").otherwise("(y) :: is_defined_var")
    text = F.concat(F.lit("var int: x"), k, note, F.lit(" = f(("), "p_size", F.lit("));\nsolve :: int_search(x, (y), z) satisfy;"))
    return arrays.without_annotations(table(spark, d, "part").select(k.alias("file"), text.alias("text"))).select(F.col("file").alias("p_partkey"), "text")


@query_of("""select p_partkey, case when p_partkey % 2 = 0 then p_name || '|x [y]' else p_name || '|;' end as names from part""")
def solver_lists(spark, d):
    """Names of lists that are written as text, with brackets around and inside, quotes and blank parts."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ['"), F.col("p_name"), F.lit("', \"x [y]\", ''] "))).otherwise(F.concat(F.col("p_name"), F.lit(" ,;,")))
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.listed_names(text), "|").alias("names"))


@query_of("select p_partkey, 'bool: b[' || p_size || '] <= x = (' || regexp_replace(p_name, '\\s+', ' ', 'g') || '),y - z' as text from part")
def tightened_text(spark, d):
    """Descriptions brought into one line, with the blanks around brackets, commas and operators set right."""
    text = F.concat(F.lit(" bool: b [  "), F.col("p_size"), F.lit(" ]  <=\n x   =  (\t"), F.col("p_name"), F.lit("  )\n ,y - z "))
    return table(spark, d, "part").select("p_partkey", tx.tightened(text).alias("text"))


SOLVERS = ["gecode", "chuffed", "cp-sat"]
ASKING = "'The goal is to determine which constraint programming solver would be best suited for this problem, considering the following options:' || chr(10) || chr(10) || '- gecode' || chr(10) || '- chuffed' || chr(10) || '- cp-sat' || chr(10) || chr(10)"
TASKS = f"""t as (select p_partkey, p_brand as model, case when p_partkey % 2 = 0 then 'About ' || p_name else '' end as description, repeat(p_name || ' ', (p_size % 9 * 10)::int) as script, case when p_partkey % 3 = 0 then repeat('1, ', p_size::int) else '' end as data,
  case when p_partkey % 7 = 0 then '' else repeat(p_name || '. ', (p_size % 20)::int) end as summary, case when p_partkey % 5 < 2 then 'Solvers and descriptions:' || chr(10) || '- gecode: G' || chr(10) || '- chuffed: ' || chr(10) || '- cp-sat: C' || chr(10) else '' end as solver_text,
  {ASKING} || case when p_partkey % 11 = 0 then 'Answer with the name of the 3 best solvers inside square brackets separated by comma, followed by a short explanation of the main factors behind your choice.' else 'Answer only with the name of the 3 best solvers inside square brackets separated by comma and nothing else.' end as question, 90 + p_size * 6 as allowed from part),
u as (select *, case when description <> '' then 'Problem description:' || chr(10) || description || chr(10) || chr(10) else '' end as d, case when data <> '' then 'MiniZinc data:' || chr(10) || data || chr(10) || chr(10) else '' end as i, case when solver_text <> '' then solver_text || chr(10) else '' end as s from t),
m as (select *, greatest(0, allowed - length(chr(10) || chr(10) || d || i || s || question) // 4) as room, case when script = '' then 0 else greatest(1, length(script) // 4) end as n from u),
m2 as (select *, room <= 0 or n > room as was_cut, case when room <= 0 then '% [Model script removed due to token limits]' || chr(10) when n <= room then script else rtrim(script[1:greatest(20, room * 4)]) || chr(10) || '% [TRUNCATED: script shortened to fit model context]' || chr(10) end as safe from m),
m3 as (select p_partkey, model, 'model' as mode, was_cut, d || chr(10) || chr(10) || 'MiniZinc model:' || chr(10) || safe || chr(10) || chr(10) || i || s || case when was_cut then '% [Model script truncated to fit model context window]' || chr(10) else '' end || question as prompt from m2),
y as (select *, d || 'Given this description of a MiniZinc problem:' || chr(10) as head, s || question as tail, trim(summary) as z from u where trim(summary) <> ''),
y2 as (select *, length(head || z || chr(10) || chr(10) || tail) // 4 > allowed as long, greatest(0, allowed - length(tail) // 4 - length(head) // 4) as room, greatest(1, length(z) // 4) as n from y),
y3 as (select p_partkey, model, 'summary' as mode, long and (room <= 0 or n > room) as was_cut, head || case when not long or (room > 0 and n <= room) then z when room <= 0 then '[Removed due to token limits]' || chr(10) else rtrim(z[1:greatest(20, room * 4)]) || chr(10) || '[TRUNCATED: fzn summary shortened to fit model context]' || chr(10) end || chr(10) || chr(10) || tail as prompt from y2),
every as (select * from m3 union all select * from y3)"""


def _tasks(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    solvers = F.array(*map(F.lit, SOLVERS))
    known = F.create_map(F.lit("gecode"), F.lit("G"), F.lit("cp-sat"), F.lit("C"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.col("p_brand").alias("model"),
        F.when(k % 2 == 0, F.concat(F.lit("About "), "p_name")).alias("description"),
        F.repeat(F.concat("p_name", F.lit(" ")), size % 9 * 10).alias("script"),
        F.when(k % 3 == 0, F.repeat(F.lit("1, "), size)).alias("data"),
        F.when(k % 7 != 0, F.repeat(F.concat("p_name", F.lit(". ")), size % 20)).alias("summary"),
        F.when(k % 5 < 2, templates.described(solvers, known)).alias("solver_text"),
        F.when(k % 11 == 0, templates.question(solvers, reasoned=True)).otherwise(templates.question(solvers)).alias("question"),
        (90 + size * 6).cast("long").alias("allowed"),
    )


@query_of(f"with {TASKS} select p_partkey, mode, was_cut, md5(prompt) as prompt from every")
def prompt_modes(spark, d):
    """Both kinds of prompts, with and without each part, within budgets that cut some of them."""
    tasks, parts = _tasks(spark, d), templates.segments(spark)
    made = [templates.composed(tasks, parts, mode).select("p_partkey", F.lit(mode).alias("mode"), "was_cut", F.md5("prompt").alias("prompt")) for mode in ("model", "summary")]
    return made[0].union(made[1])


@query_of(f"with {TASKS} select model, count(*) as tasks, count(prompt) as prompts, count(*) - count(prompt) as skipped, count(*) filter (was_cut) as cut, coalesce(sum(length(prompt) // 4), 0)::bigint as tokens from t left join (select p_partkey, was_cut, prompt from every where mode = 'summary') using (p_partkey) group by 1")
def prompt_dry_run(spark, d):
    """What a run would send each model, without sending it."""
    return templates.dry_run(_tasks(spark, d), templates.segments(spark), "summary", ["model"])


@query_of("with l as (select user_id, event_type || ': [' || string_agg('e' || event_id, ', ' order by event_id) || ']' as line, event_type, count(*) as n from events group by 1, 3) select user_id, event_type as name, n, case when n % 3 = 0 then 'since ' || n || ' were there: [so]' when n % 3 = 1 and event_type <> (select max(event_type) from events) then 'next line' end as reasoning from l")
def response_reasons(spark, d):
    """Named lists of answers with the reasons behind them: in the line, in the line below, or none."""
    e = table(spark, d, "events")
    lines = e.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list("event_id")).alias("l"))
    n, last = F.size("l"), e.agg(F.max("event_type").alias("last"))
    line = F.concat("event_type", F.lit(": ["), F.array_join(F.transform("l", lambda x: F.concat(F.lit("e"), x)), ", "), F.lit("]"))
    tail = F.when(n % 3 == 0, F.concat(F.lit(" since "), n, F.lit(" were there: [so] "))).when((n % 3 == 1) & (F.col("event_type") != F.col("last")), "  \n  next line").otherwise("\n--")
    lines = lines.join(F.broadcast(last)).select("user_id", F.concat(line, tail).alias("response"))
    found = prompts.responses(lines, reasoned=True)
    return found.select("user_id", "name", F.size("picks").cast("long").alias("n"), F.nullif("reasoning", F.lit("--")).alias("reasoning"))
