"""Queries of the prompt, text and taxonomy operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import prompts, taxonomy
from sievework.operators.adapters import table
from sievework.sources import documents, files

QUERIES, ORACLES = {}, {}


def query_of(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = "case when length({c}) = 0 then 0 else greatest(1, length({c}) // 4) end"


@query_of("with m as (select distinct c_mktsegment as model from customer), i as (select event_id, event_type, props from events) select model, event_type, count(*) as tasks, sum(" + TOKENS.format(c="props") + ")::bigint as tokens from m cross join i group by 1, 2")
def prompt_tasks(spark, d):
    models = table(spark, d, "customer").select(F.col("c_mktsegment").alias("model")).distinct()
    t = prompts.tasks(models, table(spark, d, "events").select("event_type", "props"))
    return t.groupBy("model", "event_type").agg(F.count("*").alias("tasks"), F.sum(tx.tokens(F.col("props"))).alias("tokens"))


@query_of("""with models as (select distinct p_type || ' ' || p_brand as model, substr(p_type, 1, 4) || case when p_brand = 'Brand#11' then 'x' else '' end as label from part),
w as (select n_name as id, n_nationkey as place, n_nationkey * 1000 as size from nation union all select p_type, 60 + p_size, 50 * p_size from (select p_type, min(p_size) as p_size from part group by 1) union all select distinct p_type || ' Brand#12', 200, 7000 from part),
k as (select * from w where size > 0), p as (select label, arg_min(size, (place, id)) as part from (select distinct label from models) join k on contains(lower(id), lower(label)) group by 1)
select model, greatest(0, coalesce(k.size, part, 250000) - 256)::bigint as context from models left join k on id = model left join p on p.label = models.label""")
def prompt_budget(spark, d):
    part = table(spark, d, "part")
    models = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("model"), F.concat(F.substring("p_type", 1, 4), F.when(F.col("p_brand") == "Brand#11", "x").otherwise("")).alias("label")).distinct()
    w = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.struct(F.col("n_nationkey").alias("place"), F.col("n_name").alias("id")).alias("place"), (F.col("n_nationkey") * 1000).alias("size"))
    sizes = part.groupBy("p_type").agg(F.min("p_size").alias("s"))
    w = w.union(sizes.select("p_type", F.struct(F.col("s") + 60, "p_type"), F.col("s") * 50))
    name = F.concat("p_type", F.lit(" Brand#12"))
    w = w.union(sizes.select(name, F.struct(F.lit(200), name), F.lit(7000)))
    return prompts.with_window(models, w).select("model", F.col("window").alias("context"))


@query_of("select doc_id, case when " + TOKENS.format(c="text") + " <= 40 then text else regexp_replace(text[1:160], '\\s+$', '') || chr(10) || '[TRUNCATED]' || chr(10) end as text, (" + TOKENS.format(c="text") + ")::bigint as tokens from documents")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncated(F.col("text"), 40).alias("text"), tx.tokens(F.col("text")).alias("tokens"))


@query_of("select o_orderkey, md5('The following is a constraint model:' || chr(10) || o_orderpriority || case when o_orderkey % 3 = 0 then '' else chr(10) || chr(10) || 'Description:' || chr(10) || o_orderstatus end || chr(10) || chr(10) || 'Choose the three best among: a, b, c. Answer only with [first, second, third].') as prompt from orders")
def prompt_text(spark, d):
    o = table(spark, d, "orders")
    text = prompts.prompt(F.col("o_orderpriority"), F.lit("a, b, c"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return o.select("o_orderkey", F.md5(text).alias("prompt"))


RESPONSE_SQL = "select user_id, event_type || ': [' || string_agg('e' || event_id, ', ' order by event_id) || ']' as line from events group by user_id, event_type"


def _responses(spark, d):
    e = table(spark, d, "events")
    lines = e.groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: F.concat(F.lit("e"), x)), ", ").alias("l"))
    lines = lines.select("user_id", "event_type", F.concat("event_type", F.lit(": ["), "l", F.lit("]")).alias("line"))
    return lines.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "line"))), lambda x: x.line), "\n").alias("response"))


@query_of(f"with l as ({RESPONSE_SQL}) select user_id, regexp_extract(line, '^([a-z]+)', 1) as name, len(string_split(line, ',')) as n, regexp_extract(line, '\\[([^\\],]+)', 1) as first from l")
def response_pairs(spark, d):
    r = prompts.responses(_responses(spark, d))
    return r.select("user_id", "name", F.size("picks").cast("long").alias("n"), F.get("picks", F.lit(0)).alias("first"))


@query_of(f"with l as ({RESPONSE_SQL}), r as (select user_id, string_agg(line, chr(10) order by line) as response from l group by 1) select user_id, regexp_extract(response, '\\[([^\\]]+)\\]', 1) as picks, length(response) - length(regexp_extract(response, '(?s)^[^\\[]*\\[[^\\]]+\\]\\s*', 0)) as rest from r")
def response_first_bracket(spark, d):
    r = _responses(spark, d)
    return r.select("user_id", tx.first_bracket(F.col("response")).alias("picks"), F.char_length(tx.after_bracket(F.col("response"))).cast("long").alias("rest"))


MESSAGES = "case event_id % 11 when 0 then 'Error 429: slow down' when 1 then 'RESOURCE_EXHAUSTED' when 2 then '503 Service Unavailable' when 3 then 'model overloaded' when 4 then '413 Payload' when 5 then 'Request too large: token limit' when 6 then 'TPM reached' when 7 then 'rate_limit_exceeded' when 8 then 'context_length_exceeded' when 9 then 'Rate limit' else 'boom' end"
POLICY = "case when contains(m, 'rate_limit') or contains(m, 'tpm') or contains(m, 'token') or contains(m, '429') then 'rate' when contains(m, 'resource_exhausted') then 'exhausted' when contains(m, 'unavailable') or contains(m, 'overloaded') or contains(m, '503') then 'unavailable' when contains(m, '413') or contains(m, 'context_length') or contains(m, 'too large') then 'too_large' else 'other' end"


@query_of(f"with m as (select event_id, lower({MESSAGES}) as m from events), p as (select event_id, {POLICY} as policy from m) select event_id, policy, (case when policy in ('rate', 'too_large') then 60 when policy in ('exhausted', 'unavailable') then 30 end)::int as wait, least(60, pow(2, event_id % 9))::bigint as backoff from p")
def error_policy(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(MESSAGES).alias("m")).withColumn("policy", tx.error_policy(F.col("m")))
    return e.select("event_id", "policy", tx.wait("policy").alias("wait"), tx.backoff(F.col("event_id") % 9).alias("backoff"))


@query_of("""with recursive m as (select conv_id, turn, (case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end)::bigint as n, row_number() over (partition by conv_id order by turn, (case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end)) as rn from conversations),
p as (select conv_id, turn, rn, n as used, 0::bigint as chat from m where rn = 1 union all select m.conv_id, m.turn, m.rn, case when p.used > 0 and p.used + m.n > 60 then m.n else p.used + m.n end, case when p.used > 0 and p.used + m.n > 60 then p.chat + 1 else p.chat end from p join m on m.conv_id = p.conv_id and m.rn = p.rn + 1)
select conv_id, turn, chat from p""")
def chat_packing(spark, d):
    return prompts.packed(table(spark, d, "conversations"), "conv_id", "turn", "text", 60)


CELLS = "select user_id, event_id, case when event_id % 3 = 0 then event_type when event_id % 97 = 1 then 'TOTAL' else ' ' end as problem, case when event_id % 2 = 0 then 'i' || (event_id % 7) else '' end as instance from events"


@query_of(f"with c as ({CELLS}), f as (select user_id, event_id, last_value(nullif(trim(problem), '') ignore nulls) over w as problem, last_value(nullif(trim(instance), '') ignore nulls) over w as instance from c window w as (partition by user_id order by event_id rows between unbounded preceding and current row)) select * from f where upper(coalesce(problem, '')) <> 'TOTAL'")
def forward_fill(spark, d):
    k = F.col("event_id")
    cells = table(spark, d, "events").select("user_id", "event_id", F.when(k % 3 == 0, F.col("event_type")).when(k % 97 == 1, "TOTAL").otherwise(" ").alias("problem"), F.when(k % 2 == 0, F.concat(F.lit("i"), k % 7)).otherwise("").alias("instance"))
    return taxonomy.filled(cells, "user_id", "event_id", ["problem", "instance"])


@query_of("with n as (select distinct p_type as name from part), c as (select distinct p_brand as category, p_type as member from part where p_size < 3), x as (select distinct name, coalesce(category, 'Uncategorized') as category from n left join c on name = member) select name, min(category) as category, count(*) as categories from x group by 1")
def taxonomy_categorize(spark, d):
    p = table(spark, d, "part")
    found = taxonomy.categorized(p.select(F.col("p_type").alias("name")), p.filter("p_size < 3").select(F.col("p_brand").alias("category"), F.col("p_type").alias("member")))
    return taxonomy.primary(found)


@query_of("with n as (select distinct name from (select 'fzn_' || lower(replace(p_type, ' ', '_')) || '_reif' as name from part union all select 'other_' || p_brand from part)), k as (select distinct lower(replace(p_type, ' ', '_')) as known from part where p_size % 2 = 0 union select 'other'), x as (select name, known, length(known) as l from n join k on (regexp_replace(name, '^fzn_', '') = known or starts_with(regexp_replace(name, '^fzn_', ''), known || '_'))) select n.name, arg_max(known, l) as known from n left join x on n.name = x.name group by 1")
def suffix_lookup(spark, d):
    p = table(spark, d, "part")
    low = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    names = p.select(F.concat(F.lit("fzn_"), low, F.lit("_reif")).alias("name")).union(p.select(F.concat(F.lit("other_"), "p_brand")))
    known = p.filter("p_size % 2 = 0").select(low.alias("known")).union(spark.createDataFrame([("other",)], "known string"))
    return taxonomy.looked_up(names, known)


@query_of("with k as (select distinct p_type as known from part), a as (select distinct case p_partkey % 4 when 0 then p_type when 1 then ' ' || lower(p_type) when 2 then p_type || '-2' else substr(p_type, 1, 3 + p_size % 6) end as name from part), f as (select name, known, case when known = name then 1 when lower(known) = lower(trim(name)) then 2 else 3 end as tier from a join k on contains(lower(known), lower(trim(name)))), g as (select name, tier, min(known) as known, count(*) as n from f group by 1, 2), h as (select name, arg_min(known, tier) as known from g where tier < 3 or n = 1 group by 1) select a.name, h.known from a left join h on a.name = h.name")
def resolve_names(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 4
    asked = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit(" "), F.lower("p_type"))).when(k == 2, F.concat("p_type", F.lit("-2"))).otherwise(F.substring(F.col("p_type"), F.lit(1), F.lit(3) + F.col("p_size") % 6))
    return taxonomy.resolved(p.select(asked.alias("name")), p.select(F.col("p_type").alias("known")))


@query_of("select event_type, count(*) as n, sum(cast(props->>'k' as bigint))::bigint as k, count(distinct props->>'k') as kinds from events group by 1")
def events_props(spark, d):
    k = F.from_json("props", "k bigint").k
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.count_distinct(k).alias("kinds"))


@query_of("with l as (select page_id, unnest(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1)) as link from pages) select link, min(page_id) as first_page, count(*) as n from l where starts_with(link, '/') group by 1")
def page_links(spark, d):
    found = files.links(table(spark, d, "pages").select(F.col("page_id").alias("url"), "html"), "/")
    return found.select("link", F.col("url").alias("first_page"), "n")


@query_of("with t as (select distinct p_partkey, cast(p_partkey as varchar) || '.' || lpad(cast(p_size * 997 as varchar), 6, '0') || case when p_size % 5 = 0 then ' ' when p_size % 5 = 1 then 'e3' else '' end as x from part) select p_partkey, regexp_replace(x, '^(\\s*[+-]?\\d+\\.\\d{3})\\d+(\\s*)$', '\\1\\2') as three, regexp_replace(x, '^(\\s*[+-]?\\d+)\\.\\d+(\\s*)$', '\\1\\2') as none from t")
def csv_truncate(spark, d):
    s = F.col("p_size")
    x = F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.lpad((s * 997).cast("string"), 6, "0"), F.when(s % 5 == 0, " ").when(s % 5 == 1, "e3").otherwise(""))
    return table(spark, d, "part").select("p_partkey", tx.decimals(x, 3).alias("three"), tx.decimals(x, 0).alias("none"))


@query_of("with s as (select p_brand, p_size, min(p_size) over (partition by p_brand) as lo, max(p_size) over (partition by p_brand) as hi from part), b as (select p_brand, p_size, lo, hi, (case when p_size < lo + (hi - lo + 1) * 1 // 4 then 0 when p_size < lo + (hi - lo + 1) * 2 // 4 then 1 when p_size < lo + (hi - lo + 1) * 3 // 4 then 2 else 3 end) as b from s) select p_brand, (lo + (hi - lo + 1) * b // 4)::bigint as low, (case when b = 3 then hi else lo + (hi - lo + 1) * (b + 1) // 4 - 1 end)::bigint as high, count(*) as n, round(avg(p_size), 6) as mean from b group by p_brand, lo, hi, b")
def domain_buckets(spark, d):
    from sievework.operators.flatzinc import buckets

    return buckets(table(spark, d, "part").select("p_brand", F.col("p_size").cast("long").alias("size")), "p_brand").withColumn("mean", F.round("mean", 6))


@query_of("with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) as token from documents), k as (select distinct lower(n_name) as token from nation union select 'the' union select 'and' union select 'la') select token, count(*) as occurrences, count(distinct doc_id) as texts from w join k using (token) group by 1")
def token_degree(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))).alias("token"))
    names = table(spark, d, "nation").select(F.lower("n_name").alias("token")).union(spark.createDataFrame([("the",), ("and",), ("la",)], "token string")).distinct()
    return words.join(names, "token").groupBy("token").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("texts"))


@query_of("with recursive n as (select p_partkey, p_partkey * 977 as x, '' as s from part union all select p_partkey, x // 26 - 1, chr((x % 26 + 97)::int) || s from n where x >= 0) select p_partkey, s as letters from n where x < 0")
def index_letters(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.letters(F.col("p_partkey") * 977).alias("letters"))


@query_of("with t as (select p_partkey, case p_partkey % 5 when 0 then cast(p_size as varchar) when 1 then ' ' || cast(p_retailprice as varchar) when 2 then '1d' when 3 then '' else p_name end as x from part) select p_partkey, case when p_partkey % 5 < 2 then cast(x as double) end as number from t")
def numeric_coercion(spark, d):
    k = F.col("p_partkey") % 5
    x = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(k == 2, "1d").when(k == 3, "").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tx.number(x).alias("number"))


@query_of("with u as (select page_id, case when page_id % 3 = 0 then replace(url, '/', chr(92)) else url end as url from pages) select page_id, nullif(regexp_extract(replace(url, chr(92), '/'), '([^/]*/[^/]*)$', 1), '') as key from u")
def path_key(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.key_of_path(url).alias("key"))


@query_of("with c as (select 'T0p' || k as f from generate_series(0, 9) t(k)), m as (select distinct c_mktsegment as model from customer) select model, 'chat_Pdesc_' || f || '.json' as file, cast(replace(f[2:], 'p', '.') as double) as temperature from m cross join c")
def experiment_grid(spark, d):
    """Every configuration with every temperature, and the temperature read back from the file's name."""
    models = table(spark, d, "customer").select(F.col("c_mktsegment").alias("model")).distinct()
    grid = models.crossJoin(spark.range(10).select(F.concat(F.lit("chat_Pdesc_T0p"), "id", F.lit(".json")).alias("file")))
    return grid.withColumn("temperature", tx.temperature(F.col("file")))


ASKED = "select c_custkey, 'Instance: i' || c_custkey || chr(10) || c_name as m1, 'j' || c_custkey as m2, case when c_custkey % 3 = 0 then c_name || ': [a, b ,, c]' || chr(10) || 'q: [d]' || chr(10) || 'q: [e]' when c_custkey % 3 = 1 then 'I say [x,y] only' else 'none' end as response from customer"


@query_of(f"""with c as ({ASKED}), named as (select c_custkey, unnest([c.response]) as r from c where c_custkey % 3 = 0),
n as (select c_custkey, substr(r, 1, position(':' in r) - 1) as name, 'a|b||c' as picks, null as error from named union all select c_custkey, 'q', 'e', null from named),
p as (select c_custkey, 'i' || c_custkey as name, case when c_custkey % 3 = 1 then 'x|y' end as picks, case when c_custkey % 3 = 2 then 'no parsed response' end as error from c where c_custkey % 3 > 0 union all select c_custkey, m2, null, 'no parsed response' from c where c_custkey % 3 > 0)
select * from n union all select * from p""")
def response_fallback(spark, d):
    """Named lists of an answer, else its brackets by place, else an error row."""
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_name").select("c_custkey", F.array(F.concat(F.lit("Instance: i"), "c_custkey", F.lit("\n"), "c_name"), F.concat(F.lit("j"), "c_custkey")).alias("asked"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(": [a, b ,, c]\nq: [d]\nq: [e]"))).when(F.col("c_custkey") % 3 == 1, "I say [x,y] only").otherwise("none").alias("response"))
    return prompts.parsed(c).select("c_custkey", "name", F.array_join("picks", "|").alias("picks"), "error")


@query_of("with s as (select p_brand || '/' || p_size || '.json' as key, case when min(p_partkey) % 4 = 0 then '' else min(p_name) end as summary from part where p_size % 2 = 0 group by p_brand, p_size), t as (select p_partkey, p_brand || '/' || p_size || '.json' as key from part) select p_partkey, nullif(summary, '') as summary, nullif(summary, '') is null as skipped from t left join s using (key)")
def summary_tasks(spark, d):
    """Tasks joined to parser summaries by the key of their path; those without one are marked."""
    part = table(spark, d, "part")
    key = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".json"))
    summaries = part.filter("p_size % 2 = 0").groupBy(key.alias("key")).agg(F.when(F.min("p_partkey") % 4 == 0, "").otherwise(F.min("p_name")).alias("summary"))
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/data/probs/"), key)).otherwise(F.concat(F.lit("c:\\x\\"), F.replace(key, F.lit("/"), F.lit("\\"))))
    found = prompts.with_summary(part.select("p_partkey", path.alias("path")), summaries, roots=("/data/probs",))
    return found.select("p_partkey", "summary", "skipped")


@query_of("with m as (select distinct p_type as model from part where p_type <> 'SMALL' and p_type in ('STANDARD', 'SMALL', 'LARGE', 'PROMO')), l as (select p_type as model, arg_min(p_name, p_partkey) as label from part where p_type <> 'LARGE' group by 1) select m.model, coalesce(label, m.model) as label from m left join l on m.model = l.model")
def model_selection(spark, d):
    """Models that are asked, with their readable labels or else their ids."""
    part = table(spark, d, "part")
    models = prompts.selected(part.select(F.col("p_type").alias("model")).distinct(), ["SMALL"], top=["STANDARD", "SMALL", "LARGE", "PROMO"])
    labels = part.filter("p_type <> 'LARGE'").select(F.col("p_type").alias("model"), F.col("p_partkey").alias("place"), F.col("p_name").alias("label"))
    return prompts.labelled(models, labels)


@query_of("select event_id, coalesce(case event_type when 'view' then 'seen' when 'click' then 'pressed' end, event_type) as kind from events")
def value_recode(spark, d):
    labels = spark.createDataFrame([("view", "seen"), ("click", "pressed")], "value string, label string")
    return taxonomy.recoded(table(spark, d, "events").select("event_id", F.col("event_type").alias("kind")), "kind", labels)


@query_of("""with m as (select conv_id, coalesce(list(text order by turn) filter (role = 'user'), []::varchar[]) as u from conversations where text is not null group by 1),
l as (select *, regexp_extract_all(u[1], '[^\\n]*\\n|[^\\n]+') as l from m),
c as (select *, case when len(u) <> 1 then null when len(l) <= 1 then length(u[1]) // 2 else length(array_to_string(l[1:len(l) // 2], '')) end as cut from l)
select conv_id, md5(case when len(u) = 1 then substr(u[1], 1, cut) else array_to_string(u[1:len(u) // 2], '|') end) as first, md5(case when len(u) = 1 then substr(u[1], cut + 1) else array_to_string(u[len(u) // 2 + 1:], '|') end) as second from c""")
def chat_halves(spark, d):
    """The user's half of each half of a conversation: of its messages, of a single message's lines, or of a single line."""
    rows = table(spark, d, "conversations").filter("text is not null")
    m = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("m"))
    users = lambda c: F.transform(F.filter(c, lambda x: x.role == "user"), lambda x: x.content)
    return m.select("conv_id", *(F.md5(F.array_join(users(h), "|")).alias(n) for h, n in zip(prompts.halves(F.col("m")), ("first", "second"), strict=True)))


@query_of("with p as (select p_partkey, case p_partkey % 4 when 0 then './' || p_brand || '.mzn' when 1 then '/root/probs/' || p_brand || '.mzn' when 2 then 'x/y/' || p_brand || '.mzn' else './none' || p_partkey || '.mzn' end as script from part), f as (select '/root/probs/' || p_brand || '.mzn' as path, min(p_name) as text from part group by 1) select p_partkey, case when p_partkey % 4 < 3 then f.path end as path, case p_partkey % 4 when 0 then f.text when 3 then '[Error reading ' || script || ': no such file]' else script end as content from p left join f on f.path = '/root/probs/' || regexp_extract(script, '([^/]*)$', 1)")
def script_files(spark, d):
    """Scripts found below a root, by absolute path or by bare name, and their contents."""
    part, k = table(spark, d, "part"), F.col("p_partkey") % 4
    name = F.concat("p_brand", F.lit(".mzn"))
    script = F.when(k == 0, F.concat(F.lit("./"), name)).when(k == 1, F.concat(F.lit("/root/probs/"), name)).when(k == 2, F.concat(F.lit("x/y/"), name)).otherwise(F.concat(F.lit("./none"), "p_partkey", F.lit(".mzn")))
    files = part.groupBy(F.concat(F.lit("/root/probs/"), name).alias("path")).agg(F.min("p_name").alias("text"))
    return documents.scripts(part.select("p_partkey", script.alias("script")), files, "/root/probs").select("p_partkey", "path", "content")
