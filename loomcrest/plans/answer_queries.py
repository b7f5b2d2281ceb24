"""Queries for answers of models and tools, sweeps of evaluations, and prompts with retrieved demonstrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses, sanitize, source, text
from ..operators import contexts, curate, evaluate, joins, providers, reports, retrieve
from ..session import shared_folder, table
from ..sources import readers
from .catalogue import _OVERLAP
from .registry import query
from .source_queries import _CODE

_ANSWER = """case event_id % 6 when 0 then concat('{"severity": 8, "suggested_fix_for_others": "f', event_id, '", "vulnerability_types": "one"}')
when 1 then concat('so:\n```json\n{"analysis": ["a", "b"], "severity": true, "confidence": 0.9, "safety_reasoning": ["x", "', event_id, '"], "best_practices": "bp"}\n```')
when 2 then 'text {"vulnerability_types": ["A", "B"], "severity": "7.5"} tail' when 3 then 'no json' when 4 then '{"severity": "high"}' else '{"confidence": "x"}' end"""


@query("""with x as (select event_id, event_id % 6 k from events)
select event_id, case k when 0 then 8.0::double when 1 then 1 when 2 then 7.5 end severity, case k when 0 then 'one' when 1 then '' when 2 then 'A,B' end types, case k when 0 then 'f' || event_id when 1 then '' when 2 then '' end fix,
case k when 1 then 'x' || chr(10) || event_id when 3 then null when 5 then null else '' end reasoning, case k when 1 then 'bp' when 3 then null when 5 then null else '' end practices, case k when 1 then 0.9::double when 3 then null when 5 then null else 0.5 end confidence from x""")
def answer_forms(spark, d):
    x = table(spark, d, "events").select("event_id", F.expr(_ANSWER).alias("a"))
    x = x.select("event_id", responses.vulnerable_annotation(F.col("a")).alias("v"), responses.safe_annotation(F.col("a")).alias("s"))
    return x.select("event_id", "v.severity", F.array_join("v.vulnerability_types", ",").alias("types"), F.col("v.suggested_fix").alias("fix"), "s.reasoning", F.col("s.best_practices").alias("practices"), "s.confidence")


@query("""select p_partkey, case p_partkey % 3 when 0 then 'No error details available' when 1 then 'a' || chr(10) || 'b' || chr(10) || '... (showing first 2 lines of 3 total)' else 'a' || p_partkey end summary, case when length(p_name) > 5 then left(p_name, 5) || '...' else p_name end short,
case p_partkey % 4 when 0 then 'SWC-107 at ' || p_size when 1 then '' when 2 then 'trouble' || chr(10) || 'here' else 'an issue|the swc id' end issues, p_partkey % 4 = 1 passed, case when p_partkey % 2 = 0 then 'x = 1;' || chr(10) || 'so' else 'uint b' || p_partkey end body from part""")
def tool_texts(spark, d):
    k = F.col("p_partkey")
    error = F.expr("case p_partkey % 3 when 0 then '' when 1 then 'failed: a\nb\nc\n' else concat('failed: a', p_partkey) end")
    said = F.expr("case p_partkey % 4 when 0 then concat('begin\n  SWC-107 at ', p_size, ' \nend') when 1 then 'No issues found.' when 2 then 'trouble\nhere' else 'an issue\n-\nthe swc id' end")
    answer = F.expr("case when p_partkey % 2 = 0 then 'Here it is:\n```solidity\nthe code\nx = 1;\nso\n```\nbye' else concat('\nuint b', p_partkey, '\n```\n') end")
    issues = providers.tool_text_issues(said)
    return table(spark, d, "part").select("p_partkey", text.error_summary(error, 2, "failed: ").alias("summary"), text.shorten(F.col("p_name"), 5).alias("short"), F.array_join(issues["issues"], "|").alias("issues"), issues["passed"].alias("passed"), source.bare_body(answer).alias("body")).where(k.isNotNull())


_RUNS = """with l as (select l_orderkey k, max((l_returnflag = 'A')::int) a from lineitem group by 1),
r as (select o_orderkey, o_orderpriority m, case o_orderkey % 3 when 0 then 'none' when 1 then '0.9' else 'none' end p, o_custkey % 10 / 10.0::double solved, case when o_orderkey % 5 = 0 then 0.25::double else coalesce(a, 0) end bleu, coalesce(a, 0)::double edit, o_orderkey % 7 = 0 extra from orders left join l on k = o_orderkey where o_orderkey % 11 <> 0)"""


@query(f"""{_RUNS}, x as (select 'model=' || m || '|n=5|temp=0.5|top_p=' || p || '|rag=off' config_key, unnest([{{'n': 'solved_rate', 'v': solved}}, {{'n': 'highest_bleu', 'v': bleu}}, {{'n': 'highest_edit_sim', 'v': edit}}, {{'n': 'extra', 'v': case when extra then 2.5::double else 0 end}}]) u from r)
select config_key, count(*) num_runs, u.n metric, round(avg(u.v), 6) mean, round(coalesce(stddev_samp(u.v), 0), 6) std from x group by config_key, u.n""")
def sweep_metrics(spark, d):
    """Each order is a run's file: its lines are samples, solved ones with a candidate equal to the reference; broken files drop out."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate")
    line = F.struct(F.concat(F.lit("function f"), F.col("l_partkey").cast("string"), F.lit("(uint a) public returns (uint b)")).alias("reference_code"), F.when(F.col("l_returnflag") == "A", F.array(F.concat(F.lit("function f"), F.col("l_partkey").cast("string"), F.lit("(uint a) public returns (uint b)")), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("passed_candidate_codes"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.collect_list(line)).alias("details"))
    x = o.join(lines, "o_orderkey", "left")
    meta = F.concat(F.lit('{"model": "'), "o_orderpriority", F.lit('", "n_samples": 5, "temperature": 0.50, "seed": '), F.col("o_orderkey").cast("string"), F.expr("""case o_orderkey % 3 when 0 then ', "top_p": "None"' when 1 then ', "top_p": 0.9' else '' end"""), F.lit("}"))
    metrics = F.concat(F.lit('{"solved_rate": '), (F.col("o_custkey") % 10 / 10).cast("string"), F.expr("""case when o_orderkey % 5 = 0 then ', "highest_bleu": 0.25' else '' end"""), F.expr("""case when o_orderkey % 7 = 0 then ', "extra": 2.5' else '' end"""), F.lit("}"))
    files = x.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified"), F.try_parse_json(F.when(F.col("o_orderkey") % 11 == 0, "[]").otherwise(meta)).alias("meta"), F.try_parse_json(metrics).alias("metrics"), F.try_parse_json(F.coalesce("details", F.lit("null"))).alias("details"))
    s = evaluate.sweep_summary(evaluate.last_runs(evaluate.run_records(files)))
    return s.select("config_key", "num_runs", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""with e as (select p_partkey id, case when p_size % 11 = 10 then 'unknown' when p_size % 11 <= 4 then 'early' when p_size % 11 <= 6 then 'late' when p_size % 11 <= 7 then 'transition' else 'modern' end era from part),
m as (select id, era, row_number() over (order by md5('42' || id::varchar), id) n from e where era = 'modern')
select id, 'wild' kind, case era when 'transition' then 'val' else 'train' end split, era from e where era in ('early', 'late', 'transition') union all select id, 'wild', 'test', era from m where n <= 50 union all select -s_suppkey - 1, 'curated', 'test', 'early' from supplier""")
def era_splits(spark, d):
    minor = F.col("p_size") % 11
    version = F.when(minor == 10, "1.0").otherwise(F.concat(F.lit("0."), minor.cast("string"), F.lit(".25")))
    wild = table(spark, d, "part").select(F.col("p_partkey").alias("id"), version.alias("v"))
    curated = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.lit("0.4.11").alias("v"))
    out = curate.era_split(wild, curated, "id", "v", 50)
    return out.select("id", F.when(F.col("id") < 0, "curated").otherwise("wild").alias("kind"), "split", "era")


@query("""select o_orderkey sample_id, 1 total_generated, ok::int correct_generated, case when ok then 'code ' || o_orderkey end best, case when ok then 1.0::double end orig_sim, case when o_orderkey % 4 = 0 then 0.0::double else o_orderkey % 7 / 7.0::double end ir_sim
from (select *, o_orderkey % 4 <> 0 and o_orderstatus = 'F' and o_custkey % 3 > 0 and coalesce(o_orderpriority <> '5-LOW', true) ok from orders)""")
def baseline_samples(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit("code "), F.col("o_orderkey").cast("string"))).alias("code"), (F.col("o_orderstatus") == "F").alias("compiles"), (F.col("o_custkey") % 3 > 0).alias("passed"), (F.col("o_orderpriority") != "5-LOW").alias("other_passed"), (F.col("o_orderkey") % 7 / 7).alias("ir_sim"), F.lit(0.1).alias("ir_change"))
    out = evaluate.baseline_rows(x)
    return out.select("sample_id", "total_generated", "correct_generated", F.col("best_candidate_code").alias("best"), F.col("best_candidate_orig_sim").alias("orig_sim"), F.col("best_candidate_ir_sim").alias("ir_sim"))


@query("""with x as (select l_orderkey k, count(*) n, count(*) filter (where l_returnflag = 'R') c from lineitem group by 1),
y as (select case when o_orderpriority in ('1-URGENT', '2-HIGH', 'NONE') then o_orderpriority else 'OTHER' end bucket, n, c from orders join x on k = o_orderkey),
g as (select bucket, count(*) n, round(avg((c > 0)::int), 6) solved_rate, round(avg(case when n < 1 then 0 else 1 - (n - c)::double / n end), 6) pass_at_1, round(avg(case when n < 2 then 0 when c = n then 1 else 1 - (n - c)::double / n * (n - c - 1)::double / (n - 1) end), 6) pass_at_2 from y group by 1)
select b.bucket, coalesce(n, 0) n, coalesce(solved_rate, 0) solved_rate, coalesce(pass_at_1, 0) pass_at_1, coalesce(pass_at_2, 0) pass_at_2 from (select unnest(['1-URGENT', '2-HIGH', 'NONE', 'OTHER']) bucket) b left join g using (bucket)""")
def bucket_pass_rates(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total_generated"), F.count_if(F.col("l_returnflag") == "R").alias("correct_generated"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(x, "o_orderkey")
    out = reports.bucket_metrics(rows, "o_orderpriority", ["1-URGENT", "2-HIGH", "NONE"], (1, 2))
    return out.select("bucket", "n", *(F.round(c, 6).alias(c) for c in ("solved_rate", "pass_at_1", "pass_at_2")))


_DEMO = "'<DEMO>' || chr(10) || '### Vulnerable (' || lang || '):' || chr(10) || '```solidity' || chr(10) || 'call ' || doc_id || ';' || chr(10) || '```' || chr(10) || '### Fixed:' || chr(10) || '```solidity' || chr(10) || 'fix ' || doc_id || ';' || chr(10) || '```' || chr(10) || '</DEMO>'"


@query(f"""with {_OVERLAP}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from s),
t as (select query_id, doc_id, lang, rank, {_DEMO} demo, max((lang = 'de')::int) over (partition by query_id) hit from r join documents using (doc_id) where rank <= 10),
u as (select *, row_number() over (partition by query_id order by rank) n, greatest(1, length(demo) // 4) c from t where lang = 'de' or hit = 0), v as (select *, 6 + sum(c) over (partition by query_id order by n) upto from u where n <= 3),
w as (select query_id, string_agg(demo, chr(10) || chr(10) order by n) demos, string_agg(doc_id::varchar, ',' order by n) ids, count(*) k, max(upto) added from v where upto <= 76 group by 1)
select item_id query_id, coalesce(ids, '') ids, coalesce(k, 0) n_demos, coalesce(added, 0)::bigint added_tokens, md5(case when k is null then 'ask' else demos || chr(10) || chr(10) || '<QUERY>' || chr(10) || '### Vulnerability: de' || chr(10) || '### Severity: 7' || chr(10) || '### Code:' || chr(10) || '```solidity' || chr(10) || 'q' || item_id || chr(10) || '```' || chr(10) || '</QUERY>' || chr(10) || chr(10) || 'Provide the fixed code:' || chr(10) || chr(10) || 'ask' end) h from benchmark left join w on query_id = item_id""")
def retrieval_prompts(spark, d):
    """Search, filter by type, compact, pack within a budget, render: a prompt a benchmark item."""
    docs = table(spark, d, "documents")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieve.top_k(retrieve.token_overlap(b, docs).withColumn("score", F.round("score", 6)), "query_id", 10)
    i = F.col("doc_id").cast("string")
    shown = docs.select("doc_id", F.concat(F.lit("call "), i, F.lit(";  // note")).alias("code"), F.concat(F.lit("```\nfix "), i, F.lit(";\n```")).alias("fixed_code"), F.col("lang").alias("kind"))
    ask = b.select("query_id", F.lit("ask").alias("prompt"), F.array(F.lit("de")).alias("types"), F.lit(7).alias("severity"), F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("code"))
    out = retrieve.augment(ask, hits, shown, 3, 76)
    return out.select("query_id", F.array_join(F.col("demo_ids").cast("array<string>"), ",").alias("ids"), F.col("n_demos").cast("long").alias("n_demos"), F.col("added_tokens").cast("long").alias("added_tokens"), F.md5("prompt").alias("h"))


_SIGNED = r"list_concat(regexp_extract_all({0}, 'function\s+\w+'), regexp_extract_all({0}, 'modifier\s+\w+'), regexp_extract_all({0}, '(if|else|for|while|require)\s*\(', 1), regexp_extract_all({0}, '\.(call|delegatecall|transfer|send)\s*[({{]', 1), regexp_extract_all({0}, 'emit\s+\w+'))"


@query(f"select p_partkey, left(md5(array_to_string({_SIGNED.format('c')}, '|')), 8) signature, len({_SIGNED.format('c')}) n from (select p_partkey, {_CODE} || ' emit E' || p_size || '();' c from part)")
def structural_signatures(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.expr(_CODE), F.lit(" emit E"), F.col("p_size").cast("string"), F.lit("();")).alias("c"))
    return x.select("p_partkey", retrieve.signature_hash(F.col("c")).alias("signature"), F.size(retrieve.signature(F.col("c"))).cast("long").alias("n"))


def _written(spark, df, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}"
    df.write.mode("overwrite").text(path)
    return path


@query("""with r as (select p_partkey % 20 f, p_partkey % 300 s, max(p_partkey) a from part group by 1, 2),
t as (select event_id % 20 f, event_id % 300 s, list_sort(list(distinct 'tool' || user_id % 4)) tools from events where event_id % 3 = 0 group by 1, 2 having count(distinct user_id % 4) >= 2)
select 'F' || r.f || '.sol' file, 'C.f' || r.s || '(uint256, int)' signature, a::int line, array_to_string(tools, ',') tools from r join t using (f, s)""")
def voted_by_name(spark, d):
    """Findings that name a function by its signature, with blanks in it, meet the last range of that signature."""
    rows = F.concat(F.lit("F"), F.col("p_partkey") % 20, F.lit(".sol;C.f"), F.col("p_partkey") % 300, F.lit("(uint256, int);"), F.col("p_partkey"), F.lit(";"), F.col("p_partkey") + 5)
    found = F.concat(F.lit("F"), F.col("event_id") % 20, F.lit(".sol RENT C.f"), F.col("event_id") % 300, F.lit("(uint256, int) tool"), F.col("user_id") % 4)
    ranges = readers.function_ranges(spark, _written(spark, table(spark, d, "part").select(rows), "ranges"))
    findings = readers.findings(spark, _written(spark, table(spark, d, "events").where("event_id % 3 = 0").select(found), "found"))
    out = readers.voted_functions(ranges, findings)
    return out.select("file", "signature", F.explode("lines").alias("line"), F.array_join("tools", ",").alias("tools"))


@query("select s_suppkey k, s_suppkey::int as start, s_suppkey::int + 4 as \"end\" from supplier where s_suppkey % 5 > 0")
def paired_bugs(spark, d):
    """Sources and bug logs of one number, a file each by partition; sources without a log drop out."""
    base = shared_folder(spark)
    x = table(spark, d, "supplier").select("s_suppkey")
    logs = x.where("s_suppkey % 5 > 0").select(F.concat(F.col("s_suppkey"), F.lit(",5,TOD"), F.lit("\nloc,length,bug type")).alias("value"), (F.col("s_suppkey") % 2).alias("half"))
    for half in (0, 1):
        logs.where(f"half = {half}").select("value").write.text(f"{base}/logs/{half}")
    read = readers.bug_logs(spark, f"{base}/logs", "*.txt").withColumn("name", F.col("start").cast("string"))
    sources = x.select(F.concat(F.lit("buggy_"), F.col("s_suppkey"), F.lit(".sol")).alias("name"), F.lit("text").alias("text"))
    return readers.paired_files(sources, read).select(F.col("name").cast("long").alias("k"), "start", "end")


_NL = "chr(10)"
_UNCLEAN = f"concat('pragma solidity ^0.5.0;', {_NL}, 'contract C', cast(p_partkey as string), ' {{{{', {_NL}, case p_partkey % 3 when 0 then '  MyToken tok;' when 1 then '  Owner public o;' else '  Thing t;' end, {_NL}, '  function f() {{{{ Deal memory d; d.z = 1; d.a = 2; ', case when p_partkey % 2 = 0 then 'tok.transfer(x, 1);' else '' end, ' }}}}', {_NL}, '}}}}')".replace("{{", "{").replace("}}", "}")
_STUB = "'" + sanitize.TOKEN_STUB.replace("\n", "' || chr(10) || '") + "'"


@query(f"""select p_partkey, 'pragma solidity ^0.5.0;' || {_NL} || case when p_partkey % 2 = 0 then {_NL} || {_STUB} else '' end || 'contract C' || p_partkey || ' {{' || {_NL} || '    struct Deal {{' || {_NL} || '    uint256 a;' || {_NL} || '    uint256 z;' || {_NL} || '    }}' || {_NL} || case p_partkey % 3 when 0 then 'IERC20 tok;' when 1 then 'address public o;' else '  Thing t;' end || {_NL}
|| '  function f() {{ Deal memory d; d.z = 1; d.a = 2; ' || case when p_partkey % 2 = 0 then 'tok.transfer(x, 1);' else '' end || ' }}' || {_NL} || '}}' clean from part""")
def sanitized_sources(spark, d):
    """Assembled sources that call a token and have undeclared types."""
    return table(spark, d, "part").select("p_partkey", sanitize.sanitize(F.expr(_UNCLEAN)).alias("clean"))


@query("""with p as (select p_partkey k, p_partkey // 8 c, p_partkey % 8 f, p_size s, case p_partkey % 3 when 0 then 'function f() { emit E0(); for (i) { require(x); } }' when 1 then 'function f() { y.E1(2); }' else null end code from part where p_partkey % 8 < 6)
select a.k, a.code is not null coded, case when a.code like '%emit E0%' or b.code like '%emit E0%' then case when a.code like '%E1(%' or b.code like '%E1(%' then 'E0,E1' else 'E0' end when a.code like '%E1(%' or b.code like '%E1(%' then 'E1' else '' end events, case when b.k is not null then 'f' || b.f else '' end callees, (select count(*) from p u where u.c = a.c and u.f = a.f - 1) callers,
(select count(*) from p v where v.c = a.c) variables, (select arg_min(case when s % 2 = 0 then 'uint public v' || f || ';' else 'own v' || f end, f) from p v where v.c = a.c) "first", (select count(*) from p v where v.c = a.c) n_functions, coalesce(a.code like '%for (%', false) has_loops, a.s % 4 complexity, a.s % 4 > 1 has_ifs, a.s % 5 = 0 vulnerable, case when a.s % 7 = 0 then a.s else 1 end start_line, case when a.s % 7 = 0 then case when a.s % 14 = 0 then 'DoS' else '' end end label
from p a left join p b on b.c = a.c and b.f = a.f + 1 where a.f > 0""")
def analyzed_functions(spark, d):
    """Functions of an analyzer's tables, six a contract and the first a constructor, each calling the next."""
    p = table(spark, d, "part").where("p_partkey % 8 < 6")
    f = F.col("p_partkey") % 8
    name = F.concat(F.lit("f"), f.cast("string"))
    code = F.expr("case p_partkey % 3 when 0 then 'function f() { emit E0(); for (i) { require(x); } }' when 1 then 'function f() { y.E1(2); }' end")
    base = p.select("p_partkey", F.expr("cast(p_partkey div 8 as string)").alias("contract"), f.cast("int").alias("seq"), name.alias("name"), "p_size", code.alias("code"))
    functions = base.withColumns({"signature": F.lit("f()"), "visibility": F.lit("public"), "mutability": F.lit("view"), "special": F.col("seq") == 0, "nodes": (F.col("p_size") % 4).cast("int"), "external_calls": F.lit(0), "written": F.lit(1), "read": F.lit(0)})
    calls = base.select("contract", F.col("name").alias("caller"), F.col("contract").alias("callee_contract"), F.concat(F.lit("f"), (F.col("seq") + 1).cast("string")).alias("callee"), "seq").where("seq < 5")
    calls = calls.join(base.select(F.col("contract").alias("callee_contract"), F.col("name").alias("callee")), ["callee_contract", "callee"], "left_semi")
    variables = base.select("contract", "seq", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("name"), F.lit("uint").alias("type"), F.lit("public").alias("visibility"), F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("own v"), F.col("seq").cast("string"))).alias("code"))
    contracts = base.select("contract").distinct().withColumn("bases", F.array(F.lit("A")))
    events = contracts.select("contract", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).select("contract", "seq", F.concat(F.lit("E"), F.col("seq").cast("string")).alias("name"), F.lit(None).cast("string").alias("code"))
    x = contexts.contract_contexts(contracts, variables, functions, events=events)
    findings = base.where("p_size % 5 = 0").select("contract", "name", F.lit("dos").alias("type"), F.lit("High").alias("severity"))
    truth = base.where("p_size % 7 = 0").select("contract", "seq", "name", F.col("p_size").cast("int").alias("start"), F.col("p_size").cast("int").alias("end"), (F.col("p_size") % 14 == 0).alias("vulnerable"), F.array(F.lit("DoS")).alias("categories"))
    out = contexts.function_records(functions, calls, x, findings, truth)
    c = F.col("contract_context")
    names = lambda a: F.coalesce(F.array_join(F.transform(a, lambda e: e["name"]), ","), F.lit(""))
    return out.select(
        (F.col("contract").cast("long") * 8 + F.substr("name", F.lit(2)).cast("long")).alias("k"), (F.col("code") != F.concat(F.lit("function "), F.col("name"), F.lit("() {}"))).alias("coded"), names(c["events"]).alias("events"), names("called_functions").alias("callees"), F.coalesce(F.size("caller_functions"), F.lit(0)).cast("long").alias("callers"),
        F.size(c["state_variables"]).cast("long").alias("variables"), c["state_variables"][0]["code"].alias("first"), c["num_functions"].cast("long").alias("n_functions"), F.col("ast_features.has_loops"), F.col("ast_features.complexity").cast("long").alias("complexity"), F.col("ast_features.has_if_statements").alias("has_ifs"), F.col("slither_result.is_vulnerable").alias("vulnerable"), F.col("start_line").cast("long").alias("start_line"), F.array_join("label.vulnerability_types", ",").alias("label"),
    )


@query("""with x as (select event_id i, event_id % 4 <> 0 c, event_id % 3 <> 0 a, case event_id % 5 when 0 then false when 1 then null else true end b, event_id % 7 = 0 late from events)
select i, c compiles, c and a first_passed, not (c and not coalesce(b, true)) or late second_passed, c and a and (coalesce(b, true) or late) acceptable, case when not c then 'does not compile: e' || i when not coalesce(b, true) then 'second tool: p; q' when not a then 'first tool: x' || i end error, case when a and coalesce(b, true) then '' when a then 'two' when coalesce(b, true) then 'one' else 'one,two' end failed from x""")
def verified_repairs(spark, d):
    i = F.col("event_id")
    strings = lambda *v: F.array(*v).cast("array<string>")
    compiled = F.struct((i % 4 != 0).alias("passed"), F.concat(F.lit("e"), i.cast("string")).alias("error"))
    one = F.struct((i % 3 != 0).alias("passed"), strings(F.concat(F.lit("x"), i.cast("string"))).alias("issues"))
    verdict = F.when(i % 5 == 0, False).when(i % 5 != 1, True)
    two = F.struct(verdict.alias("passed"), strings(F.lit("p"), F.lit("q")).alias("issues"), F.when(i % 7 == 0, "Tool_TIMEOUT after 9").alias("error"))
    x = table(spark, d, "events").select(i.alias("i"), providers.verification(compiled, one, two).alias("v"), providers.rolled_up(F.create_map(F.lit("one"), one, F.lit("two"), two.dropFields("error"))).alias("r"))
    return x.select("i", "v.compiles", "v.first_passed", "v.second_passed", "v.acceptable", "v.error", F.array_join(F.transform("r.remaining", lambda t: t["tool"]), ",").alias("failed"))


@query("""select l_orderkey * 10 + l_linenumber fix_id, o_orderkey function_id, o_orderpriority sample_id, o_orderstatus dataset_name, 'wild' dataset_type, 'c' || o_custkey contract_name, 'f' function_name, 'v' vulnerable_code, 'x' || l_partkey fixed_code, case when l_linenumber > 2 then 'why' end fix_analysis, l_returnflag vulnerability_types, l_quantity severity, true compiles, true slither_passed, l_linenumber::int fix_version, 'm' model_name
from orders join lineitem on l_orderkey = o_orderkey where l_linestatus = 'F' and l_returnflag = 'A' and o_orderstatus in ('F', 'P')""")
def exported_pairs(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    functions = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sample_id"), F.col("o_orderstatus").alias("dataset_name"), F.lit("wild").alias("dataset_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("contract_name"), F.lit("f").alias("function_name"))
    fixes = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("function_id"), F.lit("v").alias("original_code"), F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("fixed_code"), F.when(F.col("l_linenumber") > 2, "why").alias("fix_analysis"), F.col("l_returnflag").alias("vulnerabilities_fixed"), F.col("l_quantity").alias("original_severity"), (F.col("l_linestatus") == "F").alias("compiles"), (F.col("l_returnflag") == "A").alias("slither_passed"), F.col("l_linenumber").cast("int").alias("fix_version"), F.lit("m").alias("model_name"))
    return joins.fix_pairs(functions, fixes, True, ["F", "P"])


@query("""with f as (select o_orderkey k, o_orderpriority d, o_orderstatus = 'F' v from orders), x as (select d, l_linestatus = 'F' c, l_returnflag = 'A' p from lineitem join f on k = l_orderkey),
a as (select d, grouping(d) g, count(*) functions, count(*) filter (where v) vulnerable from f group by rollup (d)), b as (select d, grouping(d) g, count(*) fixes, count(*) filter (where c) compiling, count(*) filter (where p) passing, count(*) filter (where c and p) successful from x group by rollup (d))
select a.d dataset_name, a.g = 1 is_total, functions, vulnerable, round(vulnerable / functions::double, 6) vulnerable_rate, coalesce(fixes, 0) fixes, coalesce(compiling, 0) compiling, coalesce(passing, 0) passing, coalesce(successful, 0) successful, round(coalesce(successful / fixes::double, 0), 6) success_rate from a left join b on a.d is not distinct from b.d and a.g = b.g""")
def store_totals(spark, d):
    functions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dataset_name"), (F.col("o_orderstatus") == "F").alias("is_vulnerable"))
    fixes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("function_id"), (F.col("l_linestatus") == "F").alias("compiles"), (F.col("l_returnflag") == "A").alias("slither_passed"))
    return reports.store_statistics(functions, fixes).withColumns({c: F.round(c, 6) for c in ("vulnerable_rate", "success_rate")})


@query("""with b as (select event_id, unnest(case event_type when 'click' then ['A', 'B', 'A'] when 'view' then ['B'] else ['OTHER'] end) bucket from events) select bucket, count(distinct event_id) n from b group by 1""")
def bucket_presence(spark, d):
    held = F.when(F.col("event_type") == "click", F.array(*map(F.lit, "ABA"))).when(F.col("event_type") == "view", F.array(F.lit("B"))).when(F.col("event_type") == "error", F.array().cast("array<string>"))
    return reports.bucket_sizes(table(spark, d, "events").select(held.alias("b")), "b")


_PAIRED = f"concat('- Type: DoS, x', {_NL}, case when p_partkey % 4 = 0 then '' else concat('**Function:** g', cast(p_partkey as string)) end, {_NL}, '**Source Code:**', {_NL}, ' ', {_CODE}, {_NL}, case when p_partkey % 3 = 0 then 'Please provide the complete fixed version of it' else '' end)"
_REPLY = "case p_partkey % 5 when 0 then ' ' when 1 then concat('so:\n```solidity\nfunction h() {{ z; }} function g', cast(p_partkey as string), '(int a) {{ y; }}\n```') when 2 then 'function h() {{ z; }} function' when 3 then 'no code' else 'function open( {{' end".replace("{{", "{").replace("}}", "}")


@query(f"""select p_partkey id, case when p_partkey % 4 = 0 then rtrim({_PAIRED}, {_NL}) else 'function g' || p_partkey || '(uint a) internal view {{ b = ' || p_partkey || '; }}' end code_, case p_partkey % 5 when 1 then case when p_partkey % 4 = 0 then 'function h() {{ z; }}' else 'function g' || p_partkey || '(int a) {{ y; }}' end when 2 then 'function h() {{ z; }}' when 3 then 'no code' else 'function open( {{' end fixed_code, 'DoS' vulnerability_type from part where p_partkey % 5 > 0""")
def repair_documents(spark, d):
    samples = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("i").alias("instruction"), F.expr(_PAIRED).alias("input"), F.expr(_REPLY).alias("output"))
    return readers.repair_corpus(samples).select("id", F.col("code").alias("code_"), "fixed_code", "vulnerability_type")
