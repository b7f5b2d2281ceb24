"""Queries on prompts, answers and files. Events, parts and conversations give the texts; files are written to the shared folder first."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import responses, similarity, source, text
from ..session import shared_folder, spread, table
from ..sources import readers, sinks
from .registry import query

_NL = "chr(10)"
_ANSWER = f"""case event_id % 7 when 0 then concat('Sure:', {_NL}, '```json', {_NL}, props, {_NL}, '```') when 1 then concat('So: ', props, ' done {{x') when 2 then concat(' ', props, ' ') when 3 then 'no object' when 4 then '{{"a": {{"b": 1}}, "c": 2}} tail }}' when 5 then concat('```', {_NL}, '{{"k": 1}}', {_NL}, '```') else '{{"s": "}}", "l": [1, "]"]}} and }}' end"""


@query(f"""with x as (select event_id, {_ANSWER} t, props from events)
select event_id, case event_id % 7 when 0 then props when 1 then props when 2 then props when 3 then null when 4 then '{{"a": {{"b": 1}}, "c": 2}} tail }}' when 5 then '{{"k": 1}}' else '{{"s": "}}", "l": [1, "]"]}} and }}' end note, case event_id % 7 when 0 then props when 1 then props when 2 then props when 3 then null when 4 then '{{"a": {{"b": 1}}, "c": 2}}' when 5 then '{{"k": 1}}' else '{{"s": "}}", "l": [1, "]"]}}' end fix, case event_id % 7 when 0 then 'json' || {_NL} || props when 5 then '{{"k": 1}}' end code from x""")
def json_of_answers(spark, d):
    t = F.expr(_ANSWER)
    return table(spark, d, "events").select("event_id", responses.json_of_annotation(t).alias("note"), responses.json_of_fix(t).alias("fix"), responses.code_of(t).alias("code"))


_NOTE = """case event_id % 6 when 0 then concat('{"is_safe": false, "severity": ', cast(event_id % 10 as string), ', "analysis": ["a", "b"], "reasoning": "r", "vulnerability_types": ["x", "y"], "slither_critique": "c"}') when 1 then '{"confidence": "0.25"}' when 2 then '{"severity": "high"}' when 3 then 'none' when 4 then '{"is_safe": 0, "agrees_with_slither": false, "severity": 1.5}' else '{"is_safe": true, "suggested_fix": ["p", "q"]}' end"""
_TOOL = "case event_id % 4 when 0 then true when 1 then false end"


@query(f"""with x as (select event_id, event_id % 6 k, {_TOOL} tool from events), y as (select *, case when k in (0, 4) then 'vulnerable' else 'safe' end l from x)
select event_id, case when k in (2, 3) then null else l end as label, case k when 0 then 'a' || chr(10) || 'b' when 1 then '' when 4 then '' when 5 then '' end analysis, case when k = 0 then 'x,y' when k in (1, 4, 5) then '' end types, case k when 0 then event_id % 10 when 1 then 0 when 4 then 1.5 when 5 then 0 end::double severity, case when k = 1 then 0.25 when k in (0, 4, 5) then 0.5 end::double confidence,
case when k = 5 then 'p' || chr(10) || 'q' when k in (0, 1, 4) then '' end suggested_fix, case when k in (0, 1, 5) then 'true' when k = 4 then 'false' end agreement, case when k in (2, 3) or tool is null then null when tool and l = 'safe' then 'vulnerable' when not tool and l = 'vulnerable' then 'safe' end tool_said from y""")
def annotations(spark, d):
    x = table(spark, d, "events").select("event_id", responses.annotation(F.expr(_NOTE), F.expr(_TOOL)).alias("a"))
    return x.select("event_id", "a.label", "a.analysis", F.when(F.col("a").isNotNull(), F.array_join("a.vulnerability_types", ",")).alias("types"), "a.severity", "a.confidence", "a.suggested_fix", F.col("a.agreement").cast("string").alias("agreement"), F.col("a.disagreement.tool").alias("tool_said"))


_REPAIR = f"""case event_id % 5 when 0 then '{{"fixed_code": "```solidity x; ```", "fix_analysis": "why"}}' when 1 then concat('text', {_NL}, '```solidity', {_NL}, 'y;', {_NL}, '```') when 2 then '{{"fixed_code": ""}} ``` z ```' when 3 then concat('{{bad}} ```', {_NL}, 'w;', {_NL}, '```') else 'nothing' end"""


@query("select event_id, case event_id % 5 when 0 then 'x;' when 1 then 'y;' when 3 then 'w;' end code, case event_id % 5 when 0 then 'why' when 1 then '' when 3 then '' end analysis, case event_id % 5 when 0 then 'json' when 1 then 'no_json' when 3 then 'bad_json' end how, case event_id % 5 when 0 then 'x;' when 1 then 'y;' when 2 then 'z' when 3 then 'w;' end again from events")
def repairs(spark, d):
    x = table(spark, d, "events").select("event_id", responses.fix(F.expr(_REPAIR)).alias("f"), responses.fix(F.expr(_REPAIR), retry=True).alias("g"))
    return x.select("event_id", "f.*", F.col("g.code").alias("again"))


_PROMPT = f"""concat('- Type: DoS, ', p_brand, '; x | y', {_NL}, case when p_partkey % 2 = 0 then 'Known vulnerability types : A / B' else 'nothing' end, {_NL}, case when p_partkey % 3 = 0 then concat('- Severity: ', cast(p_size as string), '.5') else 'severity:none' end, {_NL}, case when p_partkey % 4 = 0 then 'the severity: 3 holds' else '' end, {_NL}, '**Function:** f', cast(p_partkey as string), {_NL}, case when p_partkey % 5 = 0 then '' else '**Source Code:**' end, {_NL}, 'contract C {{ function f', cast(p_partkey as string), '() {{ a; }} function g() {{ }} }}', {_NL}, 'Please provide more')"""


@query(f"""with x as (select p_partkey k, p_brand, p_size, {_PROMPT} t from part)
select k, 'DoS|' || p_brand || '|x|y' || case when k % 2 = 0 then '|A|B' else '' end types, case when k % 4 = 0 then 3 when k % 3 = 0 then p_size + 0.5 end::double severity, 'f' || k as name, case when k % 5 = 0 then 'no_code' else 'changed' end status, md5(case when k % 5 = 0 then t else regexp_extract(t, '^((?:.|\\n)*\\*\\*Source Code:\\*\\*)', 1) || {_NL} || 'function f' || k || '() {{ a; }}' || {_NL} || 'Please provide more' end) h, 'DoS,' || p_brand || '; x | y' first_types from x""")
def prompts(spark, d):
    t = F.expr(_PROMPT)
    x = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", t.alias("t"))
    block = lambda code, name: F.get(F.transform(F.filter(source.functions(F.coalesce(code, F.lit(""))), lambda f: f["name"] == name), lambda f: f["code"]), F.lit(0))
    info, new = text.vulnerability_info(F.col("t")), text.shrunk_prompt(F.col("t"), text.token_estimate(F.col("t")), 5, block)
    x = x.select(F.col("p_partkey").alias("k"), info.alias("i"), text.function_of_prompt(F.col("t")).alias("name"), new.alias("n"), text.type_line(F.col("t")).alias("first"))
    return x.select("k", F.array_join("i.types", "|").alias("types"), "i.severity", "name", "n.status", F.md5("n.input").alias("h"), F.array_join("first", ",").alias("first_types"))


_MESSY = f"""concat(case when p_partkey % 2 = 0 then concat('```solidity', {_NL}) else '' end, 'a;  ', {_NL}, {_NL}, {_NL}, '// note', {_NL}, 'b; /* x', {_NL}, 'y */ c; // d', {_NL}, 'e;', case when p_partkey % 2 = 0 then concat({_NL}, '```') else '' end)"""


@query(f"""select p_partkey, 'a;' || {_NL} || {_NL} || 'b;  c;' || {_NL} || 'e;' compact, case when p_partkey % 2 = 0 then 'a;  ' || {_NL} || {_NL} || {_NL} || '// note' || {_NL} || 'b; /* x' || {_NL} || 'y */ c; // d' || {_NL} || 'e;' else {_MESSY} end bare,
'a_b.c-' || p_partkey file, 'Title' || {_NL} || 'rest' kept, 'rest' dropped, case when p_partkey % 2 = 0 then '```solidity' || {_NL} || 'a;  ' || {_NL} || '...' else 'a;  ' || {_NL} || {_NL} || '...' end short, case when p_partkey % 3 = 0 then 'X|y' else 'X|y|z' end once from part""")
def code_texts(spark, d):
    t, k = F.expr(_MESSY), F.col("p_partkey").cast("string")
    titled = F.lit("Title\nrest")
    names = F.when(F.col("p_partkey") % 3 == 0, F.array(*map(F.lit, ("X", "y", "x", "Y")))).otherwise(F.array(*map(F.lit, ("X", "y", "z"))))
    return table(spark, d, "part").select("p_partkey", text.compact_code(t).alias("compact"), text.unwrap_fence(t).alias("bare"), text.file_name(F.concat(F.lit("a /b.c-"), k)).alias("file"), text.drop_heading(titled, "Rest").alias("kept"), text.drop_heading(titled, "Title").alias("dropped"), text.truncate_lines(t, 2).alias("short"), F.array_join(text.case_distinct(names), "|").alias("once"))


@query("""with x as (select doc_id, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10)) || case when len(string_split(text, chr(10))) > 3 then chr(10) || '...' else '' end) short, md5(left(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), 180)) name from documents) select * from x""")
def document_texts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.truncate_lines(t, 3)).alias("short"), F.md5(text.file_name(t)).alias("name"))


_JSON = """case p_partkey % 4 when 0 then '{"fix":{"a":null,"b":[null,{"c":null,"d":1}]},"x":null}' when 1 then '{"fix":1}' when 2 then 'broken' else null end"""


@query("""select p_partkey, case p_partkey % 4 when 0 then '{"fix":{"b":[null,{"d":1}]},"x":null}' when 1 then '{"fix":1}' when 2 then 'broken' end bare, case when p_partkey % 2 = 0 then '--- ' || chr(10) || '+++ ' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' else '' end changes from part""")
def cleaned_json(spark, d):
    new = F.when(F.col("p_partkey") % 2 == 0, "a\nc").otherwise("a\nb")
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", responses.strip_nulls(F.expr(_JSON)).alias("bare"), similarity.diff(F.lit("a\nb"), new).alias("changes"))


@query("""with x as (select p_partkey k, p_partkey % 3 n, p_size, p_brand b from part)
select k, case when n = 0 then 'ask' else case n when 1 then 'd1' else 'd1' || chr(10) || chr(10) || 'd2' end || chr(10) || chr(10) || '<QUERY>' || chr(10) || '### Vulnerability: ' || b || ', y' || chr(10) || '### Severity: ' || p_size || chr(10) || '### Code:' || chr(10) || '```solidity' || chr(10) || 'code' || chr(10) || '```' || chr(10) || '</QUERY>' || chr(10) || chr(10) || 'Provide the fixed code:' || chr(10) || chr(10) || 'ask' end prompt, n > 0 used, n n_demos from x""")
def augmented_prompts(spark, d):
    demos = F.slice(F.array(F.lit("d1"), F.lit("d2")), 1, (F.col("p_partkey") % 3).cast("int"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), responses.augmented_prompt(demos, F.array(F.col("p_brand"), F.lit("y")), F.col("p_size"), F.lit(" code "), F.lit("ask")).alias("p"))
    return x.select("k", "p.prompt", "p.used", F.col("p.n_demos").cast("long").alias("n_demos"))


# --- files: written from the tables, then read as a user's files are


def _written(spark, df, name: str) -> str:
    """The folder of df's one text column, written as lines."""
    path = f"{shared_folder(spark)}/{name}"
    df.write.mode("overwrite").text(path)
    return path


_FUNCTION = "case when p_partkey % 13 = 0 then 'bad;row' when p_partkey % 17 = 0 then concat('./F', cast(p_partkey % 20 as string), '_ext.sol;C.h();x;40') else concat('./F', cast(p_partkey % 20 as string), '_ext.sol;C.f', cast(p_partkey as string), '(uint256);', cast(p_partkey % 50 * 10 as string), ';', cast(p_partkey % 50 * 10 + 9 as string)) end"
_FINDING = "concat('F', cast(event_id % 20 as string), '_ext.sol ', case event_id % 4 when 0 then 'ARTHM' when 1 then 'UE' when 2 then 'DOS' else 'LE' end, ' ', cast(event_id % 500 as string), ' tool', cast(event_id % 3 as string))"


@query("""with r as (select 'F' || p_partkey % 20 || '_ext.sol' file, 'C.f' || p_partkey || '(uint256)' signature, p_partkey % 50 * 10 s, p_partkey % 50 * 10 + 9 e from part where p_partkey % 13 <> 0 and p_partkey % 17 <> 0),
f as (select 'F' || event_id % 20 || '_ext.sol' file, case event_id % 4 when 0 then 'arithmetic' when 1 then 'unchecked_low_level_calls' else 'denial_of_service' end category, case event_id % 4 when 0 then 2 else 1 end least, event_id % 500 line, 'tool' || event_id % 3 tool from events where event_id % 4 <> 3),
v as (select file, category, line, list(distinct tool) tools from f group by file, category, line, least having count(distinct tool) >= least)
select file, signature, category, array_to_string(list_sort(list(distinct line)), ',') lines, array_to_string(list_sort(list_distinct(flatten(list(tools)))), ',') tools from r join v using (file) where line between s and e group by 1, 2, 3""")
def voted_functions(spark, d):
    ranges = readers.function_ranges(spark, _written(spark, table(spark, d, "part").select(F.expr(_FUNCTION)), "functions.txt"))
    found = readers.findings(spark, _written(spark, table(spark, d, "events").select(F.expr(_FINDING)), "findings.txt"))
    out = readers.voted_functions(ranges, found)
    return out.select("file", "signature", "category", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("tools", ",").alias("tools"))


_LOG = "case when p_partkey % 10 = 0 then 'loc,length,bug type' when p_partkey % 10 = 1 then 'x,1,bad' else concat(cast(p_partkey as string), ',', cast(p_size as string), ', Re-entrancy') end"


@query("select p_partkey::int as start, p_partkey::int + p_size::int - 1 as \"end\", 'reentrancy' kind from part where p_partkey % 10 > 1")
def injected_bugs(spark, d):
    from ..functions.taxonomy import injected_type

    logs = readers.bug_logs(spark, _written(spark, table(spark, d, "part").select(F.expr(_LOG)), "BugLog_1.csv"), "*")
    return logs.select("start", "end", injected_type(F.col("kind")).alias("kind"))


_LINE = """case when event_id % 9 = 0 then '{"id": broken' else concat('{"id": "fix_', cast(event_id as string), '", "output": ', case when event_id % 4 = 0 then '" "' else '"out"' end, ', "instruction": "i", "input": "', case when event_id % 2 = 0 then '- Type: A, B\\\\n**Source Code:**\\\\ncode' else 'plain' end, '"}') end"""


@query(f"""select event_id, case when event_id % 2 = 0 then 'code' else 'plain' end code, 'out' fixed_code, case when event_id % 2 = 0 then 'A' else 'unknown' end vulnerability_type, {json.dumps(1)} n from events where event_id % 9 <> 0 and event_id % 4 <> 0""")
def retrieval_documents(spark, d):
    from ..operators.candidates import function_id

    path = _written(spark, table(spark, d, "events").select(F.expr(_LINE)), "corpus.jsonl")
    return readers.retrieval_corpus(spark, path).select(function_id(F.col("id")).alias("event_id"), "code", "fixed_code", "vulnerability_type", F.lit(1).alias("n"))


@query("select count(*) filter (where event_id % 9 <> 0) good, count(*) lines, count(*) filter (where event_id % 9 <> 0) again from events")
def json_line_counts(spark, d):
    path = _written(spark, table(spark, d, "events").select(F.expr(_LINE)), "lines.jsonl")
    good, lines = readers.json_lines(spark, path, "id string"), readers.json_lines_counted(spark, path, "id string")
    strict = _written(spark, good.select(F.to_json(F.struct("id"))), "good.jsonl")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(good.where("id is not null"), "good").crossJoin(count(lines, "lines")).crossJoin(count(readers.json_lines(spark, strict, "id string", strict=True), "again"))


@query("select case when doc_id % 3 = 0 then 'val' else 'train' end split, lang, count(*) n from documents group by 1, 2")
def written_splits(spark, d):
    base = shared_folder(spark)
    x = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("split"))
    sinks.write_splits(x, f"{base}/splits")
    sinks.write_csv(spark.read.json(f"{base}/splits"), f"{base}/csv", ["split"])
    sinks.append_log(spark.read.option("header", True).csv(f"{base}/csv"), f"{base}/log")
    return spark.read.json(f"{base}/log").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("""with x as (select p_partkey k, p_brand b, p_size, case when p_partkey % 3 = 0 then ['REENTRANCY'] when p_partkey % 3 = 1 then ['ARITHMETIC', 'TIMESTAMP_DEPENDENCE'] else [p_brand] end ts, case when p_partkey % 4 = 0 then null else p_size % 3 end s from part),
y as (select *, array_to_string(ts, ', ') t, case when s is null then '' else chr(10) || '- Severity: ' || s end sev from x)
select k, '### Vulnerability Info' || chr(10) || '- Type: ' || t || sev || chr(10) || chr(10) || '### Source Code' || chr(10) || 'code' short, md5('The following Solidity function has been identified with security vulnerabilities: ' || chr(10) || chr(10) || '**Function:** f' || k || chr(10) || chr(10) || '**Vulnerability Info:**' || chr(10) || '- Type: ' || t || sev || chr(10) || chr(10) || '**Source Code:**' || chr(10) || 'code' || 'Please provide the complete fixed version of this code that addresses the identified vulnerabilities. ' || chr(10) || 'Output ONLY the corrected Solidity function code in a code block not the entire contract.') h,
'fix_' || k id, case when k % 5 = 0 then '### Analysis' || chr(10) || 'why' else '' end || chr(10) || chr(10) || '### Fixed Code' || chr(10) || 'x' output, 'user: a' || chr(10) || chr(10) || 'assistant: ' || k plain from y""")
def repair_prompts(spark, d):
    from ..functions import prompts as P

    k = F.col("p_partkey")
    own = F.when(k % 3 == 1, F.array(F.lit("foo")))  # its identifiers decide
    audit = F.when(k % 3 == 0, F.array(F.lit("reentrancy"))).otherwise(F.array(F.col("p_brand")))
    ids = F.when(k % 3 == 1, F.array(F.lit("SWC-101"), F.lit("SWC-116")))
    x = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("f"), k.cast("string")).alias("f"), P.export_types(own, audit, ids).alias("t"), F.when(k % 4 != 0, F.col("p_size") % 3).alias("s"))
    code = F.lit("code")
    made = P.triple(F.col("k"), F.lit("do"), F.lit("in"), F.lit("x"), F.when(F.col("k") % 5 == 0, "why"))
    talk = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in (("user", F.lit("a")), ("assistant", F.col("k").cast("string")))))
    return x.select("k", P.repair_input(F.col("t"), F.col("s"), code).alias("short"), F.md5(P.repair_prompt(F.col("f"), F.col("t"), F.col("s"), code)).alias("h"), made["id"].alias("id"), made["output"].alias("output"), P.chat(talk, plain=True).alias("plain"))


@query("""with x as (select p_partkey, case p_partkey % 3 when 0 then 'success' when 1 then 'failed_compile' else 'failed_tool' end status, 'F_' || lower(replace(replace(p_type, ' ', '_'), '-', '_')) nm, p_size from part), n as (select *, row_number() over (partition by nm order by p_partkey) - 1 r from x where status <> 'success'), t as (select nm, count(*) rows_ from n group by 1)
select status, case when r = 0 then nm else nm || '_' || r end record, p_partkey, p_size::bigint as num_functions, '# ' || rows_ page, status mapped, '{"fix":{}}' as value from n join t using (nm)""")
def written_records(spark, d):
    base = shared_folder(spark)
    status = F.element_at(F.array(*map(F.lit, ("success", "failed_compile", "failed_tool"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    x = table(spark, d, "part").select("p_partkey", status.alias("status"), F.concat(F.lit("F_"), F.regexp_replace(F.lower("p_type"), r"[-\s]", "_")).alias("nm"), "p_size")
    failed = x.where("status <> 'success'")
    sinks.write_records(x.withColumn("record", F.when(F.col("status") != "success", F.col("nm"))), f"{base}/records", "status", "failed", slim=["p_partkey", "record"])
    got = spark.read.json(f"{base}/records").withColumnRenamed("record", "nm").withColumn("record", sinks.numbered(F.col("nm"), F.col("p_partkey")))
    sinks.write_contracts(x.select("p_partkey", F.array_repeat(F.lit("f"), F.col("p_size")).alias("functions")), f"{base}/contracts")
    sizes = spark.read.json(f"{base}/contracts").select("p_partkey", "num_functions")
    pages = failed.groupBy(F.col("nm").alias("name")).agg(F.concat(F.lit("# "), F.count("*").cast("string")).alias("page"))
    sinks.write_pages(pages, f"{base}/pages")
    pages = spark.read.text(f"{base}/pages").select(F.col("name").alias("nm"), F.col("value").alias("page"))
    sinks.write_sidecar(failed, f"{base}/sidecar", "p_partkey", "nm", F.col("status"))
    side = spark.read.json(f"{base}/sidecar").select(F.col("id").alias("p_partkey"), "mapped")
    sinks.rewrite_tree(spark, _written(spark, spark.sql("""select '{"fix":{"a":null}}' v"""), "tree"), f"{base}/bare", "part-*")
    bare = spark.read.json(f"{base}/bare").select(F.trim("value").alias("value"))
    return got.join(sizes, "p_partkey").join(pages, "nm").join(side, "p_partkey").crossJoin(F.broadcast(bare)).select("status", "record", "p_partkey", "num_functions", "page", "mapped", "value")
