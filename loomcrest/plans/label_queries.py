"""Queries on findings, labels and taxonomies. Events stand for findings, parts for labelled functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import audit, candidates, labels
from ..session import table
from .registry import query

_CHECKS = ["reentrancy-eth", "weak-prng", "timestamp", "own-check", "unused-return", "tx-origin", "erc20-indexed", "pragma", "naming-convention", "another-check"]
_CHECK = f"element_at(array({', '.join(repr(c) for c in _CHECKS)}), cast(event_id % 10 as int) + 1)"
_TYPES = {d: c for c, ds in labels.DETECTORS.items() for d in ds if d in _CHECKS}
_CHECK_SQL = f"{_CHECKS}[event_id % 10 + 1]"
_TYPE_SQL = "case c " + " ".join(f"when '{d}' then '{t}'" for d, t in _TYPES.items()) + " else c end"
_IMPACT = "case event_type when 'error' then 'High' when 'purchase' then 'Medium' when 'click' then 'Low' when 'view' then 'Informational' else 'Other' end"


@query(f"""with x as (select user_id % 50 con, event_id % 7 fn, event_id, {_CHECK_SQL} c, {_IMPACT} sev, event_id % 5 k from events),
e as (select 'C' || con || '.f' || fn f, event_id, {_TYPE_SQL} t, sev from x where k < 3 union all select 'C' || con || '.g', event_id, {_TYPE_SQL}, sev from x where k = 0)
select f "function", array_to_string(list_sort(list(distinct t)), ',') types, count(*)::int n_findings, arg_min(sev, event_id) first_severity from e group by 1""")
def findings_to_functions(spark, d):
    element = lambda kind, name, contract, inner: F.struct(F.lit(kind).alias("type"), name.alias("name"), F.struct(F.struct(F.lit("contract").alias("type"), contract.alias("name")).alias("parent")).alias("type_specific_fields"), F.struct(F.struct(inner.alias("name")).alias("parent_function")).alias("source_mapping"))
    none = F.lit(None).cast("string")
    con, fn, k = F.concat(F.lit("C"), (F.col("user_id") % 50).cast("string")), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")), F.col("event_id") % 5
    # a function, a node inside it, and, for each fifth event, another function; a pragma has no function
    first = F.when(k < 2, element("function", fn, con, none)).when(k == 2, element("node", F.lit("expr"), con, fn)).otherwise(element("pragma", fn, con, none))
    elements = F.when(k == 0, F.array(first, first, element("function", F.lit("g"), con, none))).otherwise(F.array(first))
    x = table(spark, d, "events").select("event_id", F.expr(_CHECK).alias("check"), F.expr(_IMPACT).alias("impact"), F.lit("d").alias("description"), elements.alias("elements"))
    got = labels.findings_by_function(x, "event_id")
    return got.select("function", F.array_join("types", ",").alias("types"), "n_findings", F.col("findings")[0]["severity"].alias("first_severity"))


@query("""with x as (select p_size % 25 c, case when p_size % 25 = 3 then null when p_partkey % 3 = 0 then true else false end v from part)
select count(distinct c) total_contracts, count(distinct case when v is not null then c end) processed_contracts, count(v) total_functions, count(*) filter (where v) vulnerable_functions, count(*) filter (where not v) safe_functions, count(distinct c) - count(distinct case when v is not null then c end) failed_contracts, round(count(*) filter (where v) * 100::double / greatest(count(v), 1), 6) vulnerable_percent from x""")
def labeler_statistics(spark, d):
    x = table(spark, d, "part").select((F.col("p_size") % 25).alias("contract"), F.when(F.col("p_size") % 25 == 3, None).otherwise(F.col("p_partkey") % 3 == 0).alias("is_vulnerable"))
    return labels.labeler_statistics(x).withColumn("vulnerable_percent", F.round("vulnerable_percent", 6))


@query("""with x as (select p_type t, p_brand b, p_partkey % 3 = 0 v from part where p_partkey % 3 = 0), n as (select greatest(count(*), 1) n from x), e as (select t from x union all select b from x)
select t as type, count(*) n, round(count(*) * 100::double / any_value(n.n), 6) percent from e, n group by 1""")
def type_distribution(spark, d):
    x = table(spark, d, "part").select((F.col("p_partkey") % 3 == 0).alias("is_vulnerable"), F.array("p_type", "p_brand").alias("types"))
    return labels.type_distribution(x, "types").withColumn("percent", F.round("percent", 6))


@query("""with x as (select p_partkey k, p_partkey % 3 = 0 v, case when p_partkey % 2 = 0 then ['Dos', 'dos ', ' ', p_brand] else [] end own, case when p_partkey % 5 <> 1 then ['reentrancy'] else [] end det, case p_partkey % 4 when 0 then '7.5' when 1 then 'n/a' end s, p_size % 4 sev, p_partkey % 7 = 0 f, p_partkey % 9 = 0 said from part),
t as (select *, case when len(list_filter(own, lambda y: trim(y) <> '')) > 0 then list_filter(own, lambda y: trim(y) <> '') else det end ts from x),
u as (select *, array_to_string(case when len(ts) = 0 then ['unknown'] else ts end, ', ') listed from t)
select k, v vulnerable, case when v then array_to_string(ts, '|') end types, case when v then coalesce(try_cast(s as double), case sev when 0 then 9.0 when 1 then 6.0 when 2 then 3.0 else 0.0 end) end severity,
case when v then case when said then 'told' else 'Ground-truth label indicates this function is vulnerable. Vulnerability types: ' || listed || '. ' || case when f then 'Slither also flagged issues.' else 'Slither did not flag issues (may be false-negative).' end end end analysis,
case when v then case when len(det) = 0 then '' else '## Vulnerable Code Details (Ground Truth)' || chr(10) || chr(10) || '**Vulnerability 1** (Category: reentrancy)' || chr(10) || 'Lines: [11]' || chr(10) || chr(10) || '```solidity' || chr(10) || '// Line 10: a;' || chr(10) || '// Line 11 (VULNERABLE): b;' || chr(10) || '// Line 12: c;' || chr(10) || '```' end end details,
case when v then '## Slither Analysis (Reference)' || chr(10) || case when f then 'Slither found these issues:' || chr(10) || '1. **T** (Severity: ' || ['High', 'Medium', 'Low', 'x'][sev + 1] || ')' || chr(10) || '   No description' || chr(10) || chr(10) || 'Note: Slither can have false positives. Verify each issue independently.' else 'Slither found no critical vulnerabilities. But check carefully - it can miss issues.' end end section from u""")
def label_annotations(spark, d):
    k = F.col("p_partkey")
    detail = F.struct(F.lit(None).cast("string").alias("type"), F.lit("reentrancy").alias("category"), F.array(F.lit(11)).alias("lines"))
    found = F.array(F.struct(F.lit("T").alias("type"), F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low", "x"))), (F.col("p_size") % 4 + 1).cast("int")).alias("severity"), F.lit(None).cast("string").alias("description")))
    details = F.when(k % 5 != 1, F.array(detail)).otherwise(F.array().cast("array<struct<type:string,category:string,lines:array<int>>>"))
    types = F.when(k % 2 == 0, F.array(F.lit("Dos"), F.lit("dos "), F.lit(" "), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    severity = F.when(k % 4 == 0, "7.5").when(k % 4 == 1, "n/a")
    made = labels.annotation_of_label(k % 3 == 0, types, details, severity, F.when(k % 9 == 0, " told "), k % 7 == 0, found, F.lit("a;\nb;\nc;"), F.lit(10))
    x = table(spark, d, "part").select(k.alias("k"), (k % 3 == 0).alias("vulnerable"), made.alias("a"))
    return x.select("k", "vulnerable", F.array_join("a.vulnerability_types", "|").alias("types"), "a.severity", "a.analysis", F.col("a.code_details").alias("details"), F.col("a.tool_section").alias("section"))


_PHRASES = ["Re-Entrancy", "reentrancy attack", "integer_overflow", "auth bypass", "unsafe math", "external call to x", "tx_origin", "front-running", "nothing", "block variable use", "replay attack", "TOD", "forced ether", "hash-collision", "Unchecked return", "gas_limit", "storage collision", "Delegatecall", "uninitialized init", "weak randomness", "time manipulation", "gas grief"]
_CANONICAL = {"Re-Entrancy": None, "reentrancy attack": "REENTRANCY", "integer_overflow": "ARITHMETIC", "auth bypass": "ACCESS_CONTROL", "unsafe math": "ARITHMETIC", "external call to x": "UNCHECKED_CALL", "tx_origin": "TX_ORIGIN", "front-running": "FRONT_RUNNING", "nothing": None, "block variable use": "TIMESTAMP_DEPENDENCE", "replay attack": None, "TOD": "FRONT_RUNNING", "forced ether": None, "hash-collision": None, "Unchecked return": "UNCHECKED_CALL", "gas_limit": "DOS", "storage collision": "STORAGE_CORRUPTION", "Delegatecall": "DELEGATECALL", "uninitialized init": "UNINITIALIZED_STORAGE", "weak randomness": "BAD_RANDOMNESS", "time manipulation": "TIMESTAMP_DEPENDENCE", "gas grief": "DOS"}
_LOOSE = {"reentrancy attack": [107], "integer_overflow": [101], "tx_origin": [115], "block variable use": [116], "replay attack": [121], "TOD": [114], "hash-collision": [133], "Unchecked return": [104], "gas_limit": [128], "storage collision": [124], "Delegatecall": [112], "weak randomness": [120], "time manipulation": [116], "gas grief": [126], "front-running": [114]}
_BUCKET = {"REENTRANCY": ["reentrancy attack"], "ACCESS_CONTROL": [], "UNCHECKED_CALL": ["Unchecked return"], "ARITHMETIC": ["integer_overflow", "unsafe math"], "BAD_RANDOMNESS": ["weak randomness"], "TIMESTAMP_DEPENDENCE": ["block variable use", "time manipulation"], "DOS": ["gas_limit", "gas grief"], "STORAGE": ["storage collision"]}


def _case(values: dict, c: str = "t", default: str = "null") -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items() if v) + f" else {default} end"


@query(f"""with x as (select p_partkey, {_PHRASES}[p_partkey % {len(_PHRASES)} + 1] t from part)
select p_partkey, {_case(_CANONICAL)} canonical, {_case({k: ",".join(f"SWC-{n}" for n in ns) for k, ns in _LOOSE.items()}, default="''")} loose, {_case({k: taxonomy.SWC_TITLES[ns[0]] for k, ns in _LOOSE.items() if ns})} title,
{_case({p: b for b, ps in _BUCKET.items() for p in ps}, default="'OTHER'")} bucket from x""")
def phrase_classes(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % len(_PHRASES) + 1).cast("int"))
    x = table(spark, d, "part").select("p_partkey", phrase.alias("t"))
    t = F.col("t")
    return x.select("p_partkey", taxonomy.canonical_type(t).alias("canonical"), F.array_join(taxonomy.swc_loose(t), ",").alias("loose"), taxonomy.swc_title(F.get(taxonomy.swc_loose(t), F.lit(0))).alias("title"), taxonomy.primary_bucket(taxonomy.buckets(F.array(t), keep_original=False)).alias("bucket"))


_KINDS = ["Access Control", "tx-origin", "unchecked_call_x", "DOS attack", "zzz", "code quality", "Reentrancy-eth", "gas_optimization"]
_WORDS = ["High", "Medium", "Low", "Informational", "high", "none"]
_ADJUST = {"Access Control": 1, "tx-origin": 0, "unchecked_call_x": 0, "DOS attack": 0, "zzz": 0, "code quality": -2, "Reentrancy-eth": 1, "gas_optimization": -2}
_ESTIMATE = {"Access Control": 8, "tx-origin": 7, "unchecked_call_x": 6, "DOS attack": 6, "zzz": 5, "code quality": 5, "Reentrancy-eth": 9, "gas_optimization": 5}
_REASON = {"Access Control": "access_control", "tx-origin": "tx_origin", "unchecked_call_x": "unchecked_call", "Reentrancy-eth": "reentrancy"}


@query(f"""with x as (select p_partkey, {_KINDS}[p_partkey % 8 + 1] t, {_WORDS}[p_size % 6 + 1] w from part)
select p_partkey, greatest(0, least(10, case w when 'High' then 9 when 'Medium' then 6 when 'Low' then 3 when 'Informational' then 1 else 5 end + case t {" ".join(f"when '{k}' then {v}" for k, v in _ADJUST.items())} end))::double score, case t {" ".join(f"when '{k}' then {v}" for k, v in _ESTIMATE.items())} end estimate,
case t {" ".join(f"when '{k}' then '{taxonomy.REASONS[v]}'" for k, v in _REASON.items())} else 'The function contains a ' || t || ' vulnerability.' end reason, case t when 'tx-origin' then 'x' end missing from x""")
def severity_scores(spark, d):
    t = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    w = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_size") % 6 + 1).cast("int"))
    x = table(spark, d, "part").select("p_partkey", t.alias("t"), w.alias("w"))
    return x.select("p_partkey", taxonomy.severity_score(F.col("w"), F.col("t")).alias("score"), taxonomy.severity_estimate(F.col("t")).alias("estimate"), taxonomy.reason(F.col("t")).alias("reason"), F.when(F.col("t") == "tx-origin", "x").alias("missing"))


@query("""with x as (select user_id, event_id, case event_type when 'error' then 'High' when 'purchase' then 'Medium' when 'click' then 'Low' when 'view' then 'Informational' else 'Other' end severity, case event_type when 'error' then 4 when 'purchase' then 3 when 'click' then 2 when 'view' then 1 else 2 end r from events), y as (select *, row_number() over (partition by user_id order by r desc, event_id) n from x) select user_id, event_id, severity from y where n = 1""")
def most_severe(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.expr(_IMPACT).alias("severity"))
    top = x.groupBy("user_id").agg(taxonomy.most_severe_row(F.struct("event_id", "severity"), F.col("severity"), F.col("event_id")).alias("m"))
    return top.select("user_id", "m.event_id", "m.severity")


_FIXED = "case p_partkey % 7 when 0 then 'if (TX.origin == a) b;' when 1 then 'function f() { revert (); }' when 2 then 'selfdestruct(a); throw;' when 3 then 'rethrows(a).call.value(1)' when 4 then ' ' when 5 then 'require(false, x)' else repeat('a', 60) end"
_ORIGINAL = "case when p_partkey % 2 = 0 then repeat('a', 100) when p_partkey % 3 = 0 then '  ' else 'short' end"


@query(rf"""with x as (select p_partkey, {_ORIGINAL} o, lower({_FIXED}) f from part)
select p_partkey, array_to_string(list_filter([case when contains(f, 'tx.origin') then 'uses_tx_origin' end, case when contains(f, 'selfdestruct') then 'selfdestruct' end, case when regexp_matches(f, '\brevert\s*\(') or regexp_matches(f, '\bthrow\b') or contains(f, 'require(false') then 'may_disable_functionality' end,
case when length(trim(o)) > 0 and (length(trim(f)) + 1) / (length(trim(o)) + 1)::double < 0.5 then 'much_shorter_than_original' end, case when contains(f, '.call.value') or contains(f, 'call{{value') then 'uses_low_level_call_value' end], lambda y: y is not null), ',') flags from x""")
def suspicious_repairs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(audit.suspicious(F.expr(_ORIGINAL), F.expr(_FIXED)), ",").alias("flags"))


_AUDIT = """case p_partkey % 8 when 0 then null when 1 then 'null' when 2 then '{}' when 3 then '{"label":"vulnerable","severity":7,"vulnerability_types":["Re-Entrancy"]}' when 4 then '{"label":"safe"}' when 5 then '{"label":"vulnerable","severity":2,"vulnerability_types":["front running"]}' when 6 then '{"note":1}' else '{"label":"vulnerable","vulnerability_types":[]}' end"""


@query(f"""with x as (select p_partkey, p_partkey % 8 k, p_partkey % 3 = 0 fb, p_size from part)
select p_partkey, case when k in (0, 1, 2) then case when fb then 'processed' else 'no_annotation' end when k in (3, 5, 7) then 'processed' else 'safe' end as way, k in (3, 5, 7) and p_size > 10 fix_any, k = 3 and p_size > 10 severe, k in (3, 5) and p_size > 10 typed, k = 1 and p_size % 2 = 0 annotate from x""")
def audit_routes(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.expr(_AUDIT).alias("llm_audit"), F.lit(None).cast("string").alias("fallback"), F.lit("{}").alias("slither_result"), (F.col("p_size") % 2 == 0).alias("is_vulnerable"))
    done = x.where("p_size <= 10").select("id")
    kept = lambda name, df: df.select("id", F.lit(True).alias(name))
    out = x.select("id", candidates.route(F.col("llm_audit"), F.get_json_object("llm_audit", "$.label"), F.when(F.col("id") % 3 == 0, "made")).alias("way"))
    for name, rows in {"fix_any": candidates.to_fix(x, done), "severe": candidates.to_fix(x, done, least_severity=5), "typed": candidates.to_fix(x, done, types=["re entrancy", "TimeO"]), "annotate": candidates.to_annotate(x)}.items():
        out = out.join(kept(name, rows), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumnRenamed("id", "p_partkey")


_LISTS = """case p_partkey % 9 when 0 then null when 1 then '[]' when 2 then '[{"code":"a"},{"code":""}]' when 3 then '["m",{"name":"n"}]' when 4 then '{"a":1}' when 5 then '{x' when 6 then '[1,2]' when 7 then 'null' else '[{"code":"a"},null]' end"""
_CONTEXT = """case p_size % 6 when 0 then null when 1 then '[1]' when 2 then '{"modifiers":["m",{"name":"n"}]}' when 3 then '{"state_variables":{"a":1},"structures":[{"code":"s"}]}' when 4 then '{bad' else '{"modifiers":null}' end"""


@query("""with x as (select p_partkey, p_partkey % 9 l, p_size % 6 c from part),
i as (select p_partkey, unnest(list_concat(case when l = 5 then ['called_functions.malformed_json'] else [] end, case when c = 4 then ['contract_context.malformed_json'] else [] end,
case when c in (1, 4) then ['contract_context.type'] else list_concat(case c when 2 then ['contract_context.modifiers.mixed_types', 'contract_context.modifiers.non_object_elems', 'contract_context.modifiers.missing_keys'] when 3 then ['contract_context.state_variables.type'] else [] end,
case l when 2 then ['called_functions.missing_keys'] when 3 then ['called_functions.mixed_types', 'called_functions.non_object_elems', 'called_functions.missing_keys'] when 4 then ['called_functions.type'] when 5 then ['called_functions.type'] when 6 then ['called_functions.non_object_elems'] when 8 then ['called_functions.mixed_types', 'called_functions.non_object_elems'] else [] end) end)) issue_type from x) select * from i""")
def row_audit(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_CONTEXT).alias("contract_context"), F.expr(_LISTS).alias("called_functions"))
    return audit.row_issues(x, "p_partkey")
