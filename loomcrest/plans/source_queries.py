"""Queries on source text. parts stand for contracts: their text is put together from numbers, in a way that Spark and the SQL share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import source
from ..session import spread, table
from .registry import query

#: a pragma of some form, then some of the snippets
_PRAGMA = "concat('pragma solidity ', case p_partkey % 7 when 0 then '^' when 1 then '>=' when 2 then '' when 3 then '>' when 4 then '~' when 5 then '>= 0.4.0 || ^' else '<0.9.0 >' end, '0.', cast(4 + p_size % 5 as string), case when p_partkey % 11 = 0 then '' else concat('.', cast(p_partkey % 27 as string)) end, ';')"
_SNIPPETS = [(2, "emit E("), (3, "for ("), (5, "if (a) {"), (7, "constructor ("), (9, "revert('no')"), (4, "x = 1;"), (6, "require(true);"), (8, "tx.origin"), (10, "a.delegatecall(b)"), (11, "a.transfer(1)"), (12, "a.send(2)"), (13, "payable"), (14, "view"), (15, "pure"), (16, "internal"), (17, "private"), (18, "external"), (19, "Reentrancy"), (20, "onlyOwner"), (21, "blockhash"), (22, "overflow")]
_BODY = "concat(" + ", ".join(f"case when p_partkey % {n} = 1 then concat(chr(10), '{t}') else '' end".replace("'no'", "''no''") for n, t in _SNIPPETS) + ")"
_SRC = f"concat({_PRAGMA}, {_BODY})"


def _sources(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_SRC).alias("src"), F.expr(_BODY).alias("body"), "p_size")


def _version(mark: str, more: int = 0) -> str:
    got = lambda i: rf"regexp_extract(spec, '{mark}(\d+)\.(\d+)(?:\.(\d+))?', {i})"
    return f"(case when {got(0)} <> '' then {got(1)} || '.' || {got(2)} || '.' || cast(coalesce(try_cast({got(3)} as int), 0) + {more} as varchar) end)"


def _key(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda x: x::int)"


@query(rf"""with p as (select p_partkey, {_SRC} src from part), s as (select *, regexp_extract(src, 'pragma\s+solidity\s+([^;]+);', 1) spec from p),
v as (select p_partkey, coalesce(nullif(regexp_extract(src, 'pragma\s+solidity\s+\^?([0-9]+\.[0-9]+\.[0-9]+)', 1), ''), nullif(regexp_extract(src, 'pragma\s+solidity\s+>=?([0-9]+\.[0-9]+\.[0-9]+)', 1), ''), '0.4.25') simple,
case when contains(spec, '^') or contains(spec, '~') then {_version("")} when contains(spec, '>=') then coalesce({_version(">= *")}, {_version("")}) when contains(spec, '>') then coalesce({_version("> *", 1)}, {_version("")}) else {_version("")} end as "full",
case when regexp_matches(src, '\bconstructor\s*\(') or regexp_matches(src, '\brevert\s*\(["'']') then '0.4.22' when regexp_matches(src, '\bemit\s+\w+\s*\(') then '0.4.21' when regexp_matches(src, '\b(pure|view)\b') then '0.4.16' else '0.4.11' end minimum from s)
select *, case when {_key('coalesce("full", \'0.4.11\')')} >= {_key("minimum")} then coalesce("full", '0.4.11') else minimum end recommended from v""")
def source_versions(spark, d):
    src = F.col("src")
    return _sources(spark, d).select("p_partkey", source.pragma_version(src).alias("simple"), source.pragma_full(src).alias("full"), source.minimum_version(src).alias("minimum"), source.recommended_version(src).alias("recommended"))


_HAVE = ["0.4.11", "0.4.26", "0.5.0", "0.5.17", "v0.6.12", "0.4.5", "0.8.1"]
_WANT = "concat('0.', cast(3 + p_size % 7 as string), '.', cast(p_partkey % 20 as string))"


@query(f"""with w as (select p_partkey, {_WANT} want from part), h as (select i, ltrim(v, 'v') v from (select unnest({_HAVE}) v, generate_subscripts({_HAVE}, 1) i)),
x as (select p_partkey, want, v, i, split_part(v, '.', 1) = split_part(want, '.', 1) and split_part(v, '.', 2) = split_part(want, '.', 2) same, abs(split_part(v, '.', 2)::int - split_part(want, '.', 2)::int) * 100 + abs(split_part(v, '.', 3)::int - split_part(want, '.', 3)::int) dist, {_key("v")} >= [0, 4, 11] able from w, h)
select p_partkey, want, case when {_key("want")} < [0, 4, 11] then '0.4.11' else coalesce(max(case when v = want then v end), arg_min(v, i) filter (where same), arg_min(v, dist * 100 + i) filter (where able), '0.4.11') end found from x group by p_partkey, want""")
def closest_versions(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_WANT).alias("want"))
    return x.withColumn("found", source.closest_version(F.col("want"), F.array(*map(F.lit, _HAVE))))


_FLAGS_SQL = r"""regexp_matches(t, '\b(for|while)\s*\(') has_loops, regexp_matches(t, '\bif\s*\(') has_if_statements, length(t) - length(replace(t, '{', '')) complexity, regexp_matches(t, '\.(call|delegatecall|staticcall)\(') has_external_calls,
regexp_matches(t, '[a-zA-Z_]\w*\s*=') has_state_changes, contains(t, 'require(') has_require, contains(t, 'tx.origin') uses_tx_origin, contains(t, 'delegatecall') uses_delegatecall, contains(t, '.transfer(') uses_transfer, contains(t, '.send(') uses_send, contains(t, 'payable') is_payable, contains(t, 'view') is_view, contains(t, 'pure') is_pure"""


@query(rf"""with p as (select p_partkey, {_BODY} t from part)
select p_partkey, {_FLAGS_SQL}, case when regexp_matches(t, '\bprivate\b') then 'private' when regexp_matches(t, '\binternal\b') then 'internal' when regexp_matches(t, '\bexternal\b') then 'external' else 'public' end visibility,
case when regexp_matches(t, '\bpayable\b') then 'payable' when regexp_matches(t, '\bpure\b') then 'pure' when regexp_matches(t, '\bview\b') then 'view' else 'nonpayable' end mutability from p""")
def source_flags(spark, d):
    t = F.col("body")
    return _sources(spark, d).select("p_partkey", source.flags(t).alias("f"), source.visibility(t).alias("visibility"), source.mutability(t).alias("mutability")).select("p_partkey", "f.*", "visibility", "mutability").withColumn("complexity", F.col("complexity").cast("long"))


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(l, '{w}')" for w in words) + ")::int::double"


@query(f"""with p as (select p_partkey, {_BODY} t, lower({_BODY}) l from part)
select p_partkey, round(least(1, length(t) / 6000.0::double), 8) f0, {", ".join(f"{_any(ws)} f{i + 1}" for i, ws in enumerate(source.GATE_WORDS))}, 1.0::double f9 from p""")
def gate_features(spark, d):
    x = _sources(spark, d).select("p_partkey", source.gate_features(F.col("body")).alias("f"))
    return x.select("p_partkey", F.round(F.get("f", F.lit(0)), 8).alias("f0"), *(F.get("f", F.lit(i)).alias(f"f{i}") for i in range(1, 10)))


_PLACE = "concat('found in a.sol', case p_partkey % 3 when 0 then ':' when 1 then '#' else ' ' end, cast(p_size as string), case p_partkey % 4 when 0 then concat('-', cast(p_size as string)) when 1 then concat('-', cast(p_size + 5 as string)) else '' end, ' and b.sol:1-2')"


@query(rf"""with p as (select p_partkey, {_PLACE} t from part), m as (select p_partkey, regexp_extract(t, '\.sol[:#](\d+)(?:-(\d+))?', 1) a, regexp_extract(t, '\.sol[:#](\d+)(?:-(\d+))?', 2) b from p)
select p_partkey, case when a = '' then 'Function body' when b <> '' and b <> a then 'Lines ' || a || '-' || b else 'Line ' || a end place from m""")
def locations(spark, d):
    return table(spark, d, "part").select("p_partkey", source.location(F.expr(_PLACE)).alias("place"))


@query("""with x as (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) + 9 n, doc_id % 5 + 10 a, doc_id % 9 + 11 b, len(string_split(text, chr(10))) + 9 last from documents),
m as (select *, list_filter([a, b], lambda i: i <= last) marks from x),
k as (select doc_id, n, '// Line ' || n || case when list_contains(marks, n) then ' (VULNERABLE)' else '' end || ': ' || s l from m where n between list_min(marks) - 1 and list_max(marks) + 1)
select doc_id, md5(coalesce(string_agg(l, chr(10) order by n), '')) h, count(l) n from (select doc_id from documents) left join k using (doc_id) group by 1""")
def line_snippets(spark, d):
    marks = F.array((F.col("doc_id") % 5 + 10).cast("int"), (F.col("doc_id") % 9 + 11).cast("int"))
    shown = source.snippet(F.coalesce("text", F.lit("")), F.lit(10), marks)
    x = table(spark, d, "documents").select("doc_id", shown.alias("t"))
    return x.select("doc_id", F.md5("t").alias("h"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n// Line "))).cast("long").alias("n"))


#: two functions and a name that occurs before a header; braces nest and stand in strings and comments
_F = "cast(p_partkey as string)"
_ONE = f"concat('function f', {_F}, '(uint a) external payable {{ if (a > ', {_F}, ') {{ g', {_F}, '(a); }} }}')"
_TWO = f"concat('function g', {_F}, '(uint a) internal view {{ b = ', {_F}, '; }}')"
_CODE = f"concat('contract C', {_F}, ' is A, B', {_F}, ' {{ uint x; address owner ; modifier only', {_F}, '() {{ _; }} ', {_ONE}, chr(10), {_TWO}, ' }}')"


@query(f"""select p_partkey, 'f' || {_F} || ',g' || {_F} "names", md5({_ONE}) one, md5({_TWO}) two, position('function f' in {_CODE}) - 1 starts, 'external,internal' visible, 'payable,view' mutable, {_TWO} "second" from part""")
def function_spans(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_CODE).alias("c"), F.expr(_F).alias("k"))
    x = x.select("p_partkey", source.functions(F.col("c")).alias("f"), source.headers(F.col("c")).alias("h"))
    joined = lambda c, n: F.array_join(F.transform(c, lambda f: f[n]), ",")
    return x.select("p_partkey", joined("f", "name").alias("names"), F.md5(F.col("f")[0]["code"]).alias("one"), F.md5(F.col("f")[1]["code"]).alias("two"), F.col("f")[0]["start"].cast("long").alias("starts"), joined("h", "visibility").alias("visible"), joined("h", "mutability").alias("mutable"), F.col("h")[1]["code"].alias("second"))


@query(rf"""with p as (select p_partkey, {_CODE} c from part)
select p_partkey, regexp_extract(c, 'contract\s+(\w+)', 1) contract_name, array_to_string(list_transform(string_split(regexp_extract(c, 'contract\s+\w+\s+is\s+([^{{]+)', 1), ','), lambda x: trim(x)), '|') bases, array_to_string(regexp_extract_all(c, '(uint|address|bool|string|mapping)\s+(\w+)\s*;', 2), '|') vars, array_to_string(regexp_extract_all(c, '(uint|address|bool|string|mapping)\s+(\w+)\s*;', 1), '|') kinds, array_to_string(regexp_extract_all(c, 'modifier\s+(\w+)', 1), '|') modifiers from p""")
def contract_contexts(spark, d):
    x = table(spark, d, "part").select("p_partkey", source.contract_context(F.expr(_CODE)).alias("c")).select("p_partkey", "c.*")
    named = lambda n: F.array_join(F.transform("state_variables", lambda v: v[n]), "|")
    return x.select("p_partkey", "contract_name", F.array_join("inheritance", "|").alias("bases"), named("name").alias("vars"), named("type").alias("kinds"), F.array_join("modifiers", "|").alias("modifiers"))


@query(f"""with x as (select p_partkey, unnest([1, 2]) k from part)
select p_partkey, 'C' || {_F} contract_name, case k when 1 then 'f' else 'g' end || {_F} as name, case k when 1 then 'external' else 'internal' end visibility, case k when 1 then 'payable' else 'view' end mutability, case k when 1 then 'g' || {_F} else '' end callees, case k when 2 then 'f' || {_F} else '' end callers, k = 1 has_if_statements, k = 2 has_state_changes, case k when 1 then 2 else 1 end complexity from x""")
def function_contexts(spark, d):
    x = source.function_contexts(spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(_CODE).alias("c")), "c", "p_partkey")
    f = lambda n: F.col(f"features.{n}")
    return x.where(source.kept_function(F.col("name"))).select(F.col("file").alias("p_partkey"), "contract_context.contract_name", "name", "visibility", "mutability", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"), f("has_if_statements"), f("has_state_changes"), f("complexity"))


_FIX = f"concat('function g', {_F}, '(uint a) internal view {{ fixed(); }}')"


@query(f"""select p_partkey, replace({_CODE}, {_TWO}, {_FIX}) replaced, {_FIX} || chr(10) by_line, 'function g' || {_F} || '(uint a) internal view {{' || chr(10) || 'y;' || chr(10) || '}}' headed,
'// SPDX-License-Identifier: MIT' || chr(10) || 'pragma solidity ^0.5.0;' || chr(10) || chr(10) || 'contract S {{' || chr(10) || '    ' || {_FIX} || chr(10) || '}}' simple, replace({_CODE}, {_TWO}, {_FIX}) by_text,
'// Context: Contract C, Function g' || chr(10) || chr(10) || '// --- State Variables ---' || chr(10) || 'uint x;' || chr(10) || chr(10) || '// --- Modifiers ---' || chr(10) || '// modifier: only' || chr(10) || chr(10) || '// --- Target Function ---' || chr(10) || {_TWO} sliced, 'uint x;' || chr(10) || 'only' || chr(10) || {_TWO} plain from part""")
def rebuilt_sources(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_CODE).alias("c"), F.expr(_TWO).alias("old"), F.expr(_FIX).alias("fix"), F.concat(F.lit("g"), F.expr(_F)).alias("name"))
    none = F.lit(None).cast("int")
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    return x.select(
        "p_partkey",
        source.with_function(F.col("c"), F.col("name"), F.col("fix")).alias("replaced"),
        source.rebuilt(F.lit("a\nb"), F.lit(1), F.lit(2), F.col("old"), F.col("fix"), F.lit("S"), F.lit("0.5.0")).alias("by_line"),
        source.with_header(F.col("old"), F.lit("y;")).alias("headed"),
        source.rebuilt(F.lit(None).cast("string"), none, none, F.col("old"), F.col("fix"), F.lit("S"), F.lit("0.5.0")).alias("simple"),
        source.rebuilt(F.col("c"), none, none, F.col("old"), F.col("fix"), F.lit("S"), F.lit("0.5.0")).alias("by_text"),
        source.commented_slice(F.lit("C"), F.lit("g"), strings("uint x;"), strings(), strings("only"), strings(), F.col("old")).alias("sliced"),
        source.code_slice(strings("uint x;"), strings(), strings("only"), strings(" "), F.col("old")).alias("plain"),
    )
