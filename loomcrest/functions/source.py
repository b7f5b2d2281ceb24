"""Extraction from source code. Regular parts are Columns; brace matching is not regular and runs as a pandas UDF."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .taxonomy import let
from .text import strip

VERSION = r"(\d+)\.(\d+)(?:\.(\d+))?"
# --- fixed values: what a syntax needs, the floor and the default of versions -------------------------------------------
FEATURES = [(r"(?U)\bemit\s+\w+\s*\(", "0.4.21"), (r"(?U)\b(pure|view)\b", "0.4.16"), (r"(?U)\bconstructor\s*\(", "0.4.22"), (r"(?U)\brevert\s*\([\"']", "0.4.22")]
OLDEST, DEFAULT_VERSION = "0.4.11", "0.4.25"
# ------------------------------------------------------------------------------------------------------------------
_SPAN = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("code", T.StringType())]))


def version_key(v: Column) -> Column:
    """'a.b.c' as an array of integers, which compares as versions do."""
    return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))


def pragma_version(text: Column) -> Column:
    """The three-part version behind '^' or nothing, else behind '>' or '>='; a default without one."""
    tried = [F.regexp_extract(text, rf"pragma\s+solidity\s+{p}([0-9]+\.[0-9]+\.[0-9]+)", 1) for p in (r"\^?", ">=?")]
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in tried), F.lit(DEFAULT_VERSION))


def pragma_full(text: Column) -> Column:
    """A version that the first pragma accepts: its first one, or with '>=' the one behind that, or with '>' alone a patch more; a missing patch is 0; null without one."""
    spec = F.regexp_extract(text, r"pragma\s+solidity\s+([^;]+);", 1)
    has = lambda mark: F.contains(spec, F.lit(mark))

    def version(mark: str, more: int = 0) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(spec, rf"{mark}{VERSION}", i), F.lit(""))
        patch = F.coalesce(part(3).cast("int"), F.lit(0)) + more
        return F.when(part(1).isNotNull(), F.concat_ws(".", part(1), part(2), patch.cast("string")))

    plain = version("")
    return F.when(has("^") | has("~"), plain).when(has(">="), F.coalesce(version(r">=\s*"), plain)).when(has(">"), F.coalesce(version(r">\s*", 1), plain)).otherwise(plain)


def minimum_version(text: Column) -> Column:
    """The least version whose features the text uses."""
    needs = [F.when(text.rlike(p), F.lit(v)).otherwise(F.lit(OLDEST)) for p, v in FEATURES]
    return F.greatest(*(F.struct(version_key(c).alias("k"), c.alias("v")) for c in needs))["v"]


def recommended_version(text: Column) -> Column:
    """The greater of the pragma's version (the floor without one) and the features'."""
    both = (F.coalesce(pragma_full(text), F.lit(OLDEST)), minimum_version(text))
    return F.greatest(*(F.struct(version_key(c).alias("k"), c.alias("v")) for c in both))["v"]


def _first_word(text: Column, words: tuple[str, ...], default: str) -> Column:
    """The first of words that stands in the text."""
    out = F.lit(default)
    for w in reversed(words):
        out = F.when(text.rlike(rf"(?U)\b{w}\b"), w).otherwise(out)
    return out


def visibility(header: Column) -> Column:
    return _first_word(header, ("private", "internal", "external"), "public")


def mutability(header: Column) -> Column:
    return _first_word(header, ("payable", "pure", "view"), "nonpayable")


def flags(text: Column) -> Column:
    """Flags and a count that regular expressions can give."""
    has = lambda w: F.contains(text, F.lit(w))
    tests = {
        "has_loops": text.rlike(r"(?U)\b(for|while)\s*\("),
        "has_if_statements": text.rlike(r"(?U)\bif\s*\("),
        "complexity": F.regexp_count(text, F.lit(r"\{")),
        "has_external_calls": text.rlike(r"\.(call|delegatecall|staticcall)\("),
        "has_state_changes": text.rlike(r"(?U)[a-zA-Z_]\w*\s*="),
        "has_require": has("require("),
        "uses_tx_origin": has("tx.origin"),
        "uses_delegatecall": has("delegatecall"),
        "uses_transfer": has(".transfer("),
        "uses_send": has(".send("),
        "is_payable": has("payable"),
        "is_view": has("view"),
        "is_pure": has("pure"),
    }
    return F.struct(*(x.alias(a) for a, x in tests.items()))


def location(text: Column) -> Column:
    """'Line a', 'Lines a-b' of the first place named, or 'Function body'."""
    m = r"\.sol[:#](\d+)(?:-(\d+))?"
    a, b = (F.nullif(F.regexp_extract(text, m, i), F.lit("")) for i in (1, 2))
    line = F.concat(F.lit("Line "), a)
    return F.when(b.isNotNull() & (a != b), F.concat(F.lit("Lines "), a, F.lit("-"), b)).when(a.isNotNull(), line).otherwise("Function body")


def snippet(code: Column, first_line: Column, marked: Column, around: int = 1) -> Column:
    """The lines from the first marked one to the last, with neighbours at both ends, numbered; marks outside the code don't count, and without any the text is empty."""
    def between(x: Column) -> Column:
        inside = F.filter(x["marked"], lambda m: m.between(first_line, first_line + F.size(x["lines"]) - 1))
        return let(F.struct(x["lines"].alias("lines"), inside.alias("inside"), F.array_min(inside).alias("low"), F.array_max(inside).alias("high")), numbered)

    def numbered(x: Column) -> Column:
        start = F.greatest(F.lit(1), x["low"] - around - first_line + 1)
        near = F.slice(x["lines"], start, F.greatest(F.lit(0), x["high"] + around - first_line + 1 - start + 1))
        line = lambda s, i: F.concat(F.lit("// Line "), (first_line + start - 1 + i).cast("string"), F.when(F.array_contains(x["inside"], first_line + start - 1 + i), " (VULNERABLE)").otherwise(""), F.lit(": "), s)
        return F.when(F.size(x["inside"]) > 0, F.array_join(F.transform(near, line), "\n")).otherwise(F.when(code.isNotNull(), ""))

    return let(F.struct(F.split(code, "\n").alias("lines"), marked.alias("marked")), between)


_LEX = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/|[{};]', re.S)
_HEAD = re.compile(r"\bfunction\s+(\w+)\s*\(")


def function_end(text: str, at: int) -> int | None:
    """The end of the function whose header begins at `at`: its closing brace, or ';' where it has no body. Strings and comments don't count."""
    depth = 0
    for m in _LEX.finditer(text, at):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif c == ";" and not depth:
            return m.end()
    return None


def naive_end(text: str, at: int) -> int | None:
    """As function_end by braces alone, wherever they stand."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return m.end()
    return None


def spans(text: str, naive: bool = False) -> list[tuple[str, int, int, str]]:
    out = []
    for m in _HEAD.finditer(text or ""):
        end = (naive_end if naive else function_end)(text, m.start())
        if end is not None:
            out.append((m[1], m.start(), end, text[m.start() : end]))
    return out


def block_of(text: str, name: str, naive: bool = False) -> str | None:
    """The function of that name; naive: the first whose name begins with it, braces counted anywhere."""
    m = re.search(rf"function\s+{re.escape(name)}" if naive else rf"\bfunction\s+{re.escape(name)}\b", text or "")
    end = m and (naive_end if naive else function_end)(text, m.start())
    return text[m.start() : end] if end else None


_HEADER = re.compile(r"function\s+(\w+)\s*\([^)]*\)[^{]*\{")


def naive_functions(text: str) -> list[dict]:
    """Every header with its text up to the brace that closes it, braces counted wherever they stand."""
    out = []
    for m in _HEADER.finditer(text or ""):
        at = m.start()
        out.append({"name": m[1], "header": m[0], "start": at, "code": text[at : naive_end(text, at) or at]})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("header", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("code", T.StringType())])))
def _naive(text: pd.Series) -> pd.Series:
    return pd.Series([naive_functions(t) for t in text])


@F.pandas_udf(_SPAN)
def _functions(text: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("name", "start", "end", "code"), s, strict=True)) for s in spans(t)] for t in text])


def functions(text: Column) -> Column:
    """array<struct<name, start, end, code>> of all functions."""
    return _functions(text)


# --- fixed values: the words of a gate feature, any of which sets it, in the vector's order ---------------------------------
GATE_WORDS = [
    ["delegatecall", ".call", "call.value"],
    ["tx.origin"],
    [".transfer(", ".send("],
    ["require("],
    ["reentr"],
    ["overflow", "underflow"],
    ["onlyowner", "access control"],
    ["random", "blockhash", "block.timestamp"],
]
# ------------------------------------------------------------------------------------------------------------------


def gate_features(prompt: Column, scale: int = 6000) -> Column:
    """Ten numbers: the scaled length, a flag a group of words (in lower case), a constant."""
    text = F.coalesce(prompt, F.lit(""))
    low = F.lower(text)
    found = [reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)).cast("double") for words in GATE_WORDS]
    return F.array(F.least(F.lit(1.0), F.length(text) / scale), *found, F.lit(1.0))


def code_slice(state: Column, structs: Column, modifiers: Column, callees: Column, target: Column) -> Column:
    """State variables, structs, modifiers and callees (arrays of code) before the target, a line each; empty ones left out."""
    empty = F.array().cast("array<string>")
    parts = F.flatten(F.array(*(F.coalesce(c, empty) for c in (state, structs, modifiers, callees)), F.array(target)))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n")


def commented_slice(contract: Column, name: Column, state: Column, structs: Column, modifiers: Column, callees: Column, target: Column, comments: bool = True) -> Column:
    """code_slice with a blank line behind each kind of part and, with comments, a heading before it; modifiers that are bare names become comments."""
    empty = F.array().cast("array<string>")
    kinds = [("State Variables", state), ("Structures", structs), ("Modifiers", F.transform(modifiers, modifier_code)), ("Helper Functions (Callees)", callees)]
    heading = lambda t: F.array(F.lit(f"// --- {t} ---")) if comments else empty
    parts = [F.array(F.concat(F.lit("// Context: Contract "), contract, F.lit(", Function "), name), F.lit(""))] if comments else []
    for title, codes in kinds:
        some = F.filter(F.coalesce(codes, empty), lambda x: F.coalesce(x, F.lit("")) != "")
        parts.append(F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.concat(heading(title), some, F.array(F.lit("")))).otherwise(empty))
    return F.array_join(F.concat(*parts, heading("Target Function"), F.when(F.coalesce(target, F.lit("")) != "", F.array(target)).otherwise(empty)), "\n")


def simple_contract(body: Column, name: Column, version: Column) -> Column:
    """The body in a contract of its own, indented by four blanks."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(F.lit("    "), x)))
    return F.concat(F.lit("// SPDX-License-Identifier: MIT\npragma solidity ^"), version, F.lit(";\n\ncontract "), name, F.lit(" {\n"), F.array_join(lines, "\n"), F.lit("\n}"))


def replace_function(source: str, name: str, fixed: str) -> str | None:
    """source with the function's text replaced; None where it has no such function."""
    old = block_of(source, name)
    return source.replace(old, fixed, 1) if old else None


def fit_header(original: str, body: str) -> str:
    """A full function stays; a bare body gets the original's header."""
    m = _HEAD.search(body)
    if m:
        return body[m.start() : function_end(body, m.start()) or len(body)]
    head = original[: original.index("{")].rstrip() if "{" in original else original.rstrip()
    inner = body.strip()
    return f"{head} {inner}" if inner.startswith("{") else f"{head} {{\n{inner}\n}}"


def closest_version(want: Column, have: Column) -> Column:
    """Of an array of versions the one to use: the wanted one, else the first of the same major and minor number, else the
    nearest (10000 a major step, 100 a minor one, 1 a patch; the first of equals) not below the floor, else the floor. A
    wanted version below the floor gives the floor."""
    w = version_key(want)
    floor = F.array(*(F.lit(int(x)) for x in OLDEST.split(".")))
    listed = F.transform(have, lambda v, i: F.struct(F.regexp_replace(v, "^v+", "").alias("v"), i.alias("i")))
    keyed = F.transform(listed, lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i"), version_key(x["v"]).alias("k")))
    same = F.transform(F.filter(keyed, lambda x: (F.get(x["k"], F.lit(0)) == w[0]) & (F.get(x["k"], F.lit(1)) == w[1])), lambda x: x["v"])
    far = F.transform(F.filter(keyed, lambda x: (F.size(x["k"]) >= 3) & (x["k"] >= floor)), lambda x: F.struct((F.abs(x["k"][0] - w[0]) * 10000 + F.abs(x["k"][1] - w[1]) * 100 + F.abs(x["k"][2] - w[2])).alias("d"), x["i"].alias("i"), x["v"].alias("v")))
    return F.when(w < floor, OLDEST).when(F.array_contains(same, want), want).when(F.size(same) > 0, F.get(same, F.lit(0))).otherwise(F.coalesce(F.array_min(far)["v"], F.lit(OLDEST)))


def headers(text: Column) -> Column:
    """array<struct<name, header, visibility, mutability, start, code>> of every function with a body; braces count wherever they stand, unbalanced ones give the empty text."""
    return F.transform(_naive(text), lambda f: F.struct(f["name"].alias("name"), f["header"].alias("header"), visibility(f["header"]).alias("visibility"), mutability(f["header"]).alias("mutability"), f["start"].alias("start"), f["code"].alias("code")))


_ONE_LEVEL = r"(?sU)function\s+(\w+)\s*\([^)]*\)\s*(public|private|internal|external)?\s*(view|pure|payable)?\s*(returns\s*\([^)]*\))?\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"


def functions_by_pattern(text: Column) -> Column:
    """array<struct<name, visibility, mutability, code>> of functions whose header is plain and whose body nests one level; of overloads the last, in the first one's place."""
    got = [F.regexp_extract_all(text, F.lit(_ONE_LEVEL), F.lit(i)) for i in (1, 2, 3, 0)]
    rows = F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(got, ("name", "visibility", "mutability", "code"), strict=True))), lambda x: F.struct(x["name"].alias("name"), F.coalesce(F.nullif(x["visibility"], F.lit("")), F.lit("public")).alias("visibility"), F.coalesce(F.nullif(x["mutability"], F.lit("")), F.lit("nonpayable")).alias("mutability"), x["code"].alias("code")))
    all_names = lambda found: F.transform(found, lambda x: x["name"])
    last = lambda x: F.transform(F.array_distinct(x["names"]), lambda n: F.element_at(x["found"], F.size(x["names"]) + 1 - F.array_position(x["back"], n).cast("int")))
    return let(rows, lambda found: let(F.struct(found.alias("found"), all_names(found).alias("names"), F.reverse(all_names(found)).alias("back")), last))


def contract_context(text: Column) -> Column:
    """struct<contract_name, inheritance, state_variables array<struct<name, type>>, modifiers> by patterns alone."""
    name = F.regexp_extract(text, r"(?U)contract\s+(\w+)", 1)
    bases = F.regexp_extract(text, r"(?U)contract\s+\w+\s+is\s+([^{]+)", 1)
    kinds, names = (F.regexp_extract_all(text, F.lit(r"(?U)(uint|address|bool|string|mapping)\s+(\w+)\s*;"), F.lit(i)) for i in (1, 2))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(name == "", "Unknown").otherwise(name).alias("contract_name"),
        F.when(bases == "", none).otherwise(F.transform(F.split(bases, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).alias("inheritance"),
        F.zip_with(names, kinds, lambda n, k: F.struct(n.alias("name"), k.alias("type"))).alias("state_variables"),
        F.regexp_extract_all(text, F.lit(r"(?U)modifier\s+(\w+)"), F.lit(1)).alias("modifiers"),
    )


def mentions(code: Column, names: Column, lengths: Column) -> Column:
    """The names (words of \\w alone) that stand in code, also inside longer words, in their order. A name lies inside one word, so code is read once: its different words give their parts of the lengths that names have, and both sets are intersected."""
    words = F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)\w+"), F.lit(0)))
    starts = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_intersect(names, F.flatten(F.transform(words, lambda w: F.flatten(F.transform(lengths, lambda n: starts(w, n))))))


def call_graph(df, key: str, found: str, most: int = 3):
    """df with a row `f` a function of the array<struct<name, code, ..>> `found` in place of it: the struct with callees and callers, other functions of the array whose name stands in the code, the first `most` in order. Names are told apart inside an array; key tells rows apart."""
    names = lambda x: F.transform(x, lambda f: f["name"])
    parts = F.struct(F.col(found).alias("found"), names(F.col(found)).alias("names"), F.array_distinct(F.transform(found, lambda f: F.length(f["name"]))).alias("lengths"))
    said = let(parts, lambda x: F.transform(x["found"], lambda f: F.struct(f.alias("f"), F.array_remove(mentions(f["code"], x["names"], x["lengths"]), f["name"]).alias("said"))))
    rows = df.select(*(c for c in df.columns if c != found), F.posexplode(said).alias("_at", "_x"))
    first = Window.partitionBy(key, "_name").orderBy("_at")
    edges = rows.select(key, "_at", F.col("_x.f.name").alias("_from"), F.explode("_x.said").alias("_name")).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= most)
    callers = edges.groupBy(key, "_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_from"))), lambda x: x["_from"]).alias("_callers"))
    out = rows.withColumn("_name", F.col("_x.f.name")).join(callers, [key, "_name"], "left")
    none = F.array().cast("array<string>")
    f = F.col("_x.f").withField("callees", F.slice("_x.said", 1, most)).withField("callers", F.coalesce("_callers", none))
    return out.select(*(c for c in df.columns if c != found), f.alias("f"))


def function_contexts(df, text: str, file: str):
    """A row a function of every source: file, contract_context, name, visibility, mutability, code, features, callees, callers. Files are told apart by their name."""
    rows = df.select(F.col(file).alias("file"), contract_context(F.col(text)).alias("contract_context"), functions_by_pattern(F.col(text)).alias("_found"))
    return call_graph(rows, "file", "_found").select("file", "contract_context", "f.*", flags(F.col("f.code")).alias("features"))


def kept_function(name: Column, special: Column | None = None) -> Column:
    """Names that the analyzer made up go; so do constructors and fallbacks where `special` marks them."""
    kept = ~F.startswith(name, F.lit("slitherConstructor"))
    return kept if special is None else kept & ~F.coalesce(special, F.lit(False))


# --- fixed values: what a line of code begins with, is typed by, or ends in ------------------------------------------------
_BEGINS = ("//", "/*", "*", "require", "if", "for", "while", "return", "emit", "assert", "revert", "{", "}", "_")
_TYPED = r"(?U)^(uint|int|bool|address|bytes|string|mapping)\b"
_ENDS = ("{", "}", ";", ")")
# ------------------------------------------------------------------------------------------------------------------


def _code_like(line: Column) -> Column:
    begins, ends = (reduce(lambda a, b: a | b, (f(line, F.lit(x)) for x in xs)) for f, xs in ((F.startswith, _BEGINS), (F.endswith, _ENDS)))
    return (line != "") & (begins | ends | line.rlike(_TYPED) | F.contains(line, F.lit("=")))


def bare_body(answer: Column) -> Column:
    """The code of an answer: the first fence's content if there is one, without fence lines and without leading lines that are no code."""
    fence = r"(?s)```(?:[a-zA-Z0-9_-]+)?\s*(.*?)\s*```"
    inner = F.when(F.regexp_like(answer, F.lit(fence)), strip(F.regexp_extract(answer, fence, 1))).otherwise(strip(F.coalesce(answer, F.lit(""))))

    def from_code(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: _code_like(strip(x))), True)
        return strip(F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise(""))

    return let(F.filter(F.split(inner, "\n"), lambda x: ~F.startswith(strip(x), F.lit("```"))), from_code)


def modifier_code(code: Column) -> Column:
    """A modifier that is a bare name, as a comment; anything else as it is."""
    bare = F.regexp_extract(code, r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*$", 1)
    return F.when(bare != "", F.concat(F.lit("// modifier: "), bare)).otherwise(code)


def rebuild_contract(source: str | None, first: int | None, last: int | None, old: str | None, fixed: str) -> str | None:
    """source with a function replaced: by its lines first..last (1-based), else by its exact text, else by its lines without
    regard to blanks at their ends; None where none of them holds."""
    if source is None:
        return None
    lines = source.splitlines(keepends=True)
    whole_line = fixed if fixed.endswith("\n") else fixed + "\n"
    put = lambda a, b: "".join([*lines[:a], whole_line, *lines[b:]])
    if first is not None and last is not None and 0 < first < last <= len(lines):
        return put(first - 1, last)
    if old and old in source:
        return source.replace(old, fixed, 1)
    wanted = [x.strip() for x in (old or "").splitlines() if x.strip()]
    seen = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    for k, (i, x) in enumerate(seen if wanted else []):
        run = seen[k : k + len(wanted)]
        if x == wanted[0] and len(run) == len(wanted) and all(w in y for w, (_, y) in zip(wanted, run, strict=True)):
            return put(i, run[-1][0] + 1)
    return None


@F.pandas_udf(T.StringType())
def _rebuilt(source: pd.Series, first: pd.Series, last: pd.Series, old: pd.Series, fixed: pd.Series) -> pd.Series:
    number = lambda x: None if pd.isna(x) else int(x)
    text = lambda x: x if isinstance(x, str) else None
    return pd.Series([rebuild_contract(text(s), number(a), number(b), text(o), text(f) or "") for s, a, b, o, f in zip(source, first, last, old, fixed, strict=True)], dtype=object)


def rebuilt(source: Column, first: Column, last: Column, old: Column, fixed: Column, name: Column, version: Column) -> Column:
    """The whole contract with its function replaced; where that fails, a simple contract around the fix."""
    return F.coalesce(_rebuilt(source, first, last, old, fixed), simple_contract(fixed, name, version))


@F.pandas_udf(T.StringType())
def _replaced(source: pd.Series, name: pd.Series, fixed: pd.Series) -> pd.Series:
    return pd.Series([replace_function(s or "", n or "", f or "") for s, n, f in zip(source, name, fixed, strict=True)], dtype=object)


def with_function(source: Column, name: Column, fixed: Column) -> Column:
    """replace_function as a Column."""
    return _replaced(source, name, fixed)


@F.pandas_udf(T.StringType())
def _fitted(original: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([fit_header(o or "", b or "") for o, b in zip(original, body, strict=True)], dtype=object)


def with_header(original: Column, body: Column) -> Column:
    """fit_header of an answer's bare_body."""
    return _fitted(original, bare_body(body))


def block_in(text: str | None, name: str | None) -> str:
    """The function of a name in an answer or source, from where `function name` first stands to the brace that closes it, braces counted anywhere; the empty text without one."""
    at = (text or "").find(f"function {name}") if name else -1
    begin = text.find("{", at) if at >= 0 else -1
    end = naive_end(text, begin) if begin >= 0 else None
    return text[at:end].strip() if end else ""


@F.pandas_udf(T.StringType())
def _block_in(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([block_in(t if isinstance(t, str) else None, n if isinstance(n, str) else None) for t, n in zip(text, name, strict=True)], dtype=object)


def function_in(text: Column, name: Column) -> Column:
    """block_in as a Column; null without a block."""
    return F.nullif(_block_in(text, name), F.lit(""))


class FunctionBlocks:
    """Table function (text) -> (place, name, start, end, code): every text from the word `function` to the brace that closes it, in order, overloads kept, equal ones once. Braces count wherever they stand; what has no body, or no end, gives no row."""

    def eval(self, text: str):
        seen = set()
        for m in re.finditer(r"\bfunction\b(?:\s+(\w+))?", text or ""):
            end = naive_end(text, m.start())
            code = text[m.start() : end] if end else ""
            if "{" in code and code not in seen:
                seen.add(code)
                yield len(seen), m[1] or "", m.start(), end, code


def register(spark, name: str = "function_blocks") -> None:
    """Makes FunctionBlocks a table function of the session, for lateral joins in SQL."""
    spark.udtf.register(name, F.udtf(FunctionBlocks, returnType="place int, name string, start int, end int, code string"))
