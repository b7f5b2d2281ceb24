"""Records of functions from an analyzer's tables: contexts of contracts, features, call graph, findings and ground truth.

The analyzer runs elsewhere; its tables are read here. Rows of a table carry `seq`, their place inside their contract.
A contract's lists are one value a contract, so a contract must fit in a row; functions of a large contract are spread as
any rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.source import kept_function
from .candidates import used_events
from .joins import analyzer_call_graph

# --- fixed values: what stands for code that the analyzer does not give ----------------------------------------------------
STUBS = {"modifiers": ("modifier ", "() { _ ;}"), "structures": ("struct ", " { ... }"), "events": ("event ", "(...);")}
# ------------------------------------------------------------------------------------------------------------------
_NAMED = "array<struct<name:string,code:string>>"
_VARIABLES = "array<struct<name:string,type:string,visibility:string,code:string>>"


def _in_order(fields: list[str]) -> Column:
    """The structs of a contract's rows in order, as one list."""
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def contract_contexts(contracts: DataFrame, variables: DataFrame, functions: DataFrame, **named: DataFrame) -> DataFrame:
    """(contract, contract_context): struct<contract_name, inheritance, state_variables, modifiers, structures, events, num_functions>.

    contracts (contract, bases), variables (contract, seq, name, type, visibility, code), functions (contract, ..), and modifiers,
    structures and events (contract, seq, name, code) by name. A null code gets a stub; a table that is not given, or has
    no row of a contract, gives an empty list.
    """
    stub = F.concat_ws(" ", "type", "visibility", F.concat("name", F.lit(";")))
    parts = {"state_variables": (variables.withColumn("code", F.coalesce("code", stub)), ["name", "type", "visibility", "code"], _VARIABLES)}
    for kind, (before, behind) in STUBS.items():
        if kind in named:
            parts[kind] = (named[kind].withColumn("code", F.coalesce("code", F.concat(F.lit(before), F.col("name"), F.lit(behind)))), ["name", "code"], _NAMED)
    out = contracts.select("contract", F.coalesce("bases", F.array().cast("array<string>")).alias("inheritance"))
    for kind, (rows, fields, _) in parts.items():
        out = out.join(rows.groupBy("contract").agg(_in_order(fields).alias(kind)), "contract", "left")
    out = out.join(functions.groupBy("contract").agg(F.count("*").cast("int").alias("num_functions")), "contract", "left")
    lists = {"state_variables": _VARIABLES} | dict.fromkeys(STUBS, _NAMED)
    made = [(F.coalesce(F.col(k), F.array().cast(t)) if k in parts else F.array().cast(t)).alias(k) for k, t in lists.items()]
    return out.select("contract", F.struct(F.col("contract").alias("contract_name"), "inheritance", *made, F.coalesce("num_functions", F.lit(0)).alias("num_functions")).alias("contract_context"))


def analyzer_features() -> Column:
    """struct of a function's features from the analyzer's numbers (nodes, external_calls, written, read) and its code, mutability and visibility; all false where the analyzer gave no numbers."""
    known, code = F.col("nodes").isNotNull(), F.coalesce("code", F.lit(""))
    some = lambda c: known & (F.coalesce(c, F.lit(0)) > 0)
    says = lambda w: known & F.contains(code, F.lit(w))
    is_ = lambda m: known & F.coalesce(F.col("mutability") == m, F.lit(False))
    tests = {
        "has_loops": known & code.rlike(r"(?U)\b(for|while)\s*\("),
        "has_if_statements": known & (F.col("nodes") > 1),
        "complexity": F.coalesce("nodes", F.lit(0)),
        "has_external_calls": some("external_calls"),
        "has_state_changes": some("written"),
        "reads_state_vars": some("read"),
        "writes_state_vars": some("written"),
        "has_require": says("require("),
        "uses_tx_origin": says("tx.origin"),
        "uses_delegatecall": says("delegatecall"),
        "is_payable": is_("payable"),
        "is_view": is_("view"),
        "is_pure": is_("pure"),
        "visibility": F.when(known, F.coalesce("visibility", F.lit("unknown"))).otherwise("unknown"),
    }
    return F.struct(*(c.alias(n) for n, c in tests.items()))


def function_records(functions: DataFrame, calls: DataFrame, contexts: DataFrame, findings: DataFrame, truth: DataFrame) -> DataFrame:
    """A row a function: contract, name, signature, code, start_line, end_line, caller_functions, called_functions, contract_context, ast_features, slither_result, label.

    functions (contract, seq, name, signature, code, visibility, mutability, special, nodes, external_calls, written, read), calls as
    for analyzer_call_graph, contexts of contract_contexts, findings (contract, name, type, severity), truth (contract, seq, name, start,
    end, vulnerable, categories). Constructors and fallbacks (`special`) and names that the analyzer made up go. A context
    keeps the events that the function or what it calls emits. Of a function's entries in `truth` the first is its label;
    without one, lines are 1 and the label is null.
    """
    graph = analyzer_call_graph(functions.where(kept_function(F.col("name"), F.col("special"))), calls)
    found = findings.groupBy("contract", "name").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_list(F.struct("type", "severity"))).alias("details"))
    first = truth.groupBy("contract", "name").agg(F.min_by(F.struct("start", "end", "vulnerable", "categories"), "seq").alias("t"))
    rows = graph.join(contexts, "contract", "left").join(found, ["contract", "name"], "left").join(first, ["contract", "name"], "left")
    callees = F.transform(F.coalesce("called_functions", F.array().cast("array<struct<name:string,contract:string,code:string>>")), lambda c: c["code"])
    scope = F.concat_ws("\n", F.coalesce("code", F.lit("")), callees)
    none = F.array().cast("array<string>")
    types = F.coalesce("types", none)
    result = F.struct((F.size(types) > 0).alias("is_vulnerable"), types.alias("vulnerability_types"), F.size(types).alias("vulnerability_count"), F.coalesce("details", F.array().cast("array<struct<type:string,severity:string>>")).alias("vulnerability_details"))
    bad = F.coalesce(F.col("t.vulnerable"), F.lit(False))
    label = F.when(F.col("t").isNotNull(), F.struct(bad.alias("is_vulnerable"), F.when(bad, F.coalesce("t.categories", none)).otherwise(none).alias("vulnerability_types"), F.lit("ground_truth").alias("source")))
    context = F.when(F.col("contract_context").isNotNull(), F.col("contract_context").withField("events", used_events(F.col("contract_context.events"), scope)))
    return rows.select(
        "contract",
        "name",
        F.coalesce("signature", "name").alias("signature"),
        F.coalesce("code", F.concat(F.lit("function "), F.col("name"), F.lit("() {}"))).alias("code"),
        F.coalesce("t.start", F.lit(1)).alias("start_line"),
        F.coalesce("t.end", F.lit(1)).alias("end_line"),
        "caller_functions",
        "called_functions",
        context.alias("contract_context"),
        analyzer_features().alias("ast_features"),
        result.alias("slither_result"),
        label.alias("label"),
    )
