"""From tool findings to labelled functions, and from labels to annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.source import snippet
from ..functions.text import case_distinct, strip

# --- fixed values: category -> the detectors that report it -----------------------------------------------------------------
DETECTORS = {
    "reentrancy": ["reentrancy-eth", "reentrancy-no-eth", "reentrancy-benign", "reentrancy-events", "reentrancy-unlimited-gas"],
    "access_control": ["suicidal", "unprotected-upgrade", "arbitrary-send-eth", "arbitrary-send-erc20", "arbitrary-send-erc20-permit", "controlled-delegatecall", "controlled-array-length", "tx-origin", "protected-vars", "gelato-unprotected-randomness"],
    "arithmetic": ["incorrect-shift", "incorrect-exp", "divide-before-multiply"],
    "unchecked_return": ["unchecked-lowlevel", "unchecked-send", "unchecked-transfer", "unused-return"],
    "uninitialized_storage": ["uninitialized-state", "uninitialized-storage", "uninitialized-local", "uninitialized-fptr-cst"],
    "timestamp_dependence": ["timestamp"],
    "bad_randomness": ["weak-prng"],
    "delegatecall": ["delegatecall-loop"],
    "locked_ether": ["locked-ether"],
    "msg_value_loop": ["msg-value-loop"],
    "shadowing": ["shadowing-state", "shadowing-abstract", "shadowing-builtin", "shadowing-local"],
    "abi_encoding": ["abiencoderv2-array", "encode-packed-collision"],
    "storage_issue": ["array-by-reference", "storage-array", "mapping-deletion"],
    "logic_error": ["incorrect-equality", "tautological-compare", "tautology", "boolean-cst", "incorrect-unary", "boolean-equal"],
    "interface_issue": ["erc20-interface", "erc721-interface"],
    "oracle_issue": ["pyth-unchecked-confidence", "pyth-unchecked-publishtime", "chronicle-unchecked-price", "chainlink-feed-registry"],
    "constructor_issue": ["multiple-constructors", "reused-constructor", "void-cst"],
    "return_value_issue": ["incorrect-return", "return-leave"],
    "deprecated_function": ["pyth-deprecated-functions", "optimism-deprecation"],
    "deprecated_standard": ["deprecated-standards"],
    "missing_validation": ["missing-zero-check"],
    "missing_event": ["events-access", "events-maths"],
    "event_issue": ["erc20-indexed"],
    "gas_optimization": ["calls-loop", "costly-loop", "cache-array-length", "constable-states", "external-function", "immutable-states", "var-read-using-this"],
    "assembly_usage": ["assembly"],
    "assembly_issue": ["constant-function-asm"],
    "low_level_call": ["low-level-calls"],
    "code_quality": ["cyclomatic-complexity", "redundant-statements", "too-many-digits"],
    "dead_code": ["dead-code"],
    "unused_variable": ["unused-state"],
    "type_conversion": ["enum-conversion"],
    "state_mutability": ["constant-function-state"],
    "naming_issue": ["name-reused"],
    "naming_convention": ["naming-convention"],
    "visibility_issue": ["public-mappings-nested"],
    "malicious_code": ["rtlo"],
    "other": ["codex"],
    "signature_collision": ["domain-separator-collision"],
    "unused_write": ["unused-write"],
    "transaction_order": ["out-of-order-retryable"],
    "modifier_issue": ["incorrect-modifier"],
    "scope_issue": ["variable-scope"],
    "gas_griefing": ["return-bomb"],
    "assertion_issue": ["assert-state-change"],
    "initialization_issue": ["function-init-state"],
    "using_for_issue": ["incorrect-using-for"],
    "inheritance_issue": ["missing-inheritance"],
    "pragma_issue": ["pragma"],
    "compiler_version": ["solc-version"],
    "incomplete_implementation": ["unimplemented-functions"],
}
#: severity word -> score, where a label has none
FOUND_SEVERITY = {"High": 9.0, "Medium": 6.0, "Low": 3.0, "Informational": 1.0, "Optimization": 1.0}
# ------------------------------------------------------------------------------------------------------------------

#: a tool's results: one row a detector result
RESULT = "check string, impact string, description string, elements array<struct<type:string,name:string,type_specific_fields:struct<parent:struct<type:string,name:string>>,source_mapping:struct<parent_function:struct<name:string>>>>"


def detector_type(detector: Column) -> Column:
    """The category of a detector; the detector itself where the table lacks it."""
    return taxonomy.lookup({d: c for c, ds in DETECTORS.items() for d in ds}, detector, detector)


def affected_functions(elements: Column) -> Column:
    """The different 'contract.function' names of a result's elements: functions by their own name, nodes and variables by their function's; without a contract's or a function's name none."""

    def of(e: Column) -> Column:
        contract = F.coalesce(e["type_specific_fields"]["parent"]["name"], F.lit(""))
        inner = e["type"].isin("node", "variable")
        name = F.coalesce(F.when(inner, e["source_mapping"]["parent_function"]["name"]), e["name"], F.lit(""))
        return F.when(e["type"].isin("function", "node", "variable") & (contract != "") & (name != ""), F.concat(contract, F.lit("."), name))

    return F.array_distinct(F.array_compact(F.transform(F.coalesce(elements, F.array().cast("array<" + RESULT.split("elements array<", 1)[1])), of)))


def findings_by_function(results: DataFrame, seq: str) -> DataFrame:
    """(function, types, n_findings, findings): of results (RESULT), what was found in each function, in the results' order."""
    each = results.select(F.col(seq).alias("_s"), F.explode(affected_functions(F.col("elements"))).alias("function"), F.struct(detector_type(F.col("check")).alias("type"), F.col("check").alias("detector"), F.col("impact").alias("severity"), "description").alias("f"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("_s", "f"))), lambda x: x["f"])
    return each.groupBy("function").agg(found.alias("findings")).select("function", F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["type"]))).alias("types"), F.size("findings").alias("n_findings"), "findings")


def labeler_statistics(labels: DataFrame, vulnerable: str = "is_vulnerable", contract: str = "contract") -> DataFrame:
    """One row: contracts, functions, vulnerable and safe ones, and the vulnerable ones' percentage. A row without a label stands for a contract that failed."""
    flag = F.coalesce(F.col(vulnerable), F.lit(False))
    done = F.col(vulnerable).isNotNull()
    out = labels.agg(F.count_distinct(contract).alias("total_contracts"), F.count_distinct(F.when(done, F.col(contract))).alias("processed_contracts"), F.count_if(done).alias("total_functions"), F.count_if(flag).alias("vulnerable_functions"), F.count_if(done & ~flag).alias("safe_functions"))
    return out.withColumn("failed_contracts", F.col("total_contracts") - F.col("processed_contracts")).withColumn("vulnerable_percent", F.col("vulnerable_functions") * 100 / F.greatest(F.col("total_functions"), F.lit(1)))


def type_distribution(labels: DataFrame, types: str, vulnerable: str = "is_vulnerable") -> DataFrame:
    """(type, n, percent of vulnerable functions), the most frequent first."""
    some = labels.where(F.coalesce(F.col(vulnerable), F.lit(False)))
    total = some.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    n = some.select(F.explode(types).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("type", "n", (F.col("n") * 100 / F.col("total")).alias("percent")).orderBy(F.desc("n"), "type")


def label_severity(severity: Column, details: Column) -> Column:
    """The label's number, else the highest of the tool's findings (array<struct<severity>>), else 0."""
    found = F.array_max(F.transform(details, lambda d: taxonomy.lookup(FOUND_SEVERITY, d["severity"], F.lit(0.0))))
    return F.coalesce(severity.try_cast("double"), found, F.lit(0.0))


def label_types(types: Column, details: Column) -> Column:
    """The label's types, else those of its details (array<struct<type, category>>: type before category), without blanks and without repeats in another case."""
    empty = F.array().cast("array<string>")
    some = lambda xs: F.filter(F.coalesce(xs, empty), lambda t: strip(F.coalesce(t, F.lit(""))) != "")
    own = some(types)
    named = some(F.transform(details, lambda d: strip(F.coalesce(F.nullif(d["type"], F.lit("")), d["category"]))))
    return case_distinct(F.when(F.size(own) > 0, own).otherwise(named))


def annotation_of_label(vulnerable: Column, types: Column, details: Column, severity: Column, described: Column, tool_flag: Column, tool_details: Column, code: Column, first_line: Column) -> Column:
    """struct<label, vulnerability_types, severity, analysis, code_details, tool_section> made of a label; null unless it is vulnerable.

    details: array<struct<type, category, lines array<int>>>; tool_details: array<struct<type, severity, description>>.
    """
    kinds = label_types(types, details)
    listed = F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise("unknown")
    flagged = F.coalesce(tool_flag, F.lit(False))
    also = F.when(flagged, "Slither also flagged issues.").otherwise("Slither did not flag issues (may be false-negative).")
    made = F.concat(F.lit("Ground-truth label indicates this function is vulnerable. Vulnerability types: "), listed, F.lit(". "), also)
    analysis = F.coalesce(F.nullif(strip(described), F.lit("")), made)

    def one(d: Column, i: Column) -> Column:
        category = F.coalesce(F.nullif(d["category"], F.lit("")), F.nullif(d["type"], F.lit("")), F.lit("unknown"))
        lines = F.coalesce(d["lines"], F.array().cast("array<int>"))
        said = F.concat(F.lit("["), F.array_join(F.transform(lines, lambda x: x.cast("string")), ", "), F.lit("]"))
        number = (i + 1).cast("string")
        shown = snippet(code, first_line, lines)
        head = F.concat(F.lit("\n**Vulnerability "), number, F.lit("** (Category: "), category, F.lit(")\nLines: "), said, F.lit("\n"))
        plain = F.concat(F.lit("- Vulnerability "), number, F.lit(": category="), category, F.lit(", lines="), said)
        return F.when(strip(F.coalesce(code, F.lit(""))) == "", plain).when(F.size(lines) > 0, F.concat(head, F.lit("\n```solidity\n"), shown, F.lit("\n```"))).otherwise(head)

    body = F.array_join(F.transform(details, one), "\n")
    code_details = F.when(F.coalesce(F.size(details), F.lit(0)) > 0, strip(F.concat(F.lit("## Vulnerable Code Details (Ground Truth)\n"), body))).otherwise("")
    summary = F.array_join(F.transform(tool_details, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". **"), F.coalesce(d["type"], F.lit("Unknown")), F.lit("** (Severity: "), F.coalesce(d["severity"], F.lit("Unknown")), F.lit(")\n   "), F.coalesce(d["description"], F.lit("No description")))), "\n")
    some = flagged & (F.coalesce(F.size(tool_details), F.lit(0)) > 0)
    section = F.when(some, F.concat(F.lit("## Slither Analysis (Reference)\nSlither found these issues:\n"), summary, F.lit("\n\nNote: Slither can have false positives. Verify each issue independently."))).otherwise("## Slither Analysis (Reference)\nSlither found no critical vulnerabilities. But check carefully - it can miss issues.")
    section = F.when(tool_flag.isNull() & tool_details.isNull(), "").otherwise(section)
    whole = F.struct(F.lit("vulnerable").alias("label"), kinds.alias("vulnerability_types"), label_severity(severity, tool_details).alias("severity"), analysis.alias("analysis"), code_details.alias("code_details"), section.alias("tool_section"))
    return F.when(F.coalesce(vulnerable, F.lit(False)), whole)
