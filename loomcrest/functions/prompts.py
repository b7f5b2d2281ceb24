"""Prompts and training triples from records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy

# --- fixed values: the sentences of a repair prompt ------------------------------------------------------------------------
_INTRO = "The following Solidity function has been identified with security vulnerabilities: \n\n"
_REQUEST = "Please provide the complete fixed version of this code that addresses the identified vulnerabilities. \nOutput ONLY the corrected Solidity function code in a code block not the entire contract."
# ------------------------------------------------------------------------------------------------------------------


def facts(types: Column, severity: Column) -> Column:
    """'- Type' and '- Severity' lines, each only where it is known; a severity of 0 is."""
    named = F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.concat(F.lit("- Type: "), F.array_join(types, ", ")))
    rated = F.concat(F.lit("- Severity: "), severity.cast("string"))
    return F.concat_ws("\n", named, rated)


def repair_input(types: Column, severity: Column, code: Column) -> Column:
    """The short form: facts under a heading, if there are any, then the code."""
    said = facts(types, severity)
    return F.concat(F.when(said != "", F.concat(F.lit("### Vulnerability Info\n"), said, F.lit("\n\n"))).otherwise(""), F.lit("### Source Code\n"), F.coalesce(code, F.lit("")))


def repair_prompt(function: Column, types: Column, severity: Column, code: Column, instruction: Column | None = None) -> Column:
    """The long form: function, facts, code and request; behind the instruction if there is one."""
    said = facts(types, severity)
    block = F.when(said != "", F.concat(F.lit("**Vulnerability Info:**\n"), said, F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit(f"{_INTRO}**Function:** "), function, F.lit("\n\n"), block, F.lit("**Source Code:**\n"), code, F.lit(_REQUEST))
    return text if instruction is None else F.concat(instruction, F.lit("\n\n"), text)


def export_types(types: Column, audit_types: Column, ids: Column) -> Column:
    """The buckets that a sample is exported with: of its types, else of its audit's; its identifiers, where it has some, decide."""
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    raw = F.when(some(types), types).otherwise(F.coalesce(audit_types, empty))
    return taxonomy.buckets(raw, F.when(some(ids), ids).otherwise(taxonomy.swc_ids(raw)))


def triple(id_: Column, instruction: Column, prompt: Column, fixed: Column, analysis: Column | None = None) -> Column:
    """struct<id, instruction, input, output> of a training sample; the analysis goes before the fixed code."""
    code = F.concat(F.lit("\n\n### Fixed Code\n"), F.coalesce(fixed, F.lit("")))
    before = F.lit("") if analysis is None else F.when(F.coalesce(analysis, F.lit("")) != "", F.concat(F.lit("### Analysis\n"), analysis)).otherwise("")
    return F.struct(F.concat(F.lit("fix_"), id_.cast("string")).alias("id"), instruction.alias("instruction"), prompt.alias("input"), F.concat(before, code).alias("output"))


def chat(messages: Column, plain: bool = False) -> Column:
    """array<struct<role, text>> as one text: a marked line a turn, or 'role: text' paragraphs."""
    if plain:
        return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n\n")
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("\n"))), "")
