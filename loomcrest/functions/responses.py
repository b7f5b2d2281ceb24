"""Reading what a language model wrote: JSON and code in free text, and the records they stand for."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .taxonomy import let
from .text import strip

# --- fixed values: patterns of JSON and code in an answer (possessive, as long texts overflow a matcher's stack) ---------
_FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
#: an object that nests one level, braces in strings not told apart
_NESTED = r"(?s)\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\]++)*+"', r"'(?:\\.|[^'\\]++)*+'"
_ITEMS = rf"\[(?:[^\[\]\"']++|{_DOUBLE}|{_SINGLE})*+\]"
#: an object that nests one level, with strings and flat lists
_STRICT = rf"(?s)\{{(?:[^{{}}\"\[\]]++|{_DOUBLE}|{_ITEMS}|\{{(?:[^{{}}\"\[\]]++|{_DOUBLE}|{_ITEMS})*+\}})*+\}}"
_CODE = r"(?s)```(?:solidity)?\s*(.*?)\s*```"
# ------------------------------------------------------------------------------------------------------------------


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def json_of_annotation(c: Column) -> Column:
    """The whole text if it is in braces, else a fenced object, else the first object that nests one level; null without any."""
    t = strip(c)
    whole = F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), t)
    return F.coalesce(whole, _some(F.regexp_extract(c, _FENCED, 1)), _some(F.regexp_extract(c, _NESTED, 0)))


def json_of_fix(c: Column) -> Column:
    """A fenced object, else the first object that nests one level (strings and lists told apart), else the whole text if it is in braces."""
    t = strip(c)
    whole = F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), t)
    return F.coalesce(_some(F.regexp_extract(c, _FENCED, 1)), _some(F.regexp_extract(c, _STRICT, 0)), whole)


def code_of(c: Column) -> Column:
    """The first code fence's content, stripped; null without one."""
    return F.when(F.regexp_like(c, F.lit(_CODE)), strip(F.regexp_extract(c, _CODE, 1)))


def _text(v: Column, name: str) -> Column:
    """A field's text; a list's items, a line each; the empty text where it is absent."""
    items = F.try_variant_get(v, f"$.{name}", "array<string>")
    return F.coalesce(F.array_join(items, "\n"), F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def _number(v: Column, name: str, default: float) -> tuple[Column, Column]:
    """A field's number, the default where it is absent; and whether it is there but is no number. True is 1, false 0."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    said = F.try_variant_get(v, f"$.{name}", "string")
    truth = F.when(F.schema_of_variant(field) == "BOOLEAN", F.when(said == "true", 1.0).otherwise(0.0))
    value = F.coalesce(truth, said.try_cast("double"))
    return F.when(field.isNull(), F.lit(default)).otherwise(value), field.isNotNull() & value.isNull()


def _true(v: Column, name: str) -> Column:
    """Whether a field, which counts as true where it is absent, is true: not false, 0, empty or null."""
    field = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(field.isNull(), True).otherwise(~F.coalesce(F.to_json(field), F.lit("null")).isin("false", "0", "0.0", '""', "null", "[]", "{}"))


def _types(v: Column) -> Column:
    """The named types; a lone text is a list of itself, anything else none."""
    field = F.try_variant_get(v, "$.vulnerability_types", "variant")
    lone = F.when(F.schema_of_variant(field) == "STRING", F.array(F.try_variant_get(v, "$.vulnerability_types", "string")))
    return F.coalesce(lone, F.try_variant_get(v, "$.vulnerability_types", "array<string>"), F.array().cast("array<string>"))


def _object(v: Column, whole: Column, *bad: Column) -> Column:
    ok = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    for b in bad:
        ok = ok & ~b
    return F.when(ok, whole)


def vulnerable_annotation(response: Column) -> Column:
    """struct of an annotation asked for a function known to be vulnerable: label, analysis, reasoning, vulnerability_types, severity (5 where it is absent), confidence, suggested_fix (for other readers). Null where there is no JSON object, or a number is none."""

    def whole(v: Column) -> Column:
        severity, bad = _number(v, "severity", 5.0)
        confidence, worse = _number(v, "confidence", 0.5)
        made = F.struct(F.lit("vulnerable").alias("label"), _text(v, "analysis").alias("analysis"), _text(v, "reasoning").alias("reasoning"), _types(v).alias("vulnerability_types"), severity.alias("severity"), confidence.alias("confidence"), _text(v, "suggested_fix_for_others").alias("suggested_fix"))
        return _object(v, made, bad, worse)

    return let(F.try_parse_json(json_of_annotation(response)), whole)


def safe_annotation(response: Column) -> Column:
    """struct of an annotation asked for a function known to be safe: label, analysis, reasoning (why it is safe), no types, severity 0, confidence, best_practices. Null where there is no JSON object, or the confidence is no number."""

    def whole(v: Column) -> Column:
        confidence, bad = _number(v, "confidence", 0.5)
        made = F.struct(F.lit("safe").alias("label"), _text(v, "analysis").alias("analysis"), _text(v, "safety_reasoning").alias("reasoning"), F.array().cast("array<string>").alias("vulnerability_types"), F.lit(0.0).alias("severity"), confidence.alias("confidence"), _text(v, "best_practices").alias("best_practices"))
        return _object(v, made, bad)

    return let(F.try_parse_json(json_of_annotation(response)), whole)


def annotation(response: Column, tool_flag: Column) -> Column:
    """struct of an annotation: label, analysis, reasoning, vulnerability_types, severity, confidence, suggested_fix, agreement,
    critique, disagreement (struct<tool, model, critique>, null where both agree or the tool said nothing).

    Null where there is no JSON object, or a number is none.
    """

    def whole(v: Column) -> Column:
        severity, bad = _number(v, "severity", 0.0)
        confidence, worse = _number(v, "confidence", 0.5)
        label = F.when(_true(v, "is_safe"), "safe").otherwise("vulnerable")
        critique = _text(v, "slither_critique")
        tool = F.when(tool_flag, "vulnerable").otherwise("safe")
        made = F.struct(
            label.alias("label"),
            _text(v, "analysis").alias("analysis"),
            _text(v, "reasoning").alias("reasoning"),
            _types(v).alias("vulnerability_types"),
            severity.alias("severity"),
            confidence.alias("confidence"),
            _text(v, "suggested_fix").alias("suggested_fix"),
            _true(v, "agrees_with_slither").alias("agreement"),
            critique.alias("critique"),
            F.when(tool_flag.isNotNull() & (tool != label), F.struct(tool.alias("tool"), label.alias("model"), critique.alias("critique"))).alias("disagreement"),
        )
        return _object(v, made, bad, worse)

    return let(F.try_parse_json(json_of_annotation(response)), whole)


def fix(response: Column, retry: bool = False) -> Column:
    """struct<code, analysis, how>: a repair. how: json, no_json, bad_json or retry (code fence alone); null where no code is found.

    An object with no code in it gives null, even where a fence stands beside it.
    """
    out = lambda code, analysis, how: F.struct(code.alias("code"), analysis.alias("analysis"), F.lit(how).alias("how"))
    nothing = F.lit("").cast("string")
    if retry:
        return let(_some(code_of(response)), lambda fenced: F.when(fenced.isNotNull(), out(fenced, nothing, "retry")))

    def read(x: Column) -> Column:
        code = _some(strip(F.regexp_replace(F.try_variant_get(F.try_parse_json(x["j"]), "$.fixed_code", "string"), r"```(?:solidity)?", "")))
        return let(F.struct(x["fenced"].alias("fenced"), x["j"].alias("j"), F.try_parse_json(x["j"]).alias("v"), code.alias("code")), choose)

    def choose(x: Column) -> Column:
        fenced, j, v, code = (x[n] for n in ("fenced", "j", "v", "code"))
        return (
            F.when(j.isNull() & fenced.isNotNull(), out(fenced, nothing, "no_json"))
            .when(j.isNotNull() & v.isNull() & fenced.isNotNull(), out(fenced, nothing, "bad_json"))
            .when(v.isNotNull() & code.isNotNull(), out(code, _text(v, "fix_analysis"), "json"))
        )

    return let(F.struct(_some(code_of(response)).alias("fenced"), json_of_fix(response).alias("j")), read)


def query_block(types: Column, severity: Column, code: Column) -> Column:
    """The closing part of a prompt with demonstrations."""
    named = F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.array_join(types, ", ")).otherwise("Unknown")
    said = F.coalesce(severity.cast("string"), F.lit("Unknown"))
    return F.concat(F.lit("<QUERY>\n### Vulnerability: "), named, F.lit("\n### Severity: "), said, F.lit("\n### Code:\n```solidity\n"), strip(F.coalesce(code, F.lit(""))), F.lit("\n```\n</QUERY>\n\nProvide the fixed code:"))


def augmented_prompt(demos: Column, types: Column, severity: Column, code: Column, prompt: Column) -> Column:
    """struct<prompt, used, n_demos>: the demonstrations (an array of texts) and the query block before the prompt; the prompt alone without demonstrations."""
    n = F.coalesce(F.size(demos), F.lit(0))
    full = F.concat_ws("\n\n", F.array_join(demos, "\n\n"), query_block(types, severity, code), prompt)
    return F.struct(F.when(n > 0, full).otherwise(prompt).alias("prompt"), (n > 0).alias("used"), n.alias("n_demos"))


def without_nulls(raw: str | None, field: str) -> str | None:
    """JSON text without the null entries of objects below `field`."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None}
        return [bare(v) for v in x] if isinstance(x, list) else x

    try:
        data = json.loads(raw) if raw is not None else None
    except ValueError:
        return raw
    if not isinstance(data, dict) or not isinstance(data.get(field), dict):
        return raw
    return json.dumps(data | {field: bare(data[field])}, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _without_nulls(raw: pd.Series, field: pd.Series) -> pd.Series:
    return pd.Series([without_nulls(r, f) for r, f in zip(raw, field, strict=True)], dtype=object)


def strip_nulls(c: Column, field: str = "fix") -> Column:
    """JSON text without the null entries of objects below `field`, at any depth; nulls in lists and outside it stay. Free JSON has no schema, so this is Python."""
    return _without_nulls(c, F.lit(field))
