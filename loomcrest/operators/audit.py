"""Data-quality audit of JSON columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def malformed(c: Column) -> Column:
    """Text that is neither blank nor JSON."""
    return F.coalesce((F.trim(c) != "") & F.try_parse_json(c).isNull(), F.lit(False))


def shape(c: Column) -> Column:
    """null, object, array(...) or the type's name, of JSON text."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.when(c.isNull() | (F.trim(c) == ""), "null").when(kind.isNull(), "malformed").when(kind == "VOID", "null").when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), F.concat(F.lit("array("), F.lower(F.regexp_extract(kind, r"^ARRAY<([A-Z]*)", 1)), F.lit(")"))).otherwise(F.lower(kind))


def issues(df: DataFrame, id_: str, objects: list[str], arrays: list[str]) -> DataFrame:
    """(id, issue_type): malformed JSON and wrong shapes, a row each."""
    found = [F.when(malformed(F.col(c)), f"{c}.malformed_json") for c in [*objects, *arrays]]
    found += [F.when(~shape(F.col(c)).isin("object", "null", "malformed"), f"{c}.type") for c in objects]
    found += [F.when(~(F.startswith(shape(F.col(c)), F.lit("array")) | shape(F.col(c)).isin("null", "malformed")), f"{c}.type") for c in arrays]
    return df.select(id_, F.explode(F.array_compact(F.array(*found))).alias("issue_type"))


def issue_statistics(found: DataFrame, id_: str, most: int = 30) -> DataFrame:
    return found.groupBy("issue_type").agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).orderBy(F.desc("n"), "issue_type").limit(most)


def list_issues(c: Column, name: str, required: tuple[str, ...] = (), seen: int = 50) -> Column:
    """Issue types of a variant that should be a list of objects: <name>.type, .mixed_types, .non_object_elems, .missing_keys.

    A null variant has none. Types are looked at in all elements, objects and their keys in the first `seen`; a key is
    missing where it is absent, null or the empty text.
    """
    items = F.try_variant_get(c, "$", "array<variant>")
    kind_of = lambda v: F.regexp_replace(F.regexp_extract(F.schema_of_variant(v), r"^(OBJECT|[A-Z]+(?:<[A-Z]*)?)", 1), "^(DECIMAL|DOUBLE|FLOAT)$", "FLOAT")
    kinds = F.array_distinct(F.transform(items, kind_of))
    few = F.slice(items, 1, seen)
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    lacks = lambda v: reduce(lambda a, b: a | b, (F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) == "" for k in required)) if required else F.lit(False)
    none = c.isNull() | F.is_variant_null(c)
    found = F.array(
        F.when(items.isNull(), f"{name}.type"),
        F.when(F.size(kinds) > 1, f"{name}.mixed_types"),
        F.when(F.exists(few, lambda v: ~is_object(v)), f"{name}.non_object_elems"),
        F.when(F.exists(few, lambda v: is_object(v) & lacks(v)), f"{name}.missing_keys"),
    )
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(found))


#: JSON columns of a function's row; the lists inside the context, and the columns that are lists themselves
ROW_COLUMNS = ("label", "slither_result", "llm_audit", "contract_context", "caller_functions", "called_functions")
CONTEXT_LISTS = ("state_variables", "structures", "modifiers")
ROW_LISTS = ("called_functions", "caller_functions")


def row_issues(df: DataFrame, id_: str, columns: tuple[str, ...] = ROW_COLUMNS, context: str = "contract_context") -> DataFrame:
    """(id, issue_type): malformed JSON of every column; then, unless the context is something but an object, the lists' issues.

    Blank texts are well-formed, but neither an object nor a list.
    """
    blank = lambda k: F.coalesce(F.trim(k) == "", F.lit(False))
    have = [c for c in columns if c in df.columns]
    bad = [F.when(malformed(F.col(c)), f"{c}.malformed_json") for c in have]
    none = F.array().cast("array<string>")
    if context in have:
        wrong = blank(context) | ~shape(F.col(context)).isin("object", "null")
        root = F.try_parse_json(context)
        lists = [list_issues(F.try_variant_get(root, f"$.{k}", "variant"), f"{context}.{k}", ("code",)) for k in CONTEXT_LISTS]
    else:
        wrong, lists = F.lit(False), []
    lists += [F.when(malformed(F.col(k)) | blank(k), F.array(F.lit(f"{k}.type"))).otherwise(list_issues(F.try_parse_json(k), k, ("code",))) for k in ROW_LISTS if k in have]
    rest = F.when(wrong, F.array(F.lit(f"{context}.type"))).otherwise(F.concat(none, *lists))
    return df.select(id_, F.explode(F.concat(F.array_compact(F.array(F.lit(None).cast("string"), *bad)), rest)).alias("issue_type"))


def suspicious(original: Column, fixed: Column) -> Column:
    """Flags of a repair that a reviewer should see, from the fixed code in lower case."""
    o, f = (F.coalesce(c, F.lit("")) for c in (original, fixed))
    low = F.lower(f)
    has = lambda w: F.contains(low, F.lit(w))
    size = lambda c: F.length(strip(c))
    tests = {
        "uses_tx_origin": has("tx.origin"),
        "selfdestruct": has("selfdestruct"),
        "may_disable_functionality": low.rlike(r"\brevert\s*\(") | low.rlike(r"\bthrow\b") | has("require(false"),
        "much_shorter_than_original": (size(o) > 0) & ((size(f) + 1) / (size(o) + 1) < 0.5),
        "uses_low_level_call_value": has(".call.value") | has("call{value"),
    }
    return F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
