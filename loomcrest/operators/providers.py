"""External tools behind one interface: a function from a record to a record, run batch by batch on executors.

Equal inputs are sent once: keys are deduplicated before the call and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import let
from ..functions.text import strip, truncate_lines


def call(df: DataFrame, text: str, provider: Callable[[str], dict], schema: str, on_error: str = "open", parallel: int | None = None) -> DataFrame:
    """df with the provider's columns; a null text is the empty one. on_error 'open' passes a failed call, 'closed' fails it (column `passed`), with `error`."""
    key = F.sha1(F.coalesce(F.col(text), F.lit("")))
    todo = df.select(key.alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).dropDuplicates(["_k"])
    if parallel:
        todo = todo.repartition(parallel, "_k")
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_k"], b["_t"], strict=True):
                try:
                    r = provider(t) | {"error": None}
                except Exception as e:  # the policy decides what a failed tool means
                    r = {"passed": on_error == "open", "error": str(e)}
                rows.append({"_k": k} | {n: r.get(n) for n in [*names, "error"]})
            yield pd.DataFrame(rows, columns=["_k", *names, "error"])

    got = todo.mapInPandas(run, f"_k string, {schema}, error string")
    return df.withColumn("_k", key).join(got, "_k").drop("_k")


def tool_issues(report: Column, severities: list[str], most: int = 50) -> Column:
    """Issue lines of a tool's JSON report; blank severities pass the filter."""
    kind = "struct<issues:array<struct<title:string,`swc-id`:string,severity:string,description:string,locations:array<struct<lineno:int>>>>>"
    found = F.filter(F.from_json(report, kind)["issues"], lambda x: (F.coalesce(x["severity"], F.lit("")) == "") | F.lower(x["severity"]).isin(*severities))
    full = lambda x: F.when(F.coalesce(x["swc-id"], F.lit("")) != "", F.concat(x["swc-id"], F.lit(" "), x["title"], F.lit(" ("), F.coalesce(x["severity"], F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit(" @L"), F.get(x["locations"], F.lit(0))["lineno"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(": "), x["description"]), F.lit("")))).otherwise(x["title"])
    return F.transform(F.slice(F.coalesce(found, F.array().cast("array<struct<title:string,`swc-id`:string,severity:string,description:string,locations:array<struct<lineno:int>>>>")), 1, most), full)


def tool_text_issues(text: Column, most: int = 50, lines: int = 12, chars: int = 1200) -> Column:
    """struct<passed, issues> of a tool's plain text, where it gave no JSON: lines that name an issue or a class, else the text's beginning; nothing said, or none found, passes."""

    def read(t: Column) -> Column:
        named = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: F.contains(F.lower(x), F.lit("swc")) | F.contains(F.lower(x), F.lit("issue")))
        whole = F.left(truncate_lines(t, lines), F.lit(chars))
        clean = (t == "") | F.contains(F.lower(t), F.lit("no issues found"))
        none = F.array().cast("array<string>")
        found = F.when(clean, none).when(F.size(named) > 0, F.slice(named, 1, most)).otherwise(F.array(whole))
        return F.struct(clean.alias("passed"), found.alias("issues"))

    return let(strip(F.coalesce(text, F.lit(""))), read)


def all_passed(tools: Column) -> Column:
    """Whether every tool in a map<name, struct<passed>> passed; a tool without a verdict passes."""
    return F.forall(F.map_values(tools), lambda t: F.coalesce(t["passed"], F.lit(True)))


#: Errors of a tool that say nothing of the code: it ran out of time, was not there, or failed by itself.
UNCERTAIN = ("timeout", "not_found", "tool_error", "rc=")


def verification(compiled: Column, first: Column, second: Column, uncertain_passes: bool = True, labels: tuple[str, str, str] = ("does not compile: ", "first tool: ", "second tool: "), shown: int = 10) -> Column:
    """struct<compiles, first_passed, second_passed, remaining_issues, error, acceptable> of a repair.

    compiled struct<passed, error>, first struct<passed, issues>, second struct<passed, issues, error>; a null tool was not
    asked, and passes. What does not compile is shown to no tool: the first counts as failed, the second as passed. A second tool whose error is
    UNCERTAIN passes, if uncertain_passes. The error is that of the last check that found one.
    """
    builds = F.coalesce(compiled["passed"], F.lit(False))
    none = F.array().cast("array<string>")
    first_passed = builds & F.coalesce(first["passed"], F.lit(True))
    said = F.lower(F.coalesce(second["error"], F.lit("")))
    unsure = F.exists(F.array(*map(F.lit, UNCERTAIN)), lambda w: F.contains(said, w)) if uncertain_passes else F.lit(False)
    second_failed = builds & ~F.coalesce(second["passed"], F.lit(True))
    second_passed = ~second_failed | unsure
    issues = F.when(builds, F.coalesce(first["issues"], none)).otherwise(none)
    error = (
        F.when(~builds, F.concat(F.lit(labels[0]), F.coalesce(compiled["error"], F.lit(""))))
        .when(second_failed, F.concat(F.lit(labels[2]), F.array_join(F.slice(F.coalesce(second["issues"], none), 1, shown), "; ")))
        .when(~first_passed, F.concat(F.lit(labels[1]), F.array_join(issues, ", ")))
    )
    return F.struct(builds.alias("compiles"), first_passed.alias("first_passed"), second_passed.alias("second_passed"), issues.alias("remaining_issues"), error.alias("error"), (builds & first_passed & second_passed).alias("acceptable"))


def rolled_up(tools: Column) -> Column:
    """struct<tools_passed, remaining array<struct<tool, issues>>> of a map<name, struct<passed, issues>>: the tools that failed, in the map's order; one without a verdict passes."""
    failed = F.filter(F.map_entries(tools), lambda e: ~F.coalesce(e["value"]["passed"], F.lit(True)))
    return F.struct((F.size(failed) == 0).alias("tools_passed"), F.transform(failed, lambda e: F.struct(e["key"].alias("tool"), F.coalesce(e["value"]["issues"], F.array().cast("array<string>")).alias("issues"))).alias("remaining"))
