"""Column functions for cleaning, parsing and rendering text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import let

#: identifiers, numbers, or any single visible character
TOKEN = r"(?U)[A-Za-z_]\w+|\d+|[^\s]"
TYPE_LINE = r"(?mi)^\s*-\s*Type:\s*(.+?)\s*$"
FENCE = r"(?s)```[A-Za-z0-9_+-]*[ \t]*\r?\n(.*?)```"
#: where str.splitlines() of Python ends a line
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def strip(c: Column) -> Column:
    """Strips all white space at both ends (trim() strips blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def expand_tabs(c: Column, width: int = 4) -> Column:
    return F.replace(c, F.lit("\t"), F.lit(" " * width))


def strip_line_ends(c: Column) -> Column:
    """Strips white space before every line end; newlines stay."""
    return F.regexp_replace(c, r"[^\S\n]+(?=\n|$)", "")


def collapse_blank_lines(c: Column, most: int = 2) -> Column:
    """Runs of more than `most` newlines become `most` newlines."""
    return F.regexp_replace(c, r"\n{%d,}" % (most + 1), "\n" * most)


def drop_heading(c: Column, heading: str) -> Column:
    """Drops one leading heading line."""
    return F.when(F.startswith(c, F.lit(heading)), F.regexp_replace(F.substr(c, F.lit(len(heading) + 1)), r"^\s+", "")).otherwise(c)


def clean_text(c: Column, width: int = 4, most: int = 2, heading: str | None = None) -> Column:
    c = collapse_blank_lines(strip_line_ends(expand_tabs(normalize_newlines(c), width)), most)
    return drop_heading(c, heading) if heading else c


def shorten(c: Column, most: int, marker: str = "...") -> Column:
    """The text if it has at most so many characters, else its first ones and the marker."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(marker))).otherwise(c)


def error_summary(c: Column, most: int, prefix: str = "") -> Column:
    """The first lines of an error's text without its prefix, and how many there are if not all are shown."""
    bare = strip(F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c) if prefix else c)
    lines = F.split(bare, "\n")
    some = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(f"\n... (showing first {most} lines of "), F.size(lines).cast("string"), F.lit(" total)"))
    return F.when(F.coalesce(c, F.lit("")) == "", "No error details available").when(F.size(lines) > most, some).otherwise(bare)


def strip_comments(c: Column) -> Column:
    """Block comments, then line comments; not aware of string literals."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"(?dm)//.*?$", "")


def strip_marked_comments(c: Column, marks: tuple[str, ...]) -> Column:
    """Line comments that hold one of the marks (in any case), and with them lines that nothing else stands on."""
    some = "|".join(rf"\Q{m}\E" for m in marks)
    return F.regexp_replace(F.regexp_replace(c, rf"(?dmi)^[ \t]*//[^\n]*(?:{some})[^\n]*(?:\n|\z)", ""), rf"(?dmi)[ \t]*//[^\n]*(?:{some})[^\n]*$", "")


def strip_markup_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def compact_code(c: Column) -> Column:
    """Without fence lines, comments and blanks at line ends; blank lines in a row become one."""
    lines = lambda x: F.split(x, LINE_END)
    bare = F.array_join(F.filter(lines(strip(c)), lambda x: ~F.startswith(strip(x), F.lit("```"))), "\n")
    code = strip_comments(F.when(F.contains(c, F.lit("```")), strip(bare)).otherwise(strip(c)))
    ended = F.array_join(F.transform(lines(code), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return strip(collapse_blank_lines(ended))


def wrap_fence(c: Column, language: str = "") -> Column:
    """Puts text into a code fence unless it holds one."""
    return F.when(F.contains(c, F.lit("```")), c).otherwise(F.concat(F.lit(f"```{language}\n"), strip(c), F.lit("\n```")))


def unwrap_fence(c: Column) -> Column:
    """The first fence's content, else the stripped text."""
    return F.when(F.regexp_like(c, F.lit(FENCE)), strip(F.regexp_extract(c, FENCE, 1))).otherwise(strip(c))


def non_blank_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""))


def list_of(c: Column, separators: str = ",") -> Column:
    """The non-empty stripped parts."""
    return F.filter(F.transform(F.split(c, f"[{separators}]"), strip), lambda x: x != "")


def type_line(c: Column, every: bool = False) -> Column:
    """Types named on the first '- Type:' line, or on all."""
    if every:
        return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(TYPE_LINE), F.lit(1)), list_of))
    return list_of(F.regexp_extract(c, TYPE_LINE, 1))


def tokens(c: Column) -> Column:
    """Lower-cased tokens, with repeats."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def token_estimate(c: Column) -> Column:
    """Four characters a token, at least one; 0 for the empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4))).cast("long")


def file_name(c: Column, most: int = 180) -> Column:
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit(most))


def content_key(c: Column) -> Column:
    return F.md5(strip(c))


def line_of(c: Column, position: Column) -> Column:
    """The 1-based line of a 0-based code-point position."""
    return F.length(F.left(c, position)) - F.length(F.replace(F.left(c, position), F.lit("\n"), F.lit(""))) + 1


def line_slice(c: Column, first: Column, last: Column) -> Column:
    """Lines first..last, 1-based, clamped."""
    lines = F.split(c, "\n")
    start = F.greatest(F.lit(1), first)
    return F.array_join(F.slice(lines, start, F.greatest(F.lit(0), F.least(last, F.size(lines)) - start + 1)), "\n")


def truncate_lines(c: Column, most: int, marker: str = "\n...") -> Column:
    lines = F.split(c, "\n")
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(marker))).otherwise(c)


def vulnerability_info(c: Column) -> Column:
    """struct<types array<string>, severity double>. A line names types as '- Type: ..' and behind 'vulnerability type(s):' anywhere,
    split at , ; / and |; the last number behind 'severity:' holds; ['Unknown'] and null without any."""
    named = lambda x, p: list_of(F.regexp_extract(x, p, 1), ",;/|")
    lines = F.split(c, LINE_END)
    types = F.flatten(F.transform(lines, lambda x: F.concat(named(x, r"(?i)^\s*-\s*type\s*:\s*(.+)$"), named(x, r"(?i)vulnerability\s*types?\s*:\s*(.+)$"))))
    said = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)severity\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1)), lambda x: x != "")
    return F.struct(F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("Unknown"))).alias("types"), F.try_element_at(said, F.lit(-1)).cast("double").alias("severity"))


def function_of_prompt(c: Column) -> Column:
    """The name behind '**Function:**'; null without one."""
    return F.nullif(F.regexp_extract(c, r"\*\*Function:\*\*\s*([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))


#: what may follow a prompt's code, the first in this order that occurs
PROMPT_TAILS = ("\nPlease provide", "\nOutput ONLY", "\nPlease output", "\nOutput only")


def split_prompt(c: Column) -> Column:
    """struct<before, code, after>: a prompt up to 'Source Code:', its code, and the request behind; code is null without the mark."""

    def begun(s: Column) -> Column:
        head = F.nullif(F.regexp_extract(s, r"(?s)^(.*?\*\*Source Code:\*\*)", 1), F.lit(""))
        before = F.coalesce(head, F.regexp_extract(s, r"(?s)^(.*?Source Code:(?:\*\*)?)", 1))
        return let(F.struct(s.alias("s"), before.alias("before")), behind)

    def behind(x: Column) -> Column:
        rest = F.substr(x["s"], F.length(x["before"]) + 1)
        return let(F.struct(x["s"].alias("s"), x["before"].alias("before"), rest.alias("rest")), ended)

    def ended(x: Column) -> Column:
        cut = F.coalesce(*(F.nullif(F.instr(x["rest"], m), F.lit(0)) for m in PROMPT_TAILS))
        return let(F.struct(*(x[n].alias(n) for n in ("s", "before", "rest")), cut.alias("cut")), parts)

    def parts(x: Column) -> Column:
        found, cut, rest = x["before"] != "", x["cut"], x["rest"]
        code = F.when(cut.isNull(), rest).otherwise(F.left(rest, cut - 1))
        return F.struct(
            F.when(found, x["before"]).otherwise(x["s"]).alias("before"),
            F.when(found, F.regexp_replace(code, r"^\n+", "")).alias("code"),
            F.when(found & cut.isNotNull(), F.substr(rest, cut)).otherwise("").alias("after"),
        )

    return let(normalize_newlines(c), begun)


def shrunk_prompt(c: Column, size: Column, most: int, block_of) -> Column:
    """struct<input, status>: a prompt of over `most` tokens with its named function alone as code.

    block_of(code, name) gives the function's text, or null. status: short, no_function, no_code, no_match or changed.
    """
    name, parts = function_of_prompt(c), split_prompt(c)
    block = block_of(parts["code"], name)
    status = F.when(size <= most, "short").when(name.isNull(), "no_function").when(parts["code"].isNull(), "no_code").when(block.isNull(), "no_match").otherwise("changed")
    new = F.concat(F.regexp_replace(parts["before"], r"\s+$", ""), F.lit("\n"), strip(block), F.lit("\n"), F.regexp_replace(parts["after"], r"^\n+", ""))
    return F.struct(F.when(status == "changed", new).otherwise(c).alias("input"), status.alias("status"))


def case_distinct(xs: Column) -> Column:
    """The first of values that are equal but for case, in order."""
    return F.aggregate(xs, F.array().cast("array<string>"), lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))))


def option_list(value: str | None) -> list[str] | None:
    """A comma-separated option; 'none' and blanks are None."""
    parts = [x.strip() for x in (value or "").split(",") if x.strip()]
    return None if not parts or [x.lower() for x in parts] == ["none"] else parts
