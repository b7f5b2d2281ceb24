"""Making a lone source compile: stubs for the libraries it calls, plain types for those it does not declare.

Rewrites, in order: an interface of tokens where one is called and none declared; a library of safe arithmetic, and its
use in the first plain contract; declarations that create a contract lose what they create; types at the beginning of a
line that stand for tokens become that interface, other named types of members become addresses; and local variables of
undeclared types get a structure with the fields that are read of them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: calls that need a stub, the stubs, and words of a declaration -------------------------------------------
TOKEN_CALLS = (".transfer(", ".transferFrom(", ".approve(")
TOKEN_STUB = """interface IERC20 {
    function transfer(address to, uint256 value) external returns (bool);
    function transferFrom(address from, address to, uint256 value) external returns (bool);
    function approve(address spender, uint256 value) external returns (bool);
}
"""
MATH_CALLS = (".add(", ".sub(", ".mul(", ".div(")
MATH_STUB = """library SafeMath {
    function add(uint256 a, uint256 b) internal pure returns (uint256) {
        uint256 c = a + b;
        require(c >= a, "SafeMath: addition overflow");
        return c;
    }
    function sub(uint256 a, uint256 b) internal pure returns (uint256) {
        require(b <= a, "SafeMath: subtraction overflow");
        return a - b;
    }
    function mul(uint256 a, uint256 b) internal pure returns (uint256) {
        if (a == 0) {
            return 0;
        }
        uint256 c = a * b;
        require(c / a == b, "SafeMath: multiplication overflow");
        return c;
    }
    function div(uint256 a, uint256 b) internal pure returns (uint256) {
        require(b > 0, "SafeMath: division by zero");
        return a / b;
    }
}
"""
USING = "    using SafeMath for uint256;\n"
PLACES = {"memory", "storage", "calldata"}
VISIBILITIES = {"public", "private", "internal", "external"}
DECLARING = {"struct", "contract", "interface", "library", "enum"}
# ------------------------------------------------------------------------------------------------------------------
_WORD = re.compile(r"\w+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_PLAIN_CONTRACT = re.compile(r"\bcontract\s+[A-Za-z_][A-Za-z0-9_]*\s*\{\s*\n")
_USED = re.compile(r"\s*using\s+SafeMath\s+for\s+uint256;\s*\n")
_PRAGMA = re.compile(r"^\s*pragma\s+solidity\b[^\n]*\n", re.M)


def _stubbed(source: str, calls: tuple[str, ...], declared: str, stub: str) -> str:
    """The source with a stub behind its pragma, or before all, where it makes such calls and has no such declaration."""
    if declared in source or not any(c in source for c in calls):
        return source
    pragma = _PRAGMA.search(source)
    return f"{source[: pragma.end()]}\n{stub}{source[pragma.end() :]}" if pragma else stub + source


def _plain_line(line: str) -> str:
    """A line whose declared type needs nothing that is not there."""
    if "new " in line and ";" in line and "=" in line:
        kept = line[: line.index("=")].rstrip()
        line = kept if kept.endswith(";") else kept + ";"
    bare = line.lstrip()
    kind = _WORD.match(bare)
    if not kind or not "A" <= bare[0] <= "Z" or not kind[0].isascii():
        return line
    rest = bare[kind.end() :]
    said = _WORD.findall(rest)
    if PLACES & set(said):
        return line
    if "token" in (w.lower() for w in said) or kind[0].lower().endswith("token"):
        return "IERC20" + rest
    return "address" + rest if VISIBILITIES & set(said) else line


class Symbols:
    """What a source declares, which local variables have types that it does not, and which fields are read of a variable."""

    def __init__(self, source: str):
        self.declared: set[str] = set()
        self.locals: list[tuple[str, str]] = []
        self.fields: dict[str, set[str]] = {}
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(source)]
        gap = lambda i: source[words[i][2] : words[i + 1][1]] if i + 1 < len(words) else source[words[i][2] :]
        for i, (w, _, end) in enumerate(words):
            after = gap(i)
            if i + 1 < len(words):
                name = words[i + 1][0]
                if w in DECLARING and after and after.isspace() and _NAME.match(name):
                    self.declared.add(name)
                if after == "." and _NAME.match(name):
                    self.fields.setdefault(w, set()).add(name)
            if i >= 2 and words[i - 1][0] in PLACES and gap(i - 2).isspace() and gap(i - 1).isspace() and source[end:].lstrip()[:1] == ";":
                kind = words[i - 2][0]
                if "A" <= kind[0] <= "Z" and _NAME.match(kind) and _NAME.match(w):
                    self.locals.append((kind, w))

    def structures(self) -> str:
        """Structures of the undeclared types, each once, with the fields of its first variable."""
        out, known = [], set(self.declared)
        for kind, variable in self.locals:
            if kind not in known:
                known.add(kind)
                fields = sorted(self.fields.get(variable, ())) or ["_dummy"]
                out.append("\n".join([f"    struct {kind} {{", *(f"    uint256 {f};" for f in fields), "    }", ""]))
        return "\n".join(out)


def sanitized(source: str | None) -> str | None:
    """The source with the rewrites above; null or blank ones stay as they are."""
    if source is None or not source.strip():
        return source
    out = _stubbed(source, TOKEN_CALLS, "interface IERC20", TOKEN_STUB)
    safe = any(c in out for c in MATH_CALLS)
    out = _stubbed(out, MATH_CALLS, "library SafeMath", MATH_STUB)
    if safe and USING.strip().rstrip(";") not in out and (head := _PLAIN_CONTRACT.search(out)):
        out = out[: head.end()] + USING + out[head.end() :]
    out = "\n".join(map(_plain_line, out.splitlines()))
    head = _PLAIN_CONTRACT.search(out)
    if head and (made := Symbols(out).structures()):
        used = _USED.match(out, head.end())
        at = used.end() if used else head.end()
        out = out[:at] + made + out[at:]
    return out


@F.pandas_udf(StringType())
def _sanitized(source: pd.Series) -> pd.Series:
    return pd.Series([sanitized(s if isinstance(s, str) else None) for s in source], dtype=object)


def sanitize(source: Column) -> Column:
    """sanitized as a Column."""
    return _sanitized(source)
