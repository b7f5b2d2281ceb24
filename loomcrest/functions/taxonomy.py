"""Label taxonomies as rule tables and the Column functions that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
#: weakness number -> phrases that name it exactly, after key()
SWC_EXACT = {
    101: ["arithmetic", "arithmetic error", "integer overflow", "integer underflow", "integer overflow underflow", "integer overflow/underflow"],
    104: ["unchecked call", "unchecked call return value", "unchecked return", "unchecked return value", "unchecked low level calls"],
    106: ["selfdestruct", "unchecked selfdestruct", "contract destruction"],
    107: ["reentrancy", "reentrancy eth"],
    109: ["uninitialized storage", "uninitialized storage pointer"],
    110: ["assert violation"],
    112: ["delegatecall"],
    114: ["front running", "transaction ordering dependence", "tod"],
    115: ["tx origin", "tx.origin"],
    116: ["timestamp dependence", "timestamp manipulation", "time manipulation", "miner manipulation"],
    117: ["signature malleability"],
    120: ["bad randomness", "weak randomness"],
    121: ["signature replay", "replay attack"],
    122: ["signature verification flaw", "improper signature verification"],
    124: ["storage corruption", "storage collision", "arbitrary storage write"],
    132: ["forced ether reception", "unexpected ether balance"],
    133: ["hash collision risk", "hash collisions"],
}
#: weakness number -> alternatives, each a list of substrings that must all occur
SWC_CONTAINS = {
    101: [["overflow"], ["underflow"], ["division"], ["rounding"], ["truncation"], ["precision"], ["arithmetic"], ["math"]],
    104: [["unchecked", "call"], ["unchecked", "return"], ["low level call"]],
    106: [["selfdestruct"]],
    107: [["reentr"]],
    109: [["uninitialized", "storage"]],
    110: [["assert"]],
    111: [["deprecated"], ["throw"]],
    112: [["delegatecall"]],
    113: [["dos"], ["denial of service"], ["failed send"], ["failed call"]],
    114: [["front run"], ["transaction ordering"]],
    115: [["tx origin"], ["tx.origin"]],
    116: [["timestamp"], ["time manipulation"], ["miner manipulation"], ["block variable"]],
    117: [["signature malleability"]],
    120: [["random"], ["prng"], ["predictable"]],
    121: [["replay", "signature"]],
    122: [["signature verification"]],
    124: [["storage corruption"], ["storage collision"], ["state variable overwrite"], ["state variable corruption"], ["arbitrary write"], ["arbitrary storage"], ["out of bounds write"]],
    126: [["gas grief"]],
    128: [["block gas"], ["gas limit"], ["unbounded loop"], ["infinite loop"], ["gas exhaustion"]],
    132: [["forced ether"], ["unexpected ether"]],
    133: [["hash collision"]],
}
#: bucket -> weakness numbers, in order; ACCESS_CONTROL is found by phrase
BUCKETS = {
    "REENTRANCY": [107],
    "ACCESS_CONTROL": [],
    "UNCHECKED_CALL": [104],
    "ARITHMETIC": [101],
    "BAD_RANDOMNESS": [120],
    "TIMESTAMP_DEPENDENCE": [116],
    "DOS": [113, 126, 128],
    "STORAGE": [109, 124],
}
ACCESS_PHRASES = ["access control", "authorization", "authentication", "privilege", "onlyowner", "missing access control"]
SEVERITY = {"High": 9.0, "Medium": 6.0, "Low": 3.0, "Informational": 1.0, "Optimization": 1.0}
SEVERITY_ADJUSTMENT = {"reentrancy": 1, "delegatecall": 1, "access_control": 1, "arithmetic": 0, "unchecked_call": 0, "gas_optimization": -2, "code_quality": -2}
SEVERITY_RANK = {"High": 4, "Medium": 3, "Low": 2, "Informational": 1, "Optimization": 0}
INJECTED = {
    "Re-entrancy": "reentrancy",
    "Timestamp-Dependency": "time_manipulation",
    "Unhandled-Exceptions": "unchecked_low_level_calls",
    "Unchecked-Send": "unchecked_low_level_calls",
    "TOD": "front_running",
    "Overflow-Underflow": "arithmetic",
    "tx.origin": "access_control",
}
#: key -> category, least votes, finding tokens, kind of location
VOTE_SPECS = [
    ("ARITHMETIC_OVERFLOW_UNDERFLOW", "arithmetic", 2, ["ARTHM"], "line"),
    ("DENIAL_OF_SERVICE", "denial_of_service", 1, ["DOS"], "line"),
    ("REENTRANCY", "reentrancy", 2, ["RENT"], "function"),
    ("TIME_MANIPULATION", "time_manipulation", 2, ["TimeM"], "line"),
    ("TIMESTAMP_ORDERING", "front_running", 1, ["TimeO"], "line"),
    ("TX_ORIGIN_AUTHORIZATION", "access_control", 2, ["Tx-Origin", "TX-Origin"], "line"),
    ("UNCHECKED_CALL_RETURN_VALUE", "unchecked_low_level_calls", 1, ["UE"], "line"),
]
# ------------------------------------------------------------------------------------------------------------------


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), default if default is not None else F.lit(None))


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once a row, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def key(c: Column) -> Column:
    """Lower case, blanks for '_' and '-', single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), r"\s+", " "))


def swc_name(n: int) -> str:
    return f"SWC-{n:03d}"


def as_swc(c: Column) -> Column:
    """'SWC-ddd' or up to three digits as an identifier, else null."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"^SWC-\d{3}$"), t).when(t.rlike(r"^\d{1,3}$"), F.concat(F.lit("SWC-"), F.lpad(t, 3, "0")))


def swc_of(c: Column) -> Column:
    """Identifiers of one phrase: itself, else its exact entry, else every rule that holds."""
    return let(key(c), lambda k: _swc_of(k, as_swc(c)))


def _swc_of(k: Column, own: Column) -> Column:
    exact = lookup({p: swc_name(n) for n, ps in SWC_EXACT.items() for p in ps}, k)
    any_of = lambda alternatives: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(k, F.lit(w)) for w in ws)) for ws in alternatives))
    rules = F.array_compact(F.array(*(F.when(any_of(alternatives), swc_name(n)) for n, alternatives in SWC_CONTAINS.items())))
    return F.when(own.isNotNull(), F.array(own)).when(exact.isNotNull(), F.array(exact)).otherwise(F.coalesce(rules, F.array().cast("array<string>")))


def swc_ids(types: Column, exclude: list[str] | None = None) -> Column:
    """Sorted identifiers of all phrases, minus the excluded ('101' or 'SWC-101')."""
    found = F.flatten(F.transform(types, swc_of))
    out = [e if e.startswith("SWC-") else swc_name(int(e)) for e in exclude or []]
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, out))) if out else found))


def buckets(types: Column, ids: Column | None = None, keep_original: bool = True) -> Column:
    """The buckets, in their order; where none holds, the types themselves (or OTHER)."""
    return let(swc_ids(types) if ids is None else ids, lambda x: _buckets(types, x, keep_original))


def _buckets(types: Column, ids: Column, keep_original: bool) -> Column:
    spaced = F.transform(types, lambda t: F.translate(F.lower(t), "_-", "  "))
    access = F.exists(spaced, lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in ACCESS_PHRASES)))
    hit = {b: F.arrays_overlap(ids, F.array(*(F.lit(swc_name(n)) for n in ns))) if ns else access for b, ns in BUCKETS.items()}
    found = F.array_compact(F.array(*(F.when(h, b) for b, h in hit.items())))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(types if keep_original else F.array(F.lit("OTHER"))))


def primary_bucket(found: Column, sizes: dict[str, int] | None = None) -> Column:
    """The first bucket in order, or the rarest by sizes (ties by order); OTHER without one."""
    order = list(BUCKETS)
    sizes = sizes or {}
    ranked = F.filter(F.array(*(F.struct(F.lit(sizes.get(b, 10**9) if sizes else 0).alias("size"), F.lit(i).alias("at"), F.lit(b).alias("bucket")) for i, b in enumerate(order))), lambda x: F.array_contains(found, x["bucket"]))
    return F.coalesce(F.array_min(ranked)["bucket"], F.lit("OTHER"))


def _by_kind(table: dict[str, object], kind: Column, default) -> Column:
    """The value of the first key that the kind contains or that contains the kind; blanks and '-' count as '_'."""
    k = F.translate(F.lower(kind), " -", "__")
    out = F.lit(default) if not isinstance(default, Column) else default
    for name, value in reversed(table.items()):
        out = F.when(F.contains(k, F.lit(name)) | F.contains(F.lit(name), k), value).otherwise(out)
    return out


def severity_score(word: Column, kind: Column) -> Column:
    """Score of the severity word (as it is written), adjusted by kind; 0 to 10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), lookup(SEVERITY, word, F.lit(5.0)) + _by_kind(SEVERITY_ADJUSTMENT, kind, 0)))


def most_severe(findings: Column, rank_field: str = "severity") -> Column:
    """Of array<struct>, the first of highest rank."""
    ranked = F.transform(findings, lambda x, i: F.struct((-lookup(SEVERITY_RANK, x[rank_field], F.lit(2))).alias("r"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def most_severe_row(row: Column, severity: Column, order: Column) -> Column:
    """An aggregate: of a group's rows the first, by order, of highest rank."""
    return F.min_by(row, F.struct((-lookup(SEVERITY_RANK, severity, F.lit(2))).alias("r"), order.alias("o")))


# --- fixed values: canonical types, the first rule that holds decides -------------------------------------------------
CANONICAL_EXACT = {
    "REENTRANCY": ["reentrancy"],
    "ACCESS_CONTROL": ["access control", "authorization", "auth"],
    "ARITHMETIC": ["integer overflow/underflow", "integer overflow", "integer underflow", "overflow", "underflow", "arithmetic", "arithmetic error"],
    "UNCHECKED_CALL": ["unchecked low level calls", "unchecked call", "unchecked return value"],
    "BAD_RANDOMNESS": ["bad randomness", "predictable game outcome", "weak randomness"],
    "FRONT_RUNNING": ["front running", "transaction ordering dependence", "tod"],
    "DOS": ["denial of service", "dos"],
    "TX_ORIGIN": ["tx.origin", "tx origin"],
    "TIMESTAMP_DEPENDENCE": ["timestamp dependence", "block.timestamp dependence", "time manipulation", "miner manipulation"],
    "DELEGATECALL": ["delegatecall"],
    "UNINITIALIZED_STORAGE": ["uninitialized storage pointer", "uninitialized storage", "uninitialized state"],
    "STORAGE_CORRUPTION": ["storage corruption"],
}
CANONICAL_CONTAINS = {
    "REENTRANCY": [["reentr"]],
    "ACCESS_CONTROL": [["access control"], ["authorization"], ["authentication"]],
    "ARITHMETIC": [["overflow"], ["underflow"], ["precision"], ["division"], ["rounding"], ["truncation"], ["arithmetic"], ["math"], ["calculation"]],
    "UNCHECKED_CALL": [["unchecked"], ["low level call"], ["external call"], ["call return"], ["send"], ["transfer"]],
    "BAD_RANDOMNESS": [["random"], ["prng"], ["predictable"]],
    "FRONT_RUNNING": [["front run"], ["transaction ordering"]],
    "DOS": [["denial of service"], ["gas exhaustion"], ["gas grief"], ["gas consumption"], ["unbounded loop"], ["infinite loop"], ["gas limit"]],
    "TX_ORIGIN": [["tx.origin"], ["tx origin"]],
    "TIMESTAMP_DEPENDENCE": [["timestamp"], ["time manipulation"], ["miner manipulation"], ["block variable"]],
    "DELEGATECALL": [["delegatecall"]],
    "UNINITIALIZED_STORAGE": [["uninitialized", "storage"], ["uninitialized", "state"], ["uninitialized", "init"]],
    "STORAGE_CORRUPTION": [["storage", "corruption"], ["storage", "collision"], ["storage", "overwrite"], ["storage", "out of bounds"]],
}
SEVERITY_ESTIMATE = {"reentrancy": 9, "access_control": 8, "delegatecall": 9, "arithmetic": 7, "unchecked_call": 6, "tx_origin": 7, "timestamp_dependence": 5, "uninitialized_storage": 8, "dos": 6, "front_running": 6}
# ------------------------------------------------------------------------------------------------------------------


def canonical_type(c: Column) -> Column:
    """One of the canonical types: exact phrase, else the first rule that holds, else the phrase's own slug if it is one; null otherwise."""

    def of(k: Column) -> Column:
        exact = lookup({p: t for t, ps in CANONICAL_EXACT.items() for p in ps}, k)
        slug = F.upper(F.regexp_replace(F.regexp_replace(k, r"[^a-z0-9]+", "_"), "^_+|_+$", ""))
        rules = F.lit(None).cast("string")
        for t, alternatives in reversed(CANONICAL_CONTAINS.items()):
            holds = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(k, F.lit(w)) for w in ws)) for ws in alternatives))
            if t == "ACCESS_CONTROL":
                holds = holds | F.startswith(k, F.lit("auth "))
            rules = F.when(holds, t).otherwise(rules)
        return F.coalesce(exact, rules, F.when(slug.isin(*CANONICAL_EXACT), slug))

    return let(key(c), of)


def canonical_types(types: Column) -> Column:
    """Each canonical type once, in first-seen order."""
    return F.array_distinct(F.array_compact(F.transform(types, canonical_type)))


def severity_estimate(kind: Column) -> Column:
    """Estimate of the first type that contains the kind or lies in it; 5 without one."""
    return _by_kind(SEVERITY_ESTIMATE, kind, 5)


# --- fixed values: a sentence a type, the severity of injected and of found weaknesses ---------------------------------------
REASONS = {
    "reentrancy": "The function performs external calls before updating state variables, which may allow reentrancy attacks.",
    "access_control": "The function lacks proper access control checks, allowing unauthorized users to execute sensitive operations.",
    "arithmetic": "The function contains arithmetic operations that may overflow or underflow.",
    "unchecked_call": "The function makes external calls without checking the return value.",
    "delegatecall": "The function uses delegatecall which may lead to unintended code execution.",
    "tx_origin": "The function uses tx.origin for authorization, which is vulnerable to phishing attacks.",
    "timestamp_dependence": "The function relies on block.timestamp which can be manipulated by miners.",
    "uninitialized_storage": "The function uses uninitialized storage variables.",
}
#: weakness number -> its title
SWC_TITLES = {
    101: "Integer Overflow and Underflow",
    104: "Unchecked Call Return Value",
    106: "Unprotected SELFDESTRUCT Instruction",
    107: "Reentrancy",
    109: "Uninitialized Storage Pointer",
    110: "Assert Violation",
    111: "Use of Deprecated Solidity Functions",
    112: "Delegatecall to Untrusted Callee",
    113: "DoS with Failed Call",
    114: "Transaction Order Dependence",
    115: "Authorization through tx.origin",
    116: "Block values as a proxy for time",
    117: "Signature Malleability",
    120: "Weak Sources of Randomness from Chain Attributes",
    121: "Missing Protection against Signature Replay Attacks",
    122: "Lack of Proper Signature Verification",
    124: "Write to Arbitrary Storage Location",
    126: "Insufficient Gas Griefing",
    128: "DoS With Block Gas Limit",
    132: "Unexpected Ether Balance",
    133: "Hash Collisions With Multiple Variable Length Arguments",
}
#: weakness number -> alternatives of the looser rules, each a list of substrings that must all occur ("=tod": the whole phrase)
SWC_LOOSE = {
    101: [["overflow"], ["underflow"], ["arithmetic"]],
    104: [["unchecked", "call"], ["unchecked", "return"]],
    106: [["selfdestruct"], ["contract destruction"]],
    107: [["reentr"]],
    109: [["uninitialized storage"], ["storage pointer misuse"]],
    110: [["assert"]],
    111: [["deprecated"], ["throw"]],
    112: [["delegatecall"]],
    113: [["dos"], ["denial of service"], ["failed send"], ["failed call"]],
    114: [["front run"], ["transaction ordering"], ["=tod"]],
    115: [["tx origin"], ["tx.origin"]],
    116: [["timestamp"], ["time manipulation"], ["miner manipulation"], ["block variable"]],
    117: [["signature malleability"]],
    120: [["random"], ["prng"], ["predictable"]],
    121: [["replay attack"], ["signature replay"]],
    122: [["signature verification"]],
    124: [["arbitrary storage write"], ["write to arbitrary storage"], ["arbitrary write"], ["storage corruption"], ["storage collision"], ["out of bounds write"], ["state variable overwrite"], ["state variable corruption"]],
    126: [["gas grief"]],
    128: [["block gas"], ["gas limit"], ["gas exhaustion"], ["unbounded loop"], ["infinite loop"]],
    132: [["forced ether reception"], ["unexpected ether"]],
    133: [["hash collision"]],
}
# ------------------------------------------------------------------------------------------------------------------


def reason(kind: Column) -> Column:
    """The sentence of the first type that contains the kind or lies in it, else one with the kind's own name."""
    return _by_kind(REASONS, kind, F.concat(F.lit("The function contains a "), kind, F.lit(" vulnerability.")))


def swc_loose(c: Column) -> Column:
    """Sorted identifiers of every looser rule that holds for a phrase."""
    test = lambda k, w: k == w[1:] if w[0] == "=" else F.contains(k, F.lit(w))
    holds = lambda k, alternatives: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (test(k, w) for w in ws)) for ws in alternatives))
    return let(key(c), lambda k: F.array_compact(F.array(*(F.when(holds(k, alternatives), swc_name(n)) for n, alternatives in SWC_LOOSE.items()))))


def swc_title(c: Column) -> Column:
    return lookup({swc_name(n): t for n, t in SWC_TITLES.items()}, c)


def type_list(types: Column, details: Column, single: Column) -> Column:
    """The sorted different types of a label: its list, else its details' (array<struct<type>>), else its one type."""
    empty = F.array().cast("array<string>")
    named = F.transform(details, lambda d: d["type"])
    found = F.when(F.coalesce(F.size(types), F.lit(0)) > 0, types).when(F.coalesce(F.size(details), F.lit(0)) > 0, named).when(F.coalesce(single, F.lit("")) != "", F.array(single)).otherwise(empty)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: F.coalesce(t, F.lit("")) != "")))


def injected_type(c: Column) -> Column:
    """The standard name of an injected bug's folder; 'other' without one."""
    return lookup(INJECTED, c, F.lit("other"))
