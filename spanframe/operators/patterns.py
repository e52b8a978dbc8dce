"""Token patterns: from what a user writes to Columns. Done once, on the driver; executors only see expressions.

A pattern is {"label", "pattern", "id"?}: a phrase if pattern is a string or a list of words, else a list of token
descriptions such as {"LOWER": {"IN": ["a", "b"]}, "OP": "+"}. An empty description matches any token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions import ids, lexical

ALIASES = {"TEXT": "ORTH", "IS_SENT_START": "SENT_START"}
STRINGS = ("ORTH", "LOWER", "NORM", "PREFIX", "SUFFIX", "SHAPE", "LEMMA", "POS", "TAG", "DEP", "ENT_TYPE", "ENT_ID", "ENT_KB_ID", "MORPH")
REGEX_ATTRIBUTES = ("ORTH", "LOWER", "PREFIX", "SUFFIX", "SHAPE", "NORM", "LEMMA", "POS", "TAG", "DEP", "MORPH")
BOOLEANS = (*lexical.FLAGS, "IS_STOP", "SENT_START", "SPACY")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
MORE = 1 << 30


@dataclass(frozen=True)
class Step:
    """A token's predicate and how often it comes; negated: one token that doesn't fulfil it."""

    test: dict
    least: int = 1
    most: int = 1
    negated: bool = False


@dataclass(frozen=True)
class Pattern:
    label: str
    ent_id: str = ""
    phrase: tuple[str, ...] | None = None
    #: The phrase's words are ids, as bundles have them.
    by_id: bool = False
    steps: tuple[Step, ...] = field(default=())


def quantifier(op: str | None) -> tuple[int, int, bool]:
    """(least, most, negated) of 1 ! ? * + {n} {n,m} {n,} {,m}."""
    plain = {None: (1, 1, False), "1": (1, 1, False), "!": (1, 1, True), "?": (0, 1, False), "*": (0, MORE, False), "+": (1, MORE, False)}
    if op in plain:
        return plain[op]
    m = re.fullmatch(r"\{(\d*)(,?)(\d*)\}", op or "")
    if not m or not (m[1] or m[3]):
        raise ValueError(f"no such quantifier: {op!r}")
    least = int(m[1] or 0)
    most = int(m[3]) if m[3] else MORE if m[2] else least
    if least > most:
        raise ValueError(f"a quantifier's bounds are reversed: {op!r}")
    return least, most, False


def normalize(raw: dict | Pattern) -> Pattern:
    """A user's pattern, checked; one from a bundle is made already."""
    if isinstance(raw, Pattern):
        return raw
    label, ident, body = raw.get("label"), raw.get("id", ""), raw.get("pattern")
    if not isinstance(label, str) or not label:
        raise ValueError("a pattern needs a label")
    if not isinstance(ident, str):
        raise ValueError("a pattern's id is a string")
    if isinstance(body, str):
        body = body.split()
    if not body or not isinstance(body, list):
        raise ValueError(f"the pattern of {label} is empty")
    if all(isinstance(x, str) for x in body):
        return Pattern(label, ident, phrase=tuple(body))
    steps = []
    for token in body:
        if not isinstance(token, dict):
            raise ValueError(f"the pattern of {label} mixes words and token descriptions")
        test: dict = {}
        for name, value in token.items():
            if name == "OP":
                continue
            key = ALIASES.get(name.upper(), name.upper())
            if key in test:
                raise ValueError(f"{key} comes twice in a token of {label}")
            test[key] = value
            compile_test({key: value})
        steps.append(Step(test, *quantifier(token.get("OP"))))
    return Pattern(label, ident, steps=tuple(steps))


def attribute(name: str) -> Column:
    """An attribute of the flat token table; columns that the table may lack are asked for by name."""
    t = F.col("text")
    made = {"ORTH": t, "LOWER": F.lower(t), "PREFIX": lexical.prefix(t), "SUFFIX": lexical.suffix(t), "SHAPE": lexical.shape(t), "LENGTH": F.length(t)}
    if name in made:
        return made[name]
    if name == "NORM":
        return F.coalesce(F.nullif(F.col("norm"), F.lit("")), F.lower(t))
    return F.coalesce(F.col(name.lower()), F.lit("")) if name != "ENT_IOB" else F.col("ent_iob")


def flag(name: str) -> Column:
    if name == "SPACY":
        return F.col("has_space")
    if name == "SENT_START":
        return (F.col("sent_start") == 1) | (F.col("idx") == 0)
    if name == "IS_STOP":
        return F.col("is_stop")
    return lexical.FLAGS[name](F.col("text"))


def _java(pattern: str) -> str:
    """$ and \\Z match before a last newline in Java; \\z is the end."""
    return re.sub(r"((?:^|[^\\])(?:\\\\)*)\$", r"\1\\z", pattern).replace(r"\Z", r"\z")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _strings(value, what: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{what} needs a list of strings")
    return value


def compare_string(name: str, value) -> Column:
    a = attribute(name)
    if isinstance(value, str):
        return lexical.has_shape(F.col("text"), value) if name == "SHAPE" else a == value
    if not isinstance(value, dict) or len(value) != 1:
        raise ValueError(f"{name} needs one comparison")
    ((op, v),) = value.items()
    fuzzy = re.fullmatch(r"FUZZY([1-9]?)", op)
    if op in ("IN", "NOT_IN"):
        hit = a.isin(*_strings(v, op)) if v else F.lit(False)
        return hit if op == "IN" else ~hit
    if op == "REGEX" or fuzzy:
        if op == "REGEX" and name not in REGEX_ATTRIBUTES:
            raise ValueError(f"{name} has no REGEX")
        edits = int(fuzzy[1]) if fuzzy and fuzzy[1] else None
        one = (lambda p: a.rlike(_java(p))) if op == "REGEX" else (lambda p: lexical.fuzzy_match(a, p, edits))
        if isinstance(v, str):
            return one(v)
        if isinstance(v, dict) and len(v) == 1 and next(iter(v)) in ("IN", "NOT_IN"):
            ((inner, values),) = v.items()
            hit = _any([one(p) for p in _strings(values, inner)])
            return hit if inner == "IN" else ~hit
        raise ValueError(f"{op} needs a string, or IN or NOT_IN")
    if op in ("IS_SUBSET", "IS_SUPERSET", "INTERSECTS"):
        values = _strings(v, op)
        if name == "MORPH":
            have, want = F.col("morph_features"), F.array(*map(F.lit, values)).cast("array<string>")
            if op == "IS_SUBSET":
                return F.size(F.array_except(have, want)) == 0
            if op == "IS_SUPERSET":
                return F.size(F.array_except(want, have)) == 0
            return F.coalesce(F.arrays_overlap(have, want), F.lit(False))
        if op == "IS_SUPERSET":
            return F.lit(True) if not values else a == values[0] if len(set(values)) == 1 else F.lit(False)
        return a.isin(*values) if values else F.lit(False)
    raise ValueError(f"{name} has no comparison {op}")


def compare_length(value) -> Column:
    a = F.length(F.col("text"))
    if isinstance(value, bool):
        raise ValueError("LENGTH needs a number")
    if isinstance(value, (int, float)):
        return a == value
    if not isinstance(value, dict) or not value:
        raise ValueError("LENGTH needs a number or a comparison")
    out = []
    for op, v in value.items():
        if op in _COMPARE and isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            out.append(_COMPARE[op](a.cast("double"), F.lit(float(v))))
        elif op in ("IN", "NOT_IN") and isinstance(v, list) and all(isinstance(x, int) and not isinstance(x, bool) for x in v):
            hit = a.isin(*v) if v else F.lit(False)
            out.append(hit if op == "IN" else ~hit)
        else:
            raise ValueError(f"LENGTH has no comparison {op} with {v!r}")
    return reduce(lambda a, b: a & b, out)


def compare_iob(value) -> Column:
    codes = {"": 0, "I": 1, "O": 2, "B": 3, 0: 0, 1: 1, 2: 2, 3: 3}
    negated = False
    if isinstance(value, dict):
        if len(value) != 1 or next(iter(value)) not in ("IN", "NOT_IN"):
            raise ValueError("ENT_IOB has IN and NOT_IN")
        ((op, value),) = value.items()
        negated = op == "NOT_IN"
    values = value if isinstance(value, list) else [value]
    if any(isinstance(v, bool) or v not in codes for v in values):
        raise ValueError(f"no such ENT_IOB: {value!r}")
    hit = F.col("ent_iob").isin(*[codes[v] for v in values]) if values else F.lit(False)
    return ~hit if negated else hit


def compile_test(test: dict) -> Column:
    """All of a token's constraints; no constraint is a wildcard."""
    out = []
    for name, value in test.items():
        if name == "CONSTRAINTS":
            out += [compile_constraint(c) for c in value]
        elif name in BOOLEANS:
            if not isinstance(value, bool):
                raise ValueError(f"{name} is true or false")
            out.append(flag(name) if value else ~flag(name))
        elif name == "LENGTH":
            out.append(compare_length(value))
        elif name == "ENT_IOB":
            out.append(compare_iob(value))
        elif name in STRINGS:
            out.append(compare_string(name, value))
        else:
            raise ValueError(f"no such attribute: {name}")
    return F.coalesce(reduce(lambda a, b: a & b, out), F.lit(False)) if out else F.lit(True)


def apart(test: Column) -> Column:
    """The same, but what computes it isn't fused into one method for the whole stage. The tests of some rules make that larger
    than the JVM compiles, and it is interpreted then; unfused, expressions are cut into small methods."""
    return F.transform(F.array(F.lit(0)), lambda _: test)[0]


def attribute_id(name: str) -> Column:
    """An attribute's value as bundles compare it: a string's id, a number or a truth value."""
    if name in BOOLEANS:
        return flag(name).cast("bigint")
    return (F.length("text") if name == "LENGTH" else F.col("ent_iob")).cast("bigint") if name in ("LENGTH", "ENT_IOB") else ids.string_id(attribute(name))


def signed(value: int) -> int:
    """An unsigned id as the BIGINT with the same bits."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 64:
        raise ValueError(f"{value!r} is no id")
    return value - (1 << 64) if value >> 63 else value


def check_constraint(c: dict) -> None:
    """Whether compile_constraint() takes it: an error if not."""
    kind, name = c["kind"], ALIASES.get(c["attribute"], c["attribute"])
    kinds = {"boolean": ("value",), "iob": ("values", "negate"), "regex": ("pattern",), "regex_set": ("patterns", "negate"), "fuzzy": ("pattern",), "fuzzy_set": ("patterns", "negate"), "numeric": ("comparison", "value"), "numeric_set": ("values", "negate"), "morph_set": ("comparison", "features"), "id_set_relation": ("comparison", "values"), "equal": ("values",), "in": ("values",), "not_in": ("values",)}
    if kind not in kinds or any(k not in c for k in kinds[kind]):
        raise ValueError(f"the constraint {kind} lacks something, or isn't known")
    if name not in (BOOLEANS if kind == "boolean" else ("ENT_IOB",) if kind == "iob" else ("LENGTH",) if kind.startswith("numeric") else ("MORPH",) if kind == "morph_set" else (*STRINGS, "LENGTH", *BOOLEANS) if kind in ("id_set_relation", "equal", "in", "not_in") else REGEX_ATTRIBUTES):
        raise ValueError(f"{name} has no constraint {kind}")
    for k in ("pattern", *(["patterns"] if "patterns" in c else [])):
        for p in (c.get(k) or []) if k == "patterns" else [c[k]] if k in c else []:
            if not isinstance(p, str):
                raise ValueError(f"{p!r} is no string")
            if kind.startswith("regex"):
                re.compile(p)
    for v in c.get("values", []) if kind in ("id_set_relation", "equal", "in", "not_in") else c.get("features", []):
        signed(v)


def compile_constraint(c: dict) -> Column:
    """A constraint as bundles have it: attribute, kind, and what the kind needs; strings are ids where they are compared for equality."""
    check_constraint(c)
    kind, name = c["kind"], ALIASES.get(c["attribute"], c["attribute"])
    if kind == "boolean":
        return flag(name) if c["value"] else ~flag(name)
    if kind == "iob":
        return compare_iob({"NOT_IN" if c["negate"] else "IN": c["values"]})
    if kind in ("regex", "regex_set"):
        return compare_string(name, {"REGEX": c["pattern"] if kind == "regex" else {"NOT_IN" if c["negate"] else "IN": c["patterns"]}})
    if kind in ("fuzzy", "fuzzy_set"):
        most = c.get("max_edits")
        return compare_string(name, {f"FUZZY{most or ''}": c["pattern"] if kind == "fuzzy" else {"NOT_IN" if c["negate"] else "IN": c["patterns"]}})
    if kind == "numeric":
        return compare_length({c["comparison"]: c["value"]})
    if kind == "numeric_set":
        return compare_length({"NOT_IN" if c["negate"] else "IN": c["values"]})
    if kind == "morph_set":
        have, want = ids.string_ids(F.col("morph_features")), F.array(*[F.lit(signed(x)) for x in c["features"]]).cast("array<bigint>")
        relation = c["comparison"].upper()
        if relation in ("IS_SUBSET", "SUBSET"):
            return F.size(F.array_except(have, want)) == 0
        if relation in ("IS_SUPERSET", "SUPERSET"):
            return F.size(F.array_except(want, have)) == 0
        return F.coalesce(F.arrays_overlap(have, want), F.lit(False))
    a, values = attribute_id(name), [signed(x) for x in c["values"]]
    if kind == "id_set_relation" and c["comparison"].upper() in ("IS_SUPERSET", "SUPERSET"):
        return F.lit(True) if not values else a == values[0] if len(set(values)) == 1 else F.lit(False)
    hit = a.isin(*values) if values else F.lit(False)
    return ~hit if kind == "not_in" else hit
