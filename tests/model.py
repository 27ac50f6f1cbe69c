"""A plain Python model of predicate truth over documents, for comparison."""

from __future__ import annotations

import math
import re

from papyra.functions.patterns import glob_regex, like_regex
from papyra.functions.values import canonical, rank
from papyra.operators import predicates as P

MISSING = object()


def lookup(doc, path):
    now = doc
    for part in [p for p in path.split(".") if p]:
        if isinstance(now, dict) and part in now:
            now = now[part]
        elif isinstance(now, list) and part.isdigit() and int(part) < len(now):
            now = now[int(part)]
        else:
            return MISSING
    return MISSING if isinstance(now, (dict, list)) else now


def order(a, b):
    """-1, 0 or 1 for two values of one type class."""
    a, b = canonical(a), canonical(b)
    if isinstance(a, float) and math.isnan(a):
        return 0 if isinstance(b, float) and math.isnan(b) else 1
    if isinstance(b, float) and math.isnan(b):
        return -1
    return (a > b) - (a < b)


def same(a, b):
    return rank(a) == rank(b) and (a is None or order(a, b) == 0)


def truth(p, doc):
    if isinstance(p, P.And):
        return all(truth(x, doc) for x in p.parts)
    if isinstance(p, P.Or):
        return any(truth(x, doc) for x in p.parts)
    if isinstance(p, P.Not):
        return not truth(p.part, doc)
    v = lookup(doc, p.field)
    if isinstance(p, P.Exists):
        return v is not MISSING
    if isinstance(p, P.Compare) and p.op == "ne":
        return v is MISSING or not same(v, p.value)
    if v is MISSING:
        return False
    if isinstance(p, P.In):
        return any(same(v, x) for x in p.values)
    if isinstance(p, P.Between):
        return truth(P.at_least(p.field, p.low), doc) and truth(P.at_most(p.field, p.high), doc)
    if isinstance(p, P.Compare):
        if p.op == "eq":
            return same(v, p.value)
        if v is None or rank(v) != rank(p.value):
            return False
        c = order(v, p.value)
        return {"lt": c < 0, "le": c <= 0, "gt": c > 0, "ge": c >= 0}[p.op]
    if not isinstance(v, str):
        return False
    if p.op in ("like", "glob"):
        regex = (like_regex if p.op == "like" else glob_regex)(p.pattern)
        if regex is None:
            return v == p.pattern
        return re.search(regex.replace("(?iu)", "(?i)"), v) is not None
    return {"contains": p.pattern in v, "starts": v.startswith(p.pattern), "ends": v.endswith(p.pattern)}[p.op]
