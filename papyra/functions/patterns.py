"""LIKE and GLOB patterns as Java regular expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LIKE_SPECIAL = frozenset("\\^$.|?*+()[]{}")
_GLOB_SPECIAL = frozenset("\\^$.|+(){}")


def like_regex(pattern: str) -> str | None:
    """The expression for a LIKE pattern (% and _, no escape, any case); None without a wildcard: then it is plain equality."""
    if not any(ch in "%_" for ch in pattern):
        return None
    swap = {"%": ".*", "_": "."}
    body = "".join(swap.get(ch) or ("\\" + ch if ch in _LIKE_SPECIAL else ch) for ch in pattern)
    return f"(?iu)^{body}$"


def glob_regex(pattern: str) -> str | None:
    """The expression for a GLOB pattern (* ? and classes, case counts); None without a wildcard.

    A leading ! in a class is an ordinary member of it.
    """
    if not any(ch in "*?[" for ch in pattern):
        return None
    body, inside = [], False
    for ch in pattern:
        if ch == "[":
            inside = True
        elif ch == "]":
            inside = False
        elif not inside:
            ch = {"*": ".*", "?": "."}.get(ch) or ("\\" + ch if ch in _GLOB_SPECIAL else ch)
        body.append(ch)
    return f"^{''.join(body)}$"


def compiles(regex: str) -> bool:
    """Whether Java takes the expression; one that it doesn't matches nothing."""
    spark = SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(regex)
        return True
    except Exception:  # PatternSyntaxException, wrapped by the gateway
        return False
