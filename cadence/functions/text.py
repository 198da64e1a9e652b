"""Scalar text helpers of the ingest layer, as built-in column expressions.

Every helper is JVM-side and codegen'd but one: rich-text documents of any
depth are walked in a small Arrow UDF.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import col_

# ── fixed values ─────────────────────────────────────────────────────────────
# Acceptance-criteria markers, tried in this list order (not by position).
AC_MARKERS = ("acceptance criteria", "acceptance criterion", "ac:", "given ", "scenario:")
# Status names that count as "done" for the first-done transition.
DONE_STATUSES = ("done", "closed", "resolved")
# Substring that marks an "in progress" transition.
IN_PROGRESS_MARK = "in progress"
# Characters removed by Python's str.strip(): built from the rule, not listed.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Accepted timestamp shapes: full with fraction and zone, without fraction, date only.
TS_SHAPE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2}))?$"
# Imputation constants: default seconds when nothing is logged, seconds per
# 3 points, floor of the result.
IMPUTE_DEFAULT_SECONDS = 9600
IMPUTE_SECONDS_PER_3_POINTS = 28800
IMPUTE_MIN_POINTS = 1


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: trim Python whitespace from both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def parse_ts(c: str | Column) -> Column:
    """Parse the three accepted shapes to an instant; anything else is NULL.

    ``try_cast`` alone would also accept looser forms (``2024-01``, times
    without a zone), so the shape is checked first. Date-only text is UTC
    midnight.
    """
    s = col_(c)
    return F.when(s.rlike(TS_SHAPE), s.try_cast("timestamp"))


def is_falsy_text(c: str | Column) -> Column:
    """Python falsiness of a landed scalar read as text: NULL, '' or numeric zero."""
    s = col_(c)
    return s.isNull() | (s == "") | (F.coalesce(s.try_cast("double"), F.lit(1.0)) == 0)


def story_points(configured: str | Column, fallback: str | Column) -> Column:
    """``float(a or b)``; a non-numeric ``a`` gives NULL without falling back."""
    a, b = col_(configured), col_(fallback)
    chosen = F.when(is_falsy_text(a), b).otherwise(a)
    return F.trim(chosen).try_cast("double")


def acceptance_criteria(
    dedicated: str | Column,
    description: str | Column,
    markers: tuple[str, ...] | list[str] = AC_MARKERS,
) -> Column:
    """Dedicated field if non-empty, else the description from the first marker found.

    Markers are tried in list order; the match is case-insensitive and the
    remainder is stripped. The whole description is searched.
    """
    d = col_(description)
    low = F.lower(d)
    from_desc = None
    for m in markers:
        pos = F.locate(m, low)
        piece = F.when(pos > 0, py_strip(F.substr(d, pos)))
        from_desc = piece if from_desc is None else F.coalesce(from_desc, piece)
    if from_desc is None:
        from_desc = F.lit(None).cast("string")
    ded = col_(dedicated)
    return F.when(ded.isNotNull() & (ded != ""), extract_text_exact(ded)).when(d.isNotNull() & (d != ""), from_desc)


def added_mid_sprint(created: str | Column, sprint_start: str | Column) -> Column:
    """Created after the sprint started; FALSE when either side is NULL."""
    return F.coalesce(col_(created) > col_(sprint_start), F.lit(False))


def impute_points(points: str | Column, time_spent: str | Column, estimate: str | Column) -> Column:
    """Points from logged time: three points per 8 h, one decimal, at least 1.

    The seconds used are time spent, else the original estimate (zeros count
    as missing), else the default. Applied where points are NULL or time was
    logged. Exact decimal arithmetic (divide, then multiply, then round half
    up) keeps ties such as 13 920 s → 1.4 that binary doubles would flip.
    """
    sp, ts, est = col_(points), col_(time_spent), col_(estimate)
    seconds = F.coalesce(F.nullif(ts, F.lit(0)), F.nullif(est, F.lit(0)), F.lit(IMPUTE_DEFAULT_SECONDS))
    ratio = seconds.cast("decimal(20,0)") / F.lit(IMPUTE_SECONDS_PER_3_POINTS).cast("decimal(6,1)")
    value = F.greatest(F.round(ratio * F.lit(3), 1), F.lit(IMPUTE_MIN_POINTS).cast("decimal(6,1)"))
    return F.when(sp.isNull() | (ts > 0), value.cast("decimal(6,1)")).otherwise(sp.cast("decimal(6,1)"))


def _scalar_text(value) -> str:
    """Text of a leaf: strings as they are, false-like values nothing, others as Python prints them."""
    return value if isinstance(value, str) else str(value) if value else ""


_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\.)*"|[^ \t\n\r{}\[\]:,"]+|\Z)', re.DOTALL)


def parse_deep(doc: str):
    """``json.loads`` with a stack of its own, for documents nested deeper than the parser's recursion goes.

    Brackets are followed token by token; what stands between them goes to the parser.
    """
    root: list = []
    stack: list[tuple] = [(root, None)]  # container, and of an object the name that waits for its value
    state, at = "value", 0  # value, first (value or the end), name, first name, colon, after, end

    def put(value) -> None:
        box, name = stack[-1]
        box.append(value) if name is None else box.__setitem__(name, value)

    while True:
        m = _TOKEN.match(doc, at)
        token, at = (m.group(1), m.end()) if m else ("?", at)
        if state == "end":
            if token == "":
                return root[0]
            raise ValueError("more than one document")
        if token in ("{", "[") and state in ("value", "first"):
            box = {} if token == "{" else []
            put(box)
            stack.append((box, None))
            state = "first name" if token == "{" else "first"
            continue
        closes = token in ("}", "]") and len(stack) > 1 and isinstance(stack[-1][0], dict) == (token == "}")
        if closes and state in ("after", "first", "first name"):
            stack.pop()
        elif token == "," and state == "after":
            state = "name" if isinstance(stack[-1][0], dict) else "value"
            continue
        elif token == ":" and state == "colon":
            state = "value"
            continue
        elif token[:1] == '"' and state in ("name", "first name"):
            stack[-1] = (stack[-1][0], json.loads(token))
            state = "colon"
            continue
        elif state in ("value", "first") and token[:1] not in ("", "{", "}", "[", "]", ":", ","):
            put(json.loads(token))
        else:
            raise ValueError("not a document")
        state = "end" if len(stack) == 1 else "after"


def rich_text(doc: str | None) -> str:
    """Plain text of a rich-text document given as JSON text; other strings are their own text.

    A node's text is its own ``text``, a space, and its children's texts
    joined by single spaces, stripped; a list is its items joined by spaces.
    Only ``content`` is walked: texts under ``attrs`` are not part of it. The
    walk keeps its own stack, so no depth is too deep.
    """
    if not doc:
        return ""
    try:
        root = json.loads(doc)
    except RecursionError:
        try:
            root = parse_deep(doc)
        except ValueError:
            return doc
    except ValueError:
        return doc
    if not isinstance(root, (dict, list)):
        return doc

    def children(node):
        return iter((node.get("content") or []) if isinstance(node, dict) else node)

    stack = [(root, [], children(root))]
    while True:
        node, parts, rest = stack[-1]
        child = next(rest, stack)
        if child is not stack:
            if isinstance(child, (dict, list)) and child:
                stack.append((child, [], children(child)))
            else:
                parts.append(_scalar_text(child))
            continue
        text = " ".join(parts)
        if isinstance(node, dict):
            own = _scalar_text(node.get("text", ""))
            text = (f"{own} {text}" if "content" in node else own).strip()
        stack.pop()
        if not stack:
            return text
        stack[-1][1].append(text)


@F.pandas_udf(T.StringType())
def _rich_text(docs: pd.Series) -> pd.Series:
    return docs.map(lambda d: None if d is None else rich_text(d))


def extract_text_exact(doc: str | Column) -> Column:
    """Plain text of a rich-text document, with the spacing that empty nodes leave.

    Strings that open no JSON object or list cannot be documents and stay
    JVM-side; the others are parsed in one Arrow UDF, and come back unchanged
    when they are not JSON.
    """
    s = col_(doc)
    may_be = F.coalesce(F.ltrim(s).startswith("{") | F.ltrim(s).startswith("["), F.lit(False))
    return F.when(may_be, _rich_text(F.when(may_be, s))).otherwise(F.coalesce(s, F.lit("")))


def extract_text(doc: str | Column) -> Column:
    """Like :func:`extract_text_exact`; a document's text is whitespace-collapsed."""
    s = col_(doc)
    text = extract_text_exact(s)
    return F.when(text == F.coalesce(s, F.lit("")), text).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
