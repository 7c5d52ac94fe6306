"""Python ``re`` patterns as Spark (Java) regular expressions, plus first-match helpers.

Rules: ``(?i)`` ignore case when asked, ``(?d)`` so ``.`` stops only at ``\\n`` as in Python,
``(?U)`` so ``\\w \\d \\S`` and case folding are Unicode-aware as for Python ``str`` patterns;
Python ``\\Z`` is Java ``\\z``. ``rlike`` is ``re.search``; ``regexp_extract`` gives ``''``
when nothing matches.

A list of patterns is tried in list order, first match wins (never the earliest position in
the text). The index of the first matching pattern is a short-circuit ``coalesce`` of
``when(rlike)``; values then come from a ``CASE`` on that index, so each row runs the patterns
only until the first hit plus one extraction. Everything stays inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_regex(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    flags = "i" if ignore_case else ""
    flags += "s" if dotall else ""
    body = pattern.replace(r"\Z", r"\z")
    return f"(?{flags}dU){body}"


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def first_match_index(text: Column, patterns: Sequence[str]) -> Column:
    """1-based index of the first pattern that matches ``text`` (patterns already in Java form)."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(i + 1)) for i, p in enumerate(patterns)])


def pick(index: Column, values: Sequence[Column | None]) -> Column:
    """``values[index - 1]`` evaluated lazily; null for a null index or a ``None`` slot."""
    out = None
    for i, v in enumerate(values):
        if v is None:
            continue
        cond = index == F.lit(i + 1)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out if out is not None else F.lit(None).cast("string")
