"""Parts of titles as SQL expressions over a column; one text serves Spark and the oracle."""

from __future__ import annotations

#: Words before which the head of a title stands.
PREPOSITIONS = "in|of|for|at|on|by|from|with|to"


def canonical(t: str) -> str:
    """Spaces for underscores, up to the first comma or parenthesis."""
    return f"trim(regexp_extract(replace({t}, '_', ' '), '^[^,(]*', 0))"


def head(t: str) -> str:
    """Last word before the first preposition of the canonical title."""
    name = canonical(t)
    before = f"coalesce(nullif(regexp_extract({name}, '^(.+?) ({PREPOSITIONS}) ', 1), ''), {name})"
    return f"regexp_extract({before}, '([^ ]+)$', 1)"


def secondary(t: str) -> str:
    """Entity that a title names besides its own: in parentheses without a year, behind the last comma, in a list's name, or behind the last ``of``; null where there is none."""
    forms = ["[(]([^(),0-9][^(),]*)", "^[^(]*,_?([^,()]+)$", "^List_of_(.*)_[^_]+$", "^.*_of_(.+)$"]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{f}', 1), '')" for f in forms) + ")"
