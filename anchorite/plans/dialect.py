"""One text for both dialects: marks that Spark and the oracle write differently."""

from __future__ import annotations

import re

#: A mark's Spark form and its oracle form; arguments are parted by semicolons.
MARKS = {
    "GSUB": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "SEQ": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "PARTS": ("explode(split({0}, {1}))", "unnest(string_split_regex({0}, {1}))"),
    "GET": ("element_at({0}, {1})", "list_extract({0}, {1})"),
    "SPLIT": ("split({0}, {1})", "string_split_regex({0}, {1})"),
    "JOINED": ("listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})", "string_agg({0}, {1} ORDER BY {2})"),
    "BEST": ("max_by({0}, struct({1}))", "arg_max({0}, ({1}))"),
    "LEAST_OF": ("min_by({0}, struct({1}))", "arg_min({0}, ({1}))"),
}
_MARK = re.compile(r"\b(" + "|".join(MARKS) + r")\{([^{}]*)\}")


def dual(text: str) -> tuple[str, str]:
    """The text for Spark and for the oracle; marks may hold marks."""
    out = []
    for side in (0, 1):
        now = text
        while (m := _MARK.search(now)) is not None:
            parts = [p.strip() for p in m[2].split("; ")]
            now = now[: m.start()] + MARKS[m[1]][side].format(*parts) + now[m.end() :]
        out.append(now)
    return out[0], out[1]
