"""Text functions that have no built-in twin: Porter stems, Jaro-Winkler likeness, long entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Suffixes of Porter's published steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words that may stand between the capitalised words of a long entity.
CONNECTIVES = "of|the|and|in|for|on|at|by|de|la|le"
WORD = r"\p{Lu}[\p{L}\p{N}'.-]*+"
ENTITY_START = r"(?<![\p{L}\p{N}'-])"
#: A whole run, with possessive repetition: a word ends in one way only, and a run of any length takes no stack.
ENTITY_RUN = rf"{ENTITY_START}{WORD}(?:,?(?: (?:{CONNECTIVES})){{0,2}} {WORD})++"
#: From one start within a run to the next.
ENTITY_PART = rf"(?s).(?:(?!{ENTITY_START}\p{{Lu}}).)*+"
LONG_ENTITY = rf"(?=({ENTITY_RUN}))"


def _shape(word: str) -> str:
    """v or c for each letter; y counts as a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word.removesuffix(suffix)
            if base != word:
                if "v" in _shape(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if suffix and _measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def jaro_winkler(a: str, b: str, weight: float = 0.1, prefix: int = 4) -> float:
    """Likeness from 0 to 1; the common prefix counts up to a number of characters."""
    if a == b:
        return 1.0
    reach, used, left = max(len(a), len(b)) // 2 - 1, [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (ch for ch, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return jaro + min(same, prefix) * weight * (1 - jaro)


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def long_entities(text: Column) -> Column:
    """Capitalised words with at most two connectives between them; entities may overlap, one from each start."""
    return F.regexp_extract_all(text, F.lit(LONG_ENTITY), F.lit(1))
