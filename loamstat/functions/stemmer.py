"""English Snowball stemming of single words, for the table of distinct tokens."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published algorithm's word lists, endings and exceptions.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VALID_LI = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_LONG_STARTS = ("gener", "commun", "arsen")

_VOWELS = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2: behind the first consonant that follows a vowel, and the next one."""
    r1 = next((len(p) for p in _LONG_STARTS if w.startswith(p)), None)
    if r1 is None:
        m = re.search(f"[{_VOWELS}][^{_VOWELS}]", w)
        r1 = m.end() if m else len(w)
    m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]$", w) or re.fullmatch(f"[{_VOWELS}][^{_VOWELS}]", w))


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(f"(^|[{_VOWELS}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[: len(w) - cut] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_VOWELS}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if re.search(f"[^{_VOWELS}][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    for end, put in _STEP2:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in _VALID_LI):
                w = base + put
            break
    for end, put in _STEP3:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if len(base) >= (r2 if end == "ative" else r1):
                w = base + put
            break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if len(base) >= r2 and (end != "ion" or base[-1:] in "st"):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_end(base)):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_col(col: Column) -> Column:
    def batch(s: pd.Series) -> pd.Series:
        return s.map(stem, na_action="ignore")

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(col)


def stems_col(col: Column) -> Column:
    """Stems of an array of words; a batch's distinct words are stemmed once."""

    def batch(a: pa.Array) -> pa.Array:
        words = a.flatten().dictionary_encode()
        stems = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string())
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(a), 0))
        offsets = pa.concat_arrays([pa.array([0], ends.type), ends])
        return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=a.is_null() if a.null_count else None)

    batch.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "array<string>")(col)
