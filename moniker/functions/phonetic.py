"""Metaphone codes (F6), written from the published rules of 1990, for distinct name parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "AEIOU"


def metaphone(word: str) -> str:
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c = w[i]
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        after, code, step = at(i + 1), c, 1
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if i == n - 1 and at(i - 1) == "M" else "B"
        elif c == "C":
            if after and after in "EIY":
                code = "X" if w[i : i + 3] == "CIA" else ("" if at(i - 1) == "S" else "S")
            elif after == "H":
                code, step = ("K" if at(i - 1) == "S" else "X"), 2
            else:
                code = "K"
        elif c == "D":
            code, step = ("J", 3) if after == "G" and at(i + 2) and at(i + 2) in "EIY" else ("T", 1)
        elif c == "G":
            if after == "H" and not (i + 2 < n and at(i + 2) in _VOWELS) or after == "N" and (i + 2 == n or w[i:] == "GNED"):
                code = ""
            else:
                code = "J" if after and after in "EIY" and at(i - 1) != "G" else "K"
        elif c == "H":
            code = "" if (at(i - 1) and at(i - 1) in _VOWELS and after not in tuple(_VOWELS)) or (at(i - 1) and at(i - 1) in "CSPTG") else "H"
        elif c == "K":
            code = "" if at(i - 1) == "C" else "K"
        elif c == "P":
            code, step = ("F", 2) if after == "H" else ("P", 1)
        elif c == "Q":
            code = "K"
        elif c == "S":
            if after == "H":
                code, step = "X", 2
            else:
                code = "X" if w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                code = "X"
            elif after == "H":
                code, step = "0", 2
            else:
                code = "" if w[i : i + 3] == "TCH" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if after and after in _VOWELS else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        out.append(code)
        i += step
    return "".join(out)


@F.pandas_udf(T.StringType())
def metaphone_code(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else metaphone(w))
