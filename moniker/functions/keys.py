"""The order-independent key of a name (F5) and small tables of prefixes and legal forms.

The tables are short lists of our own from common usage; they are data to be extended, not a full dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

PREFIXES = (
    *("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "rev", "hon", "capt", "col", "gen", "lt", "maj", "sgt", "the"),
    *("herr", "frau", "mag", "ing", "dipl", "der", "die", "das", "mme", "mlle", "monsieur", "madame", "maitre", "le", "la", "les"),
    *("sr", "sra", "srta", "don", "dona", "senor", "senora", "sig", "signor", "signora", "dott", "avv", "dhr", "mevr", "pan", "pani", "gospodin", "sheikh", "haji"),
)
LEGAL_FORMS = {
    "limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "aktiengesellschaft": "ag", "societe": "sa", "plc": "plc", "companies": "cos", "cooperative": "coop", "kommanditgesellschaft": "kg",
    "partnership": "lp", "association": "assn", "assoc": "assn", "bros": "brothers", "aktiebolag": "ab", "aktieselskab": "as", "aksjeselskap": "as", "osakeyhtio": "oy", "vennootschap": "nv", "gesellschaft": "ges", "verein": "ev",
    "obshchestvo": "ooo", "genossenschaft": "eg", "stiftung": "stiftung", "anonim": "as", "sirketi": "sti", "limitada": "ltda", "anonima": "sa", "sociedad": "sa", "societa": "spa", "spolka": "sp",
}
# forms of several words or with full stops, longest first, as regular expressions over folded text
PHRASES = (
    (r"public limited (?:company|liability company)", "plc"), (r"limited liability company", "llc"), (r"limited liability partnership", "llp"), (r"limited partnership", "lp"), (r"gesellschaft mit beschrankter haftung", "gmbh"), (r"gemeinnutzige gmbh", "ggmbh"),
    (r"eingetragener verein|e\. ?v\.", "ev"), (r"gmbh ?(?:&|und|and) ?co\.? ?kg(?:aa)?", "gmbhcokg"), (r"ag ?(?:&|und) ?co\.? ?kg(?:aa)?", "agcokg"), (r"societe anonyme", "sa"), (r"societe a responsabilite limitee", "sarl"), (r"societe par actions simplifiee", "sas"),
    (r"sociedad anonima", "sa"), (r"sociedad limitada", "sl"), (r"sociedade anonima", "sa"), (r"societa per azioni", "spa"), (r"societa a responsabilita limitata", "srl"), (r"besloten vennootschap", "bv"), (r"naamloze vennootschap", "nv"),
    (r"obshchestvo s ogranichennoi otvetstvennostiu", "ooo"), (r"aktsionernoe obshchestvo", "ao"), (r"sp(?:olka)?\.? z ?o\. ?o\.?", "spzoo"), (r"anonim sirketi", "as"), (r"pty\.? ltd\.?|proprietary limited", "ptyltd"), (r"pvt\.? ltd\.?|private limited", "pvtltd"),
    *((r"\.".join(x) + r"\.?", x) for x in ("sarl", "gmbh", "kgaa", "spa", "srl", "sas", "llc", "llp", "plc", "ooo", "oao", "zao", "sro", "doo", "sa", "bv", "nv", "ag", "kg", "sl", "as", "ab", "oy", "lp", "sc")),
)
_PREFIX = r"^(?:(?:" + "|".join(PREFIXES) + r")\.? +)+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}.])", r"(?![\p{L}\p{N}])"
_ANY = f"{_BEFORE}(?:{'|'.join(p for p, _ in PHRASES)}){_AFTER}"
PART = r"[\p{L}\p{N}]+"


def _table(pairs: Iterable[tuple[str, str]]) -> Column:
    """An array of structs k, v, made in one expression."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"array({', '.join(f'struct({quoted(k)} as k, {quoted(v)} as v)' for k, v in pairs)})")


def parts(name: Column) -> Column:
    """Comparable parts of a name in their order."""
    folded = F.regexp_replace(F.regexp_replace(fold(name), r"\s+", " "), r"^ | $", "")
    # names with a form of several words are few; the others pass through an empty fold
    phrases = _table((f"{_BEFORE}(?:{p}){_AFTER}", v) for p, v in PHRASES)
    found = F.when(F.rlike(folded, F.lit(_ANY)), phrases).otherwise(F.slice(phrases, 1, F.lit(0)))
    whole = F.aggregate(found, folded, lambda t, p: F.regexp_replace(t, p["k"], p["v"]))
    bare = F.regexp_replace(whole, _PREFIX, "")
    table = F.map_from_entries(_table(LEGAL_FORMS.items()))
    return F.transform(F.regexp_extract_all(bare, F.lit(PART), F.lit(0)), lambda x: F.coalesce(table[x], x))


def name_key(name: Column) -> Column:
    """Sorted parts joined by spaces, duplicates kept; "" for null and for names without letters or digits."""
    return F.array_join(F.array_sort(parts(name)), " ")
