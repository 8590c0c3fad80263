"""Folding and tokenizing of strings as native columns.

Offsets are of code points, ends are exclusive. Nothing here is a Python UDF: Latin, Greek and Cyrillic letters fold through
one translate and some replaces, which only strings that aren't ASCII go through. Letters of other scripts stay as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_'-]+"
# one letter for one, by script
_LETTERS = {
    "абвгдеёзийклмнопрстуфыэіѓјќўґәөүұһқғңҙҫ": "abvgdeeziiklmnoprstufyeigjkugaouuhkgnzs",
    "αβγδεζηικλμνξοπρσςτυω": "abgdeziiklmnxoprsstyo",
    "აბგდევზთიკლმნოპრსტუფქყხჯჰ": "abgdevztiklmnoprstupkqkjh",
    "աբգդեզէըիլխծկհձղմյնոպջռսվտրւօֆ": "abgdezeeilkckhdgmynopjrsvtrwof",
    "אבגדהוזחטיכךלמםנןסעפףצץקרת": "abgdhvzhtykklmmnnsappttkrt",
}
_ARABIC = dict(zip("ابتجحدرزسصضطظعفقكلمنهويىةآأإگکیؤئپ", "abtjhdrzssdtzafqklmnhwyahaaagkywyp", strict=True))
_ONE = {a: b for keys, values in _LETTERS.items() for a, b in zip(keys, values, strict=True)} | _ARABIC
# kana, as syllables; the length mark and small tsu are dropped with the marks
_KANA = dict(zip("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんぁぃぅぇぉゃゅょ", "a i u e o ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho ma mi mu me mo ya yu yo ra ri ru re ro wa o n a i u e o ya yu yo".split(), strict=True))
_VOICED = dict(zip("がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽ", "ga gi gu ge go za ji zu ze zo da ji zu de do ba bi bu be bo pa pi pu pe po".split(), strict=True))
_LONG = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŉ": "n", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ї": "i", "є": "ie", "ђ": "dj", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz", "θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps",
    "ჟ": "zh", "ღ": "gh", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "թ": "th", "ժ": "zh", "ճ": "ch", "շ": "sh", "չ": "ch", "ց": "ts", "փ": "ph", "ք": "kh", "և": "ev", "ש": "sh",
    "ث": "th", "ج": "j", "خ": "kh", "ذ": "dh", "ش": "sh", "غ": "gh", "چ": "ch", "ژ": "zh",
} | _KANA | _VOICED | {chr(ord(k) + 0x60): v for k, v in (_KANA | _VOICED).items()}
_STROKES = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ŀ": "l", "ĸ": "k", "ŋ": "n", "ſ": "s", "ƒ": "f", "’": "'"}
# Hangul syllables are parted into their letters, of which a syllable has up to three
_HANGUL = ("g kk n d tt r m b pp s ss * j jj ch k t p h".split(), "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(), "* k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split())


def _single() -> dict[str, str]:
    """What folds to one character of ASCII: letters with marks above all, and letters of other scripts."""
    out = _STROKES | {k: v for k, v in _ONE.items() if k not in _LONG}
    for code in [*range(0xA0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        bare = _ONE.get(bare, _STROKES.get(bare, bare))
        if len(c.lower()) == 1 and len(bare) == 1 and bare.isascii() and c == c.lower() and c != bare and bare.isalnum():
            out[c] = bare
    return out


_SINGLE = {k: v for k, v in _single().items() if k not in _LONG}
# combining marks, Hebrew points, Arabic vowels, signs that only soften, lengthen or join
_MARKS = "".join(chr(c) for c in [*range(0x300, 0x370), *range(0x591, 0x5C8), *range(0x610, 0x61B), *range(0x64B, 0x660), 0x670, 0x640, 0x200C, 0x200D]) + "ьъーっッ"
_FROM, _TO = "".join(_SINGLE) + _MARKS, "".join(_SINGLE.values())
_quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
def _pairs(keys: list[str]) -> Column:
    return F.expr(f"array({', '.join(f'struct({_quoted(k)} as k, {_quoted(_LONG[k])} as v)' for k in keys)})")


# what no text in Latin letters has
_OTHER = "[\u0370-\u1dff\u3000-\ud7ff\uf900-\uffdc]"


def _hangul(text: Column, limit: Column) -> Column:
    """Syllables of Hangul in Latin letters; a silent letter is nothing. limit: 1 leaves a text without any in one piece."""
    table = [F.split(F.lit(" ".join(x)), " ") for x in _HANGUL]

    def one(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00  # the code point
        at = (F.floor(n / 588), F.floor(n % 588 / 28), n % 28)
        return F.when(n.between(0, 11171), F.translate(F.concat(*[F.element_at(t, (i + 1).cast("int")) for t, i in zip(table, at, strict=True)]), "*", "")).otherwise(c)

    return F.array_join(F.transform(F.split(text, "", limit), one), "")


def fold(text: Column) -> Column:
    """Lower case and without accents, in ASCII as far as the letters are known (F1); null gives "".

    Letters of the Latin, Greek, Cyrillic, Georgian, Armenian, Hebrew and Arabic scripts, kana and Hangul fold; others, Chinese characters among
    them, stay as they are.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    folded = F.translate(low, _FROM, _TO)
    other = low.rlike(_OTHER)
    # a fold over pairs: a call of replace() for each would have to be planned in every place
    pairs = F.when(other, _pairs(list(_LONG))).otherwise(_pairs([k for k in _LONG if ord(k) < 0x370 or ord(k) >= 0xFB00]))
    folded = F.aggregate(pairs, folded, lambda t, p: F.replace(t, p["k"], p["v"]))
    folded = _hangul(folded, F.when(other, -1).otherwise(1))
    return F.when(F.octet_length(low) > F.char_length(low), folded).otherwise(low)


def originals(text: Column) -> Column:
    """All tokens as they are in the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def form(token: Column) -> Column:
    """A token's folded form, without apostrophes and hyphens at its ends; may be empty."""
    return F.btrim(fold(token), F.lit("'-"))


# signs that folding turns into parts of tokens, or deletes between them
_MOVES = "[’\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u0640\u200c\u200dьъЬЪーっッ]"


def raw_forms(text: Column) -> Column:
    """The forms of originals(text), one for each; may be empty.

    Folding the whole text once gives the same tokens as folding each, but for the few signs that would move their bounds.
    """
    at_once = F.transform(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), lambda x: F.btrim(x, F.lit("'-")))
    each = F.transform(originals(text), form)
    return F.when(text.rlike(_MOVES), each).otherwise(at_once)


def forms(text: Column) -> Column:
    """The forms of a text's tokens."""
    return F.filter(raw_forms(text), lambda x: x != "")


def phrase(text: Column) -> Column:
    """Forms joined by one space."""
    return F.array_join(forms(text), " ")


BLOCK = 256


def blocks(lengths: Column) -> Column:
    """Sums of BLOCK lengths each, and of what is left."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def upto(lengths: Column, sums: Column, n: Column) -> Column:
    """The sum of the first n lengths, out of the sums of blocks()."""
    full = F.floor(n / BLOCK).cast("int")
    return total(F.slice(sums, F.lit(1), full)) + total(F.slice(lengths, full * BLOCK + 1, n - full * BLOCK))


def tokens(df: DataFrame, name: str = "tokens", source: str = "text") -> DataFrame:
    """df with a column array<struct<form, original, start, end>> (F2). Ends are sums of the lengths of separators and tokens before, by blocks."""
    t = F.coalesce(F.col(source), F.lit(""))
    rows = once(df, _o=originals(t), _g=F.split(t, TOKEN, -1), _f=raw_forms(t))
    rows = once(rows, _n=F.transform("_o", lambda x, i: F.length(x) + F.length(F.element_at("_g", i + 1))))
    rows = once(rows, _b=blocks(F.col("_n")))

    def one(x: Column, i: Column) -> Column:
        end = upto(F.col("_n"), F.col("_b"), i + 1)
        return F.struct(F.element_at("_f", i + 1).alias("form"), x.alias("original"), (end - F.length(x)).alias("start"), end.alias("end"))

    return rows.withColumn(name, F.filter(F.transform("_o", one), lambda x: x["form"] != "")).drop("_o", "_g", "_f", "_n", "_b")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once a row, by a generator: the optimizer would put projected expressions into each lambda that uses them."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")).select("*", "_once.*").drop("_once")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
