"""Tokens of whole documents on Arrow batches: those that text.py's columns have, with a document's text read once and never moved.

Forms are hashed, and bit tables say which tokens or pairs of tokens a gazetteer may have; only these leave a document. Where they are searched, many texts are tokenized at once as arrays of code
points; texts with characters beyond the first plane or whose folding moves tokens' bounds, and those of more than a million characters, one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MIN_TOKEN_CHARS
from ..sources.readers import ready
from . import text as X

# \w is letters, numbers and _, as in X.TOKEN
TOKEN, _PARTS = re.compile(r"[\w'-]+"), re.compile(r"([\w'-]+)")
_MOVES, _OTHERS = re.compile(X._MOVES), re.compile("[^\x00-\x7f]")
BITS = 1 << 28
_ROWS = 1 << 17


class _Folded(dict):
    """What a lower-case character becomes."""

    def __missing__(self, c: str) -> str:
        n = ord(c) - 0xAC00
        if 0 <= n <= 11171:
            first, second, third = X._HANGUL
            self[c] = (first[n // 588] + second[n % 588 // 28] + third[n % 28]).replace("*", "")
        else:
            self[c] = c
        return self[c]


_FOLDED = _Folded({**X._LONG, **dict.fromkeys(X._MARKS, ""), **X._SINGLE})


def fold(text: str) -> str:
    """X.fold."""
    low = text.lower()
    if low.isascii():
        return low
    found = set(_OTHERS.findall(low))
    if len(found) > 64:
        return low.translate({ord(c): _FOLDED[c] for c in found})
    for c in found:
        low = low.replace(c, _FOLDED[c])
    return low


def raw_forms(text: str) -> list[str]:
    """X.raw_forms."""
    if not text.isascii() and _MOVES.search(text):
        return [fold(x).strip("'-") for x in TOKEN.findall(text)]
    low = fold(text)
    t = TOKEN.findall(low)
    return [x.strip("'-") for x in t] if "'" in low or "-" in low else t


def places(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens as they are in the text, with their starts and ends."""
    parts = _PARTS.split(text)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return parts[1::2], ends[:-1:2], ends[1::2]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LONGEST = 1 << 20


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and its inverse modulo 2**64, for 2**bits places."""
    r = 0x9E3779B97F4A7C15
    up, down = np.full(1 << bits, r, np.uint64), np.full(1 << bits, pow(r, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _spans(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """60 bits that depend on chars[start:end] only, for many spans; from one pass of prefix sums."""
    up, down = _powers(max(18, (len(chars) + 1).bit_length()))
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars * up[: len(chars)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    for shift, m in zip((30, 27), _MIX, strict=True):
        h ^= h >> np.uint64(shift)
        h *= m
    return (h >> np.uint64(4)).astype(np.int64)


def hashes(tokens: list[str]) -> np.ndarray:
    if not tokens:
        return np.zeros(0, np.int64)
    end = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return _spans(np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32), np.r_[0, end[:-1]], end)


def _hashed(tokens: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array(hashes([x or "" for x in tokens.slice(i, 1 << 15).to_pylist()]), pa.int64()) for i in range(0, len(tokens), 1 << 15)] or [pa.array([], pa.int64())])


def hash_of(token: Column) -> Column:
    """The same hash as a column."""
    ready(SparkSession.active())
    return F.arrow_udf(_hashed, "long")(token)


def pair_hash(t: Column) -> Column:
    """Of an array's first two tokens."""
    return hash_of(F.element_at(t, 1)).bitwiseXOR(F.shiftleft(hash_of(F.element_at(t, 2)), 1))


def bits(df: DataFrame, key: Column) -> np.ndarray:
    """A Bloom filter of two bits a key, of 16 bits a key or more up to 32 MB; 50 million keys let a tenth of the others pass."""
    p = df.select(key.alias("k")).select(F.explode(F.array(F.col("k").bitwiseAND(F.lit(BITS - 1)), F.shiftright("k", 30).bitwiseAND(F.lit(BITS - 1)))).alias("p"))
    words = p.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << min(BITS.bit_length() - 7, max(10, (words.num_rows // 4).bit_length())), np.int64)
    np.bitwise_or.at(out, words.column("w").to_numpy() & (len(out) - 1), words.column("b").to_numpy())
    return out


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a hash may be among the table's keys."""
    n = 64 * len(table) - 1
    p, q = h & n, (h >> 30) & n
    return (table[p >> 6] >> (p & 63)) & (table[q >> 6] >> (q & 63)) & 1 == 1


_MARK, _LETTER, _HARD = 1, 2, 3


@cache
def _chars() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """By code point: whether it is ' or -, another part of tokens, or hard, that is one whose folding depends on others or moves tokens' bounds; what it folds to, of which the first
    character; the further characters, where there are some. The last entry is for all beyond the first plane, which are hard."""
    kind, one, more = np.zeros(0x10001, np.uint8), np.zeros(0x10001, np.uint32), {}
    kind[0xD800:0xE000] = kind[0x10000] = _HARD
    for n in [*range(0xD800), *range(0xE000, 0x10000)]:
        c = chr(n)
        f = fold(c)
        if c in "'-":
            kind[n], one[n] = _MARK, n
        elif c == "Σ" or _MOVES.match(c) or (TOKEN.fullmatch(f) is None or "'" in f or "-" in f if TOKEN.match(c) else TOKEN.search(f)):
            kind[n] = _HARD
        elif TOKEN.match(c):
            kind[n], one[n] = _LETTER, ord(f[0])
            if len(f) > 1:
                more[n] = np.frombuffer(f[1:].encode("utf-32-le"), np.uint32)
    return kind, one, more


@cache
def _more() -> np.ndarray:
    out = np.zeros(0x10001, np.uint8)
    for n, f in _chars()[2].items():
        out[n] = len(f)
    return out


class Piece:
    """The tokens of several texts as arrays, made without a step in Python for each: start and end of those that have forms, counted in `text`, which has all texts; the forms' places in
    `folded`, their hashes; first: each text's first token, and the number of all. Texts with hard characters have no tokens here, `hard` has their numbers."""

    def __init__(self, texts: list[str]) -> None:
        kinds, ones, mores = _chars()
        self.text = "\n".join(texts)
        code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        code = np.minimum(code, 0x10000)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(size + 1) - size - 1
        kind = kinds[code]
        self.hard = np.unique(np.searchsorted(self.at, np.flatnonzero(kind == _HARD), "right") - 1).tolist()
        for d in self.hard:
            kind[self.at[d] : self.at[d] + size[d]] = 0
        edge = np.diff(np.concatenate([[False], kind > 0, [False]]).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        a, b = start, end
        if len(start) and ((kind[start] == _MARK) | (kind[end - 1] == _MARK)).any():
            letters = np.flatnonzero(kind == _LETTER)
            i, j = np.searchsorted(letters, start), np.searchsorted(letters, end)
            has = i < j
            start, end, a, b = start[has], end[has], letters[i[has]], letters[j[has] - 1] + 1
        folded = ones[code]
        long = np.flatnonzero(_more()[code])
        if len(long):
            n = _more()[code[long]].astype(np.int64)
            folded = np.insert(folded, np.repeat(long + 1, n), np.concatenate([mores[c] for c in code[long].tolist()]))
            before = np.r_[0, np.cumsum(n)]
            a, b = a + before[np.searchsorted(long, a)], b + before[np.searchsorted(long, b)]
        self._folded = folded
        self.start, self.end, self.a, self.b = start, end, a, b
        self.hash = _spans(folded, a, b)
        self.first = np.searchsorted(start, np.r_[self.at, len(code) + 1])

    @cached_property
    def folded(self) -> str:
        return self._folded.tobytes().decode("utf-32-le")

    def forms(self, i: slice | np.ndarray) -> list[str]:
        return [self.folded[a:b] for a, b in zip(self.a[i].tolist(), self.b[i].tolist(), strict=True)]

    def may_be_in(self, vocabulary: np.ndarray) -> np.ndarray:
        """Tokens of at least two characters that may be in the vocabulary."""
        i = np.flatnonzero(self.b - self.a >= MIN_TOKEN_CHARS)
        return i[among(self.hash[i], vocabulary)]


def pieces(texts: list[str | None], most: int = 1 << 17) -> Iterator[list[int]]:
    """Numbers of texts that have together `most` characters, or a single longer one; not of nulls."""
    found, n = [], 0
    for i, x in enumerate(texts):
        if x is None:
            continue
        if found and n + len(x) > most:
            yield found
            found, n = [], 0
        found.append(i)
        n += len(x) + 1
    if found:
        yield found


def _mapped(docs: DataFrame, rows: Callable[[str], Iterator[tuple] | list[tuple]], schema: str, keyed: bool = False, by_piece: Callable[[Piece], Iterator[tuple[int, tuple]]] | None = None) -> DataFrame:
    """doc_id and the columns of schema, for all rows that a text has; keyed: with doc, a number that no other row of docs has.

    by_piece gives the same as rows, with the number of the text in the piece before each; rows is for what it can't.
    """
    added = T.StructType.fromDDL(schema)
    kinds = [_arrow(f.dataType) for f in added]
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *([T.StructField("doc", T.LongType())] if keyed else []), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40)

        def batch(ids: pa.Array, at: list[int], which: list[int], found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *([pa.array(which, pa.int64())] if keyed else []), *columns], names=out.names)

        def each(texts: pa.Array) -> Iterator[tuple[int, tuple]]:
            if by_piece is None:
                yield from ((i, r) for i, x in enumerate(texts) if x.is_valid for r in rows(x.as_py()))
                return
            for k in range(0, len(texts), 256):
                some = texts.slice(k, 256).to_pylist()
                for which in pieces(some):
                    if len(some[which[0]]) > _LONGEST:
                        yield from ((k + which[0], r) for r in rows(some[which[0]]))
                        continue
                    p = Piece([some[i] for i in which])
                    yield from ((k + which[d], r) for d, r in by_piece(p))
                    yield from ((k + which[d], r) for d in p.hard for r in rows(some[which[d]]))

        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column("doc_id"), b.column("text")
            at, which, found, first = [], [], [], next(number)
            for _ in range(1, b.num_rows):
                next(number)
            for i, r in each(texts):
                at.append(i)
                which.append(first + i)
                found.append(r)
                if len(found) >= _ROWS:
                    yield batch(ids, at, which, found)
                    at, which, found = [], [], []
            if found:
                yield batch(ids, at, which, found)

    ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, original, form, start, end of all tokens that have forms (F2), a row each."""

    def rows(text: str) -> Iterator[tuple]:
        o, start, end = places(text)
        return (r for r in zip(o, raw_forms(text), start.tolist(), end.tolist(), strict=True) if r[1])

    return _mapped(docs, rows, "original string, form string, start bigint, `end` bigint")


def known(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, t: the distinct forms of at least two characters that may be in the vocabulary (a table of bits)."""

    def rows(text: str) -> list[tuple]:
        return [(t,)] if (t := _known(raw_forms(text), vocabulary)) else []

    def by_piece(p: Piece) -> Iterator[tuple[int, tuple]]:
        i = p.may_be_in(vocabulary)
        forms, bound = p.forms(i), np.searchsorted(i, p.first).tolist()
        return ((d, (list(dict.fromkeys(forms[x:y])),)) for d, (x, y) in enumerate(pairwise(bound)) if x < y)

    return _mapped(docs, rows, "t array<string>", by_piece=by_piece)


def _known(forms: list[str], vocabulary: np.ndarray) -> list[str]:
    t = [x for x in dict.fromkeys(forms) if len(x) >= MIN_TOKEN_CHARS]
    return [t[i] for i in np.flatnonzero(among(hashes(t), vocabulary))] if t else []


def near(docs: DataFrame, pairs: np.ndarray, width: int, slop: int = 0, vocabulary: np.ndarray | None = None) -> DataFrame:
    """doc_id, doc, pos, t, o, start, ends, piece where a token and one of the slop + 1 tokens after it may be among `pairs`, a table of bits.

    pos counts tokens that have forms, from 0. t, o and ends are the forms, originals and ends of the next `width` of them, piece is their part of the text. With a vocabulary also known,
    the document's distinct forms that may be in it.
    """

    def rows(text: str) -> Iterator[tuple]:
        f = raw_forms(text)
        t = [x for x in f if x] if "" in f else f
        h = hashes(t)
        hit = np.zeros(len(t), bool)
        for g in range(1, slop + 2):
            if len(t) > g:
                hit[:-g] |= among(h[:-g] ^ (h[g:] << 1), pairs)
        if not hit.any():
            return
        o, start, end = places(text)
        if len(t) < len(f):
            k = [i for i, x in enumerate(f) if x]
            o, start, end = [o[i] for i in k], start[k], end[k]
        more = () if vocabulary is None else (_known(t, vocabulary),)
        for i in np.flatnonzero(hit).tolist():
            ends = end[i : i + width].tolist()
            yield i, t[i : i + width], o[i : i + width], int(start[i]), ends, text[start[i] : ends[-1]], *more

    def by_piece(p: Piece) -> Iterator[tuple[int, tuple]]:
        h = p.hash
        last = np.repeat(p.first[1:], np.diff(p.first))  # after the token's text
        hit = np.zeros(len(h), bool)
        for g in range(1, slop + 2):
            if len(h) > g:
                hit[:-g] |= among(h[:-g] ^ (h[g:] << 1), pairs) & (last[:-g] == last[g:])
        hits = np.flatnonzero(hit)
        if not len(hits):
            return
        text_of = np.searchsorted(p.first, hits, "right") - 1
        i = None if vocabulary is None else p.may_be_in(vocabulary)
        bound = None if i is None else np.searchsorted(i, p.first)
        now, more = -1, ()
        for x, y, d in zip(hits.tolist(), np.minimum(hits + width, last[hits]).tolist(), text_of.tolist(), strict=True):
            if i is not None and d != now:
                now, more = d, (list(dict.fromkeys(p.forms(i[bound[d] : bound[d + 1]]))),)
            start, end, zero = p.start[x:y].tolist(), p.end[x:y].tolist(), int(p.at[d])
            yield d, (x - int(p.first[d]), p.forms(slice(x, y)), [p.text[a:b] for a, b in zip(start, end, strict=True)], start[0] - zero, [e - zero for e in end], p.text[start[0] : end[-1]], *more)

    return _mapped(docs, rows, "pos int, t array<string>, o array<string>, start int, ends array<int>, piece string" + ("" if vocabulary is None else ", known array<string>"), keyed=True, by_piece=by_piece)
