"""Token counts by compiled finite-state transducers.

The tokenizer is a byte-level BPE given as ranks: a text falls into chunks by the usual pattern (contractions, letters,
digits, other signs, white space), and each chunk's bytes are merged in order of rank. Both parts are compiled:

* Splitter: a deterministic transducer over 15 classes of characters. A transition is annotated with the number of chunk
  starts it emits and how many characters back the last lies, as white space is given up late (one space goes to the
  chunk that follows). The characters of a batch are cut into blocks of `BLOCK`; for each block
  the map from every entry state to its exit state is found, the maps are composed by a parallel prefix scan over all
  blocks (in log2 of their number steps), and a second pass from the then known entry states emits the starts. A sign for the end of a text resets the machine, so one scan covers a batch.
* Merger: a deterministic transducer over bytes. The tokens of a prefix s[:i] end in a token t(i) that is found from the
  tokens of shorter prefixes: t is the longest token that is a suffix of s[:i] and that BPE leaves apart from t(i - |t|).
  So a state needs, for each suffix of s[:i] that begins a token, the last token before that suffix and the difference of
  the numbers of tokens; equal such records are one state. A transition is annotated with the change of the number of
  tokens. States are determinised when first entered, as in lazy automata of regular expression engines; a table that
  is full is dropped and begun anew. All distinct chunks of a batch are run at once, a byte of each a step. A long chunk is cut into blocks that are run
  side by side from the state that some bytes before them lead to; blocks' states and counts are composed from left to right, and a block that was begun in
  another state than the one before it ends in is run again from that.

Counts are exact: they equal those of the tokenizer itself.

A null text has a null count, an empty one 0. Rows are independent: repeated rows and ids are counted each by itself.
Texts of any length are counted whole. Other columns of the input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 64
MOST_STATES = 120_000
#: Chunks longer than LONG bytes are read in blocks of that length, each from LEAD bytes before it on; counts of MOST_SEEN distinct chunks are kept by a worker.
LONG, LEAD, MOST_SEEN = 2048, 128, 1 << 20
FEW = 4

# classes of characters
LETTER, DIGIT, SPACE, WHITE, OTHER, APOS, S_, T_, R_, E_, V_, M_, L_, D_, END = range(15)
# states of the splitter: in a run of letters, digits or other signs; after one space or other white space, or after more of
# which the last is such; after an apostrophe that begins a chunk, and one letter more; after a contraction
START, LET, NUM, OTH, SP, WS, SP2, WS2, AP, AP_R, AP_V, AP_L, DONE = range(13)
STATES = 13
HERE, BACK = 1, 2


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(i))[0]
        if k in "LN":
            table[i] = LETTER if k == "L" else DIGIT
    for i in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[i] = WHITE
    table[32], table[ord("'")], table[-1] = SPACE, APOS, END
    for c, k in zip("strevmld", range(S_, D_ + 1), strict=True):
        table[ord(c)] = k
    return table


@functools.cache
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class], and what reading the class emits: HERE, a chunk starts with it, and BACK, one started a character before."""
    nxt, out = np.zeros((STATES, 15), np.uint8), np.zeros((STATES, 15), np.uint8)
    letters = (LETTER, *range(S_, D_ + 1))
    fresh = {DIGIT: NUM, SPACE: SP, WHITE: WS, OTHER: OTH, APOS: AP, END: START} | dict.fromkeys(letters, LET)
    for s in range(STATES):
        back = BACK if s in (WS2, AP_R, AP_V, AP_L) else 0
        for c, to in fresh.items():
            nxt[s, c] = to
            out[s, c] = (0 if c == END else HERE) | back
        if s == WS2:
            out[s, END] = 0

    def goes(s: int, classes: tuple[int, ...], to: int, emits: int = 0) -> None:
        for c in classes:
            nxt[s, c], out[s, c] = to, emits

    goes(LET, letters, LET)
    goes(NUM, (DIGIT,), NUM)
    goes(OTH, (OTHER, APOS), OTH)
    for s, emits in ((SP, 0), (SP2, BACK)):  # the last space belongs to the chunk that follows
        goes(s, letters, LET, emits)
        goes(s, (DIGIT,), NUM, emits)
        goes(s, (OTHER, APOS), OTH, emits)
    for s in (SP, WS, SP2, WS2):
        goes(s, (SPACE,), SP2)
        goes(s, (WHITE,), WS2)
    goes(AP, (OTHER, APOS), OTH)
    goes(AP, (S_, T_, M_, D_), DONE)
    for c, s, then in ((R_, AP_R, E_), (V_, AP_V, E_), (L_, AP_L, L_)):
        goes(AP, (c,), s)
        goes(s, letters, LET, BACK)
        goes(s, (then,), DONE)
    return nxt, out


def chunk_starts(cls: np.ndarray) -> np.ndarray:
    """True where a chunk starts, for the classes of the characters of a batch with an END after each text."""
    nxt, out = _splitter()
    flat = np.zeros(STATES * 16, np.uint8)
    emit = np.zeros(STATES * 16, np.uint8)
    for s in range(STATES):
        flat[s * 16 : s * 16 + 15], emit[s * 16 : s * 16 + 15] = nxt[s], out[s]
    n = len(cls)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, END, np.uint8)
    padded[:n] = cls
    by_pos = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # maps of the blocks: all entry states for some characters, then one where they have met
    lead = 8
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None], blocks, 0)
    for k in range(lead):
        maps = flat[(maps << 4) | by_pos[k][:, None]]
    met = (maps == maps[:, :1]).all(1)
    one, rest = maps[:, 0].copy(), np.flatnonzero(~met)
    for k in range(lead, BLOCK):
        one = flat[(one << 4) | by_pos[k]]
    if len(rest):
        apart = maps[rest]
        for k in range(lead, BLOCK):
            apart = flat[(apart << 4) | by_pos[k][rest][:, None]]
    maps[:] = one[:, None]
    if len(rest):
        maps[rest] = apart
    # prefix scan: after the step of width d, maps[i] is the composition of up to 2 d blocks that end with i
    d = 1
    while d < blocks:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], 1)
        d *= 2
    state = np.r_[np.uint8(START), maps[:-1, START]].astype(np.uint8)
    emitted = np.empty((BLOCK, blocks), np.uint8)
    for k in range(BLOCK):
        at = (state << 4) | by_pos[k]
        emitted[k] = emit[at]
        state = flat[at]
    emitted = emitted.T.reshape(-1)[:n]
    starts = (emitted & HERE) > 0
    starts[:-1] |= (emitted[1:] & BACK) > 0
    return starts


class Merger:
    """The lazily determinised transducer of BPE merges over bytes; state 0 is unknown, state 1 the start of a chunk."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.compatible_pairs: dict[tuple[bytes, bytes], bool] = {}
        child: list[dict[int, int]] = [{}]
        parent, token = [0], [None]
        for t in ranks:
            if self.merge(t) != [t]:
                continue  # no text gives it
            v = 0
            for b in t:
                if b not in child[v]:
                    child[v][b] = len(child)
                    child.append({})
                    parent.append(v)
                    token.append(None)
                v = child[v][b]
            token[v] = t
        fail = [0] * len(child)
        level = list(child[0].values())
        while level:
            below = []
            for v in level:
                for b, w in child[v].items():
                    f = fail[v]
                    while f and b not in child[f]:
                        f = fail[f]
                    fail[w] = child[f].get(b, 0)
                    below.append(w)
            level = below
        self.child, self.parent, self.token, self.fail = child, parent, token, fail
        # tokens in the order of a walk of the tree: those below a node are the `below[v]` that follow `first[v]`
        self.first, self.below, order = [0] * len(child), [0] * len(child), []
        walk = [(0, False)]
        while walk:
            v, done = walk.pop()
            if done:
                self.below[v] = len(order) - self.first[v]
                continue
            if token[v] is not None:
                order.append(token[v])
            self.first[v] = len(order)
            walk.append((v, True))
            walk += [(w, False) for w in child[v].values()]
        self.order = order
        self.masks: dict[tuple[int, bytes | None], int] = {}
        self.seen, self.seen_count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chains: dict[int, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros((1 << 12, 256), np.int32)  # next state << 8 | change + 128
        self.records = [None, (0, ((None, 0),))]
        self.known = {self.records[1]: 1}

    def merge(self, s: bytes) -> list[bytes]:
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        known = self.compatible_pairs.get((a, b))
        if known is None:
            if len(self.compatible_pairs) > 1 << 20:
                self.compatible_pairs.clear()
            known = self.compatible_pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def chain(self, v: int) -> tuple[int, ...]:
        """v and the shorter suffixes of it that begin a token, down to the empty one."""
        c = self.chains.get(v)
        if c is None:
            c = self.chains[v] = (v, *self.chain(self.fail[v])) if v else (0,)
        return c

    def mask(self, v: int, last: bytes | None) -> int:
        """Which tokens below v may follow `last`, a bit each."""
        known = self.masks.get((v, last))
        if known is None:
            if len(self.masks) > 1 << 20:
                self.masks.clear()
            below = self.order[self.first[v] : self.first[v] + self.below[v]]
            known = self.masks[v, last] = sum(1 << i for i, t in enumerate(below) if last is None or self.compatible(last, t))
        return known

    def advance(self, state: int, byte: int) -> int:
        """Fills in table[state, byte].

        A record holds for each suffix that begins a token what may follow the last token before it: that token, or where
        no more than FEW tokens begin with the suffix just the set of those that may follow, so that more records are equal.
        """
        v, before = self.records[state]
        first, below, parent = self.first, self.below, self.parent
        info = dict(zip(self.chain(v), before, strict=True))
        while v and byte not in self.child[v]:
            v = self.fail[v]
        v = self.child[v].get(byte, 0)
        for w in self.chain(v):
            t = self.token[w]
            if t is not None:
                p = parent[w]
                last, d = info[p]
                if (last >> (first[w] - 1 - first[p])) & 1 if below[p] <= FEW else last is None or self.compatible(last, t):
                    change = d + 1
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        while v and not below[v]:
            v = self.fail[v]
        record = []
        for w in self.chain(v):
            if not w:
                record.append((t, 0))
                continue
            p = parent[w]
            last, d = info[p]
            if below[w] <= FEW:
                last = (last >> (first[w] - first[p])) & ((1 << below[w]) - 1) if below[p] <= FEW else self.mask(w, last)
                record.append((last, d - change) if last else (0, 0))
            else:
                record.append((last, d - change))
        key = (v, tuple(record))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.records)
            self.records.append(key)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[state, byte] = packed = to << 8 | (change + 128)
        return packed

    def walk(self, data: bytes, state: int) -> tuple[int, int]:
        """The state after the bytes, and the tokens they add, a byte at a time."""
        total, table = 0, self.table
        for byte in data:
            packed = int(table[state, byte])
            if not packed:
                packed = self.advance(state, byte)
                table = self.table
            state = packed >> 8
            total += (packed & 255) - 128
        return state, total

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state << 8 | byte
        packed = self.table.reshape(-1)[at]
        lacks = np.flatnonzero(packed == 0)
        if len(lacks):
            keys, where = np.unique(at[lacks], return_inverse=True)
            packed[lacks] = np.array([self.advance(int(x) >> 8, int(x) & 255) for x in keys], np.int32)[where]
        return packed >> 8, (packed & 255) - 128

    def long_count(self, data: np.ndarray) -> int:
        """The tokens of one long chunk. Its blocks are read side by side, each from LEAD bytes before it on; then their (state, count) results are composed from left
        to right: where a block's assumed first state isn't the one that the block before ends with, it is read again from that."""
        blocks = -(-len(data) // LONG)
        begin = np.arange(blocks) * LONG
        state, total, entry = np.ones(blocks, np.int64), np.zeros(blocks, np.int64), np.ones(blocks, np.int64)
        for k in range(-LEAD, LONG):
            if k == 0:
                entry = state.copy()
            at = begin + k
            some = np.flatnonzero((at >= 0) & (at < len(data)))
            state[some], more = self.step(state[some], data[at[some]])
            if k >= 0:
                total[some] += more
        last, n = 1, 0
        for i in range(blocks):
            if entry[i] == last:
                last, n = int(state[i]), n + int(total[i])
            else:
                last, more = self.walk(data[begin[i] : begin[i] + LONG].tobytes(), last)
                n += more
        return n

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of tokens of the chunks data[start : start + length]."""
        if len(self.records) > MOST_STATES:
            self.clear()
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(length > LONG):
            out[i] = self.long_count(data[start[i] : start[i] + length[i]])
        order = np.flatnonzero(length <= LONG)
        order = order[np.argsort(-length[order], kind="stable")]
        begin, state = start[order], np.ones(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        ends = np.sort(length[order])
        longest = int(ends[-1]) if len(ends) else 0
        live = len(ends) - np.searchsorted(ends, np.arange(longest), side="right")
        for k in range(longest):
            n = int(live[k])
            state[:n], more = self.step(state[:n], data[begin[:n] + k])
            total[:n] += more
        out[order] = total
        return out

    def distinct_counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same; equal chunks (by 64 bits and length) are counted once, frequent ones once a worker."""
        h = C.span_hashes(data, start, start + length)
        values, first, at = np.unique(h, return_index=True, return_inverse=True)
        known = np.minimum(np.searchsorted(self.seen, values), max(0, len(self.seen) - 1))
        fresh = self.seen[known] != values if len(self.seen) else np.ones(len(values), bool)
        n = np.empty(len(values), np.int64)
        n[~fresh] = self.seen_count[known[~fresh]]
        new = np.flatnonzero(fresh)
        n[new] = self.counts(data, start[first[new]], length[first[new]])
        if len(new) and len(self.seen) < MOST_SEEN:
            place = np.searchsorted(self.seen, values[new])
            self.seen, self.seen_count = np.insert(self.seen, place, values[new]), np.insert(self.seen_count, place, n[new])
        return n[at]


@functools.cache
def merger(path: str) -> Merger:
    with open(path, "rb") as f:
        return Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def count_batch(texts: list[str], m: Merger) -> np.ndarray:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    codes = np.full(int(ends[-1]) + 1 if len(texts) else 0, sys.maxunicode + 1, np.uint32)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = chunk_starts(_classes()[codes])
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[ends] = 0
    byte_at = np.r_[0, np.cumsum(width)]
    data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    first = np.flatnonzero(starts)
    edges = np.flatnonzero(starts | ~inside)
    after = edges[np.searchsorted(edges, first, side="right")]
    tokens = m.distinct_counts(data, byte_at[first], byte_at[after] - byte_at[first])
    total = np.r_[0, np.cumsum(tokens)]
    upto = np.searchsorted(first, ends)
    return total[upto] - total[np.r_[0, upto[:-1]]]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in C.pieces(batches, "text"):
            n = count_batch(["" if t is None else t for t in b.column("text").to_pylist()], m)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, mask=b.column("text").is_null().to_numpy(zero_copy_only=False))], ["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """The number of tokens of each row's text, special tokens being ordinary text: id_col, n_tokens. `ranks` names the vocabulary's file on each machine."""
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, text=text_col)
    return d.mapInArrow(_count(ranks), f"id {dict(d.dtypes)['id']}, n_tokens long").select(F.col("id").alias(id_col), "n_tokens")
