"""Quality rules by line sequence labelling.

A linear-chain conditional random field with the states content and boilerplate reads the lines of a text (blank ones left out).
A line's features are its shares of capitals, digits, marks and separators, of words that repeat the word before, and its lengths;
transitions favour runs of one state. Viterbi decoding marks each line; a document is retained if the share of its characters in content
lines is at least the model's least share.

The model is fitted here, by the likelihood of the field, on at most SAMPLE labelled documents (those of least hash of id; all are used where
there are fewer). Labels are by document, lines have none: at first all lines of a good document are content, all of a bad one boilerplate;
then, for ROUNDS rounds, lines of bad documents that the model finds to be content become so (each bad document keeps its worst line as boilerplate).
The least share is the one that parts the sample's good from its bad documents best, a good one lost counting LOSS times.
Without both kinds of labelled documents the fixed model PRIOR is used.

Defined results: null, empty and blank texts have no content, share 0, and are rejected. Rows are judged each by itself, repeated ones too. Of
conflicting labels of an id the mean counts, 0.5 being good; null labels and ids don't. An empty table gives an empty result. Extra columns are
kept by retained() and don't matter otherwise. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, ROUNDS, STEPS, LOSS = 3000, 2, 120, 10.0
UPPER, LOWER, DIGIT, BANG, BAR, MARK, DOT = range(7)
_KIND = np.full(256, 7, np.uint8)
for _k, _cs in ((UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (DIGIT, b"0123456789"), (BANG, b"!"), (BAR, b"|\t<>{}"), (MARK, b"#$%&*@^~=_+\\"), (DOT, b".,;:?")):
    _KIND[list(_cs)] = _k
FEATURES = 12


@dataclass(frozen=True)
class Model:
    """Weights of features and transitions for boilerplate against content, and the least share of content."""

    weights: tuple[float, ...]
    stay: float
    least: float
    center: tuple[float, ...] = (0.0,) * FEATURES
    scale: tuple[float, ...] = (1.0,) * FEATURES


PRIOR = Model((-3.0, 6.0, 2.0, 20.0, 20.0, 20.0, 0.0, 8.0, 0.0, 0.0, 0.0, 0.0), 0.7, 0.5)


def line_features(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines that aren't blank, their lengths in bytes, and n + 1 offsets of the texts' lines."""
    raw, offs = C.text_buffer(strings)
    n = len(offs) - 1
    if not len(raw):
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    begins = np.unique(np.r_[offs[:-1][np.diff(offs) > 0], np.flatnonzero(raw == 10) + 1])
    begins = begins[begins < len(raw)]
    ends = np.r_[begins[1:], len(raw)]
    kind = _KIND[raw]
    count = [np.add.reduceat((kind == k).view(np.int8), begins, dtype=np.int64).astype(np.float64) for k in range(7)]
    high = np.add.reduceat((raw >= 0xC0).view(np.int8), begins, dtype=np.int64).astype(np.float64)
    solid = raw > 32
    size = np.add.reduceat(solid.view(np.int8), begins, dtype=np.int64)
    line = np.zeros(len(raw), np.int32)
    line[begins[1:]] = 1
    line = np.cumsum(line, dtype=np.int32)
    at_begin = np.zeros(len(raw) + 1, bool)
    at_begin[begins] = at_begin[len(raw)] = True
    before = np.r_[False, solid[:-1]]
    w_start = np.flatnonzero(solid & (~before | at_begin[:-1]))
    after = np.r_[solid[1:], False]
    w_end = np.flatnonzero(solid & (~after | at_begin[1:])) + 1
    owner = line[w_start]
    n_words = np.bincount(owner, minlength=len(begins)).astype(np.float64)
    h = C.span_hashes(raw, w_start, w_end)
    again = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]
    repeats = np.bincount(owner, weights=again, minlength=len(begins))
    few = np.bincount(owner, weights=(w_end - w_start) <= 3, minlength=len(begins))
    # short lines tell little: their shares are drawn towards 0
    letters = 10 + count[UPPER] + count[LOWER]
    words = 3 + n_words
    x = np.stack(
        [np.ones(len(begins)), count[UPPER] / letters, count[DIGIT] / (10 + size), np.minimum(3, count[BANG] / words), np.minimum(3, count[BAR] / words), np.minimum(6, count[MARK] / words), np.minimum(3, count[DOT] / words), repeats / words, np.log1p(n_words), size / words / 8, few / words, high / letters],
        1,
    )
    keep = size > 0
    owner_text = np.searchsorted(offs, begins[keep], side="right") - 1
    return x[keep], size[keep], np.searchsorted(owner_text, np.arange(n + 1))


def features_of(texts: list[str], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of a list of texts, some at a time, which bounds the memory that it takes."""
    parts, at = [], 0
    while at < len(texts) or not parts:
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= most):
            n += len(texts[end])
            end += 1
        parts.append(line_features(pa.array(texts[at:end], pa.string())))
        at = end
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.r_[0, np.cumsum(counts)]


def viterbi(score: np.ndarray, stay: float, offsets: np.ndarray) -> np.ndarray:
    """True for boilerplate, from each line's score of boilerplate against content; a change of state costs `stay`. Ties are content."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    live = len(n) - np.searchsorted(np.sort(n), np.arange(longest), side="right")
    best = np.zeros((len(n), 2))
    came = np.zeros((len(score), 2), bool)  # from boilerplate
    starts = offsets[:-1][order]
    for k in range(longest):
        m = int(live[k])
        at = starts[:m] + k
        if k:
            c, b = best[:m, 0].copy(), best[:m, 1].copy()
            came[at, 0], came[at, 1] = b - stay > c, b >= c - stay
            best[:m, 0], best[:m, 1] = np.maximum(c, b - stay), np.maximum(b, c - stay)
        best[:m, 1] += score[at]
    out = np.zeros(len(score), bool)
    state = best[:, 1] > best[:, 0]
    for k in range(longest - 1, -1, -1):
        m = int(live[k])
        at = starts[:m] + k
        out[at] = state[:m]
        came_from = np.where(out[at], came[at, 1], came[at, 0])
        state[:m] = came_from
    return out


def shares(x: np.ndarray, size: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The shares of content of texts with these lines."""
    score = ((x - np.array(model.center)) / np.array(model.scale)) @ np.array(model.weights)
    junk = viterbi(score, model.stay, offsets)
    total = np.r_[0, np.cumsum(size)]
    good = np.r_[0, np.cumsum(np.where(junk, 0, size))]
    per = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    return per(good) / np.maximum(1, per(total))


def judge(strings: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lines and the shares of content of texts."""
    x, size, offsets = line_features(strings)
    return np.diff(offsets), shares(x, size, offsets, model)


def _fit_field(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and cost of change by the likelihood of the field, with a little shrinkage; weight is per text."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max())
    live = len(n) - np.searchsorted(np.sort(n), np.arange(longest), side="right")
    starts, of = offsets[:-1][order], np.repeat(np.arange(len(n)), n)
    lw = weight[of]
    changes_seen = np.bincount(of[1:], weights=(y[1:] != y[:-1]) & (of[1:] == of[:-1]), minlength=len(n)) @ weight
    theta = np.zeros(x.shape[1] + 1)
    theta[-1] = 1.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        s = x @ theta[:-1]
        stay = theta[-1]
        fw, bw = np.zeros((len(s), 2)), np.zeros((len(s), 2))
        for k in range(longest):
            at = starts[: live[k]] + k
            if k:
                c, b = fw[at - 1, 0], fw[at - 1, 1]
                fw[at, 0], fw[at, 1] = np.logaddexp(c, b - stay), np.logaddexp(b, c - stay)
            fw[at, 1] += s[at]
        for k in range(longest - 2, -1, -1):
            at = starts[: live[k + 1]] + k
            c, b = bw[at + 1, 0], bw[at + 1, 1] + s[at + 1]
            bw[at, 0], bw[at, 1] = np.logaddexp(c, b - stay), np.logaddexp(b, c - stay)
        z = np.logaddexp(fw[:, 0] + bw[:, 0], fw[:, 1] + bw[:, 1])
        p = np.exp(fw[:, 1] + bw[:, 1] - z)
        inner = np.flatnonzero(of[1:] == of[:-1])
        ex = np.exp(fw[inner, 0] - stay + bw[inner + 1, 1] + s[inner + 1] - z[inner]) + np.exp(fw[inner, 1] - stay + bw[inner + 1, 0] - z[inner])
        g = np.r_[x.T @ (lw * (y - p)), (ex @ lw[inner]) - changes_seen] / lw.sum()
        g[:-1] -= 1e-3 * theta[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta[-1] = np.clip(theta[-1], 0, 4)
    return theta[:-1], float(theta[-1])


def fit(texts: list[str], good: np.ndarray) -> Model:
    x, size, offsets = features_of(texts)
    some = np.diff(offsets) > 0
    good = good[some]
    if not good.any() or good.all():
        return PRIOR
    n = np.diff(offsets)[some]
    offsets = np.r_[0, np.cumsum(n)]
    of = np.repeat(np.arange(len(n)), n)
    center, scale = x.mean(0), x.std(0) + 1e-6
    center[0], scale[0] = 0, 1
    z = (x - center) / scale
    y = (~good)[of].astype(np.float64)
    weight = np.where(good, 1 / max(1, n[good].sum()), 1 / max(1, n[~good].sum())) * len(of)
    w, stay = _fit_field(z, y, offsets, weight)
    for _ in range(ROUNDS):
        s = z @ w
        worst = np.maximum.reduceat(s, offsets[:-1])[of]
        y = ((~good)[of] & ((s > 0) | (s >= worst))).astype(np.float64)
        w, stay = _fit_field(z, y, offsets, weight)
    model = Model(tuple(w.tolist()), stay, 0.5, tuple(center.tolist()), tuple(scale.tolist()))
    share = shares(x, size, offsets, model)
    at = np.arange(5, 96, 5) / 100
    value = [(share[~good] < t).mean() - LOSS * (share[good] < t).mean() for t in at]
    top = np.flatnonzero(np.array(value) >= max(value) - 1e-9)
    return Model(model.weights, stay, float(at[top[len(top) // 2]]), model.center, model.scale)


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    C.ready(docs.sparkSession)
    marks = C.pick(labels, id=id_col, good=label_col).where("id is not null and good is not null").groupBy("id").agg((F.avg("good") >= 0.5).alias("good"))
    # `sample` ids at most: a bounded table
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = C.pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("good").alias("good")).orderBy("id").collect()
    return fit([r["text"] or "" for r in rows], np.array([r["good"] for r in rows], bool))


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, "text"):
            n, share = judge(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(np.round(share, 6))], ["id", "n_lines", "content_share"])

    return run


def measures(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines and content_share of each row."""
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, text=text_col)
    return d.mapInArrow(_measure(model), f"id {dict(d.dtypes)['id']}, n_lines long, content_share double").withColumnRenamed("id", id_col)


def retained(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of the input that are retained, with all their columns."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, text_col):
            n, share = judge(b.column(text_col), model)
            yield b.filter(pa.array((n > 0) & (share >= model.least)))

    return docs.mapInArrow(run, docs.schema)
