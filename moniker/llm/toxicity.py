"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult and threat lexemes (with weights), targets (whom it is said to), negations, verbs of saying, quotation
marks, commas, ends of sentences, other words. Five transducers each follow one thing through a clause: whether an insult, a threat, a
target was read, whether a negation is near, whether speech is reported. They are composed into one deterministic machine
(states are tuples, found by walking from the start), whose transitions carry the factor by which a lexeme's weight counts and whose
ends of clauses carry the factor of the whole clause:

* an insult counts its weight, within NEAR words after a negation only NEGATED of it, in reported speech REPORTED of it;
* a clause with a target counts AIMED times; a threat counts only if a target follows it in the clause, and one that isn't always meant as such (MILD) only after
  words of intent in the clause, too; an insult that is an ordinary word as
  well (AMBIGUOUS, unless fitted as a lexeme) counts only in a clause with a target, other insults also without one;
* reported speech reaches to the end of the sentence, or, in quotation marks after a verb of saying, to the closing mark. A mark with no other
  after it in its paragraph (blank lines part them) opens nothing;
* a clause's score is the sum; a document's score is the sum of its clauses' and it is flagged from LEAST on.

The lexicon has a small dictionary, and lexemes fitted on labelled documents, at most SAMPLE toxic and CLEAN others (those of least hash
of id): words, and beginnings of words of 3 to 7 letters, that at least SUPPORT toxic documents have, none a near copy of another,
with odds of exp(ODDS) against the others, and so many that CHANCE such lexemes at most would be found by chance. Their weights grow with the log odds, from 1 to MOST. A beginning gives way to a longer
lexeme that EXPLAINED of its documents have. All texts are then read whole.

Defined results: null and empty texts have no clauses and aren't flagged. Rows are judged each by itself, repeated ones too; null ids are kept. Null
labels and labels of null ids don't count; of conflicting labels any toxic one counts. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, CLEAN, SUPPORT, ODDS, CHANCE, EXPLAINED, LEAST = 3000, 20_000, 4, 3.5, 0.05, 0.7, 0.9
NEAR, NEGATED, REPORTED, AIMED, CERTAIN, MOST = 2, 0.2, 0.3, 1.5, 1.0, 1.5
WORD, INSULT, THREAT, TARGET, NEGATION, SAYING, QUOTE, COMMA, STOP, AMBIGUOUS, LAST, INTENT, MILD = SYMBOLS = range(13)
WEIGHTED = (INSULT, THREAT, AMBIGUOUS, MILD)

DICTIONARY = {
    INSULT: "idiot idiots moron morons imbecile dumbass bastard arschloch vollidiot crétin connard imbécile idiota estúpido",
    AMBIGUOUS: "stupid worthless pathetic scum loser losers trash disgusting clown clowns",
    THREAT: "kill murder destroy strangle töten umbringen tuer matar",
    INTENT: "will i'll we'll he'll she'll they'll gonna going shall werde werden wird vais va vont allons voy vamos va",
    MILD: "shoot stab hurt beat hang burn hunt bury crush choke punch smash slaughter erschießen erschlagen verprügeln schlagen erwürgen vernichten verbrennen frapper abattre étrangler brûler détruire égorger golpear disparar quemar destruir ahorcar apuñalar",
    TARGET: "you your yourself u he she they him her them this these those dich dir du ihr ihn sie tu toi vous ils elle él ella usted ustedes",
    NEGATION: "not never no isn't aren't wasn't don't won't nicht kein keine niemals jamais nunca",
    SAYING: "said says say claimed claims wrote writes called quoted sagte sagt dit disait dijo dice",
}
# the empty token comes before a paragraph's last quotation mark
_TOKEN = re.compile(r"(?=[\"“”«»„](?:[^\"“”«»„\n]|\n(?![^\S\n]*\n))*+(?:\n|\Z))|[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n]|[,;:]|[\"“”«»„]")
Lexicon = dict[str, dict[str, float]]


class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and what a lexeme read then is multiplied by; at an end of a clause, what the clause is."""

    def __init__(self, start: int, step):  # noqa: ANN001
        self.start, self.step = start, step


def _insult(s: int, x: int) -> tuple[int, float]:
    return (0, 1.0) if x in (COMMA, STOP) else (1 if x in (INSULT, AMBIGUOUS) else s, 1.0)


def _threat(s: int, x: int) -> tuple[int, float]:
    """State 1: intent was spoken of; 2: a threat waits for its target; 3: it has one. Without one the threat counts nothing, at the end of the clause."""
    if x in (COMMA, STOP):
        return 0, 1.0
    if x == MILD:
        return (max(s, 2), 1.0) if s else (0, 0.0)
    if x == THREAT:
        return max(s, 2), 1.0
    return (3 if s == 2 and x == TARGET else 1 if s == 0 and x == INTENT else s), 1.0


def _target(s: int, x: int) -> tuple[int, float]:
    if x in (COMMA, STOP):
        return 0, AIMED if s else 1.0
    return 1 if x == TARGET else s, 1.0


def _negation(s: int, x: int) -> tuple[int, float]:
    """The state is the number of words that the negation still reaches."""
    if x in (COMMA, STOP):
        return 0, 1.0
    if x == NEGATION:
        return NEAR, 1.0
    return (s if x in (QUOTE, LAST) else max(0, s - 1)), NEGATED if s and x in WEIGHTED else 1.0


def _reported(s: int, x: int) -> tuple[int, float]:
    """1: a verb of saying reaches to the end of the sentence. 2: quotation marks that it opened reach to the closing ones. 3: as 1, but the mark that comes is the paragraph's last and opens nothing."""
    factor = REPORTED if s and x in WEIGHTED else 1.0
    if x == LAST:
        return 3 if s == 1 else s, factor
    if x == QUOTE:
        return {0: 0, 1: 2, 2: 0, 3: 1}[s], factor
    if x == STOP:
        return (2 if s == 2 else 0), factor
    return (max(s, 1), factor) if x == SAYING else (s, factor)


PARTS = [Transducer(0, f) for f in (_insult, _threat, _target, _negation, _reported)]


def compose(parts: list[Transducer]) -> tuple[list[list[int]], list[list[float]], list[bool], list[bool]]:
    """next[state][symbol] and factor[state][symbol] of the product machine, whether a state's threat has its target, and whether its clause has one."""
    start = tuple(p.start for p in parts)
    number, todo, nxt, factor = {start: 0}, [start], [], []
    while len(nxt) < len(todo):
        state = todo[len(nxt)]
        row, row_f = [], []
        for x in SYMBOLS:
            to, f = zip(*[p.step(s, x) for p, s in zip(parts, state, strict=True)], strict=True)
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
            row_f.append(float(np.prod(f)))
        nxt.append(row)
        factor.append(row_f)
    return nxt, factor, [s[1] == 3 for s in todo], [s[2] == 1 for s in todo]


NEXT, FACTOR, AIMED_THREAT, AIMED_CLAUSE = compose(PARTS)


class Reader:
    """Scores texts with a lexicon: {"word": {...}, "beginning": {...}} of insults and their weights, besides the dictionary."""

    def __init__(self, lexicon: Lexicon):
        self.symbols = {w: (k, CERTAIN) for k, ws in DICTIONARY.items() for w in ws.split()}
        for w, weight in lexicon["word"].items():
            if self.symbols.get(w, (AMBIGUOUS,))[0] == AMBIGUOUS:
                self.symbols[w] = (INSULT, weight)
        self.beginnings = lexicon["beginning"]
        self.lengths = sorted({len(b) for b in self.beginnings})
        for w in DICTIONARY[AMBIGUOUS].split():
            if self.symbols[w][0] == AMBIGUOUS and any(w[:n] in self.beginnings for n in self.lengths):
                del self.symbols[w]
        self.marks = {"\n": STOP, ".": STOP, "!": STOP, "?": STOP, ",": COMMA, ";": COMMA, ":": COMMA} | dict.fromkeys('"“”«»„', QUOTE) | {"": LAST}
        # what a text must have for any score: gates most texts out before they are read as symbols
        heads = sorted({w for w, (k, _) in self.symbols.items() if k in WEIGHTED} | set(self.beginnings))
        self.gate = ahocorasick.Automaton()
        for w in heads:
            self.gate.add_word(w, len(w))
        self.gate.make_automaton()
        self.cache: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        known = self.cache.get(token)
        if known is None:
            if len(self.cache) > 1 << 18:
                self.cache.clear()
            known = self.marks.get(token)
            known = (known, 0.0) if known is not None else self.symbols.get(token.replace("’", "'"))
            if known is None:
                known = next(((INSULT, self.beginnings[token[:n]]) for n in self.lengths if token[:n] in self.beginnings), (WORD, 0.0))
            self.cache[token] = known
        return known

    def may_score(self, low: str) -> bool:
        return any(end - n < 0 or not low[end - n].isalpha() for end, n in self.gate.iter(low))

    def score(self, text: str) -> tuple[float, int]:
        """The score, and the number of clauses that matched."""
        low = text.lower()
        if not self.may_score(low):
            return 0.0, 0
        total, clauses, state, insult, threat, ambiguous = 0.0, 0, 0, 0.0, 0.0, 0.0
        for token in [*_TOKEN.findall(low), "\n"]:
            x, weight = self.symbol(token)
            f = FACTOR[state][x]
            if x == INSULT:
                insult += weight * f
            elif x in (THREAT, MILD):
                threat += weight * f
            elif x == AMBIGUOUS:
                ambiguous += weight * f
            elif x in (COMMA, STOP):
                s = (insult + (threat if AIMED_THREAT[state] else 0.0) + (ambiguous if AIMED_CLAUSE[state] else 0.0)) * f
                if s > 0:
                    total += s
                    clauses += 1
                insult = threat = ambiguous = 0.0
            state = NEXT[state][x]
        return total, clauses


def marks_of(text: str) -> set[tuple[str, str]]:
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 2}
    return {("word", w) for w in words} | {("beginning", w[:n]) for w in words for n in range(3, 8) if len(w) > n}


def apart(texts: list[str]) -> list[str]:
    """Of texts that share one of their three least hashed word triples, as near copies do, only the first."""
    seen: set[int] = set()
    out = []
    for text in texts:
        w = re.findall(r"[^\W\d_]+", text.lower())
        least = sorted({zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))})[:3]
        if not seen.intersection(least):
            out.append(text)
        seen.update(least)
    return out


def candidates(toxic: list[str]) -> dict[tuple[str, str], int]:
    """Numbers of toxic documents, without near copies, that have each word or beginning, if SUPPORT at least."""
    count: Counter = Counter()
    for text in toxic:
        count.update(marks_of(text))
    return {m: n for m, n in count.items() if n >= SUPPORT}


def lexemes(found: Mapping[tuple[str, str], int], n_toxic: int, clean: Mapping[tuple[str, str], int], n_clean: int) -> Lexicon:
    """Those of the candidates that tell toxic documents, with weights."""
    out: Lexicon = {"word": {}, "beginning": {}}
    if not n_toxic or not n_clean or not found:
        return out
    rate = n_toxic / (n_toxic + n_clean)
    most = math.log(CHANCE / len(found))
    good, odds = [], {}
    for mark, n in found.items():
        m = clean.get(mark, 0)
        odds[mark] = math.log((n + 0.5) / n_toxic) - math.log((m + 0.5) / n_clean)
        chance = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(rate) + m * math.log(1 - rate)
        if odds[mark] >= ODDS and chance <= most:
            good.append((n, len(mark[1]) + (mark[0] == "word") / 2, mark))
    # a beginning that one longer lexeme explains for the most part gives way to it
    longer: Counter = Counter()
    for n, _, (_, w) in good:
        for k in range(3, len(w)):
            longer[w[:k]] = max(longer[w[:k]], n)
    for n, _, (kind, w) in sorted(good, key=lambda x: (x[1], x[2])):
        if kind == "beginning" and longer[w] >= EXPLAINED * n or any(w[:k] in out["beginning"] for k in range(3, len(w))):
            continue
        out[kind][w] = round(CERTAIN * min(odds[kind, w] / ODDS, MOST), 3)
    return out


def _count(found: list[tuple[str, str]]):
    number = {m: i for i, m in enumerate(found)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in C.pieces(batches, "text"):
            for text in b.column("text").to_pylist():
                total.update(number[m] for m in marks_of(text or "") if m in number)
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["mark", "n"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, clean: int = CLEAN) -> Lexicon:
    """The lexicon from at most `sample` toxic and `clean` other documents."""
    C.ready(docs.sparkSession)
    marks = C.pick(labels, id=id_col, bad=label_col).where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad") > 0).alias("bad"))
    draw = lambda c, n: marks.where(c).orderBy(F.xxhash64("id"), "id").limit(n)
    d = C.pick(docs, id=id_col, text=text_col)
    # bounded tables of ids
    toxic = d.join(F.broadcast(draw("bad", sample)), "id").where("text is not null").select("id", "text").orderBy("id", "text").collect()
    toxic = apart([r["text"] for r in toxic])
    found = candidates(toxic)
    others = d.join(F.broadcast(draw("not bad", clean)), "id").where("text is not null").select("text")
    names = list(found)
    count = {names[r["mark"]]: r["n"] for r in others.mapInArrow(_count(names), "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n")).collect()}
    return lexemes(found, len(toxic), count, draw("not bad", clean).count())


def _judge(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in C.pieces(batches, "text"):
            got = [(0.0, 0) if t is None else reader.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([round(s, 6) for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], ["id", "score", "n_clauses"])

    return run


def scores(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score and n_clauses (those matched) of each row."""
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, text=text_col)
    return d.mapInArrow(_judge(lexicon), f"id {dict(d.dtypes)['id']}, score double, n_clauses long").withColumnRenamed("id", id_col)


def flagged(docs: DataFrame, lexicon: Lexicon, *, least: float = LEAST, **columns: str) -> DataFrame:
    return scores(docs, lexicon, **columns).where(F.col("score") >= least)
