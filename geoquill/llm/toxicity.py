"""Toxicity by a weighted finite-state pattern grammar.

The lexical transducer maps tokens to symbols: INSULT and THREAT entries carry weights learnt from labelled documents;
TARGET, NEGATION and REPORT entries are fixed word lists of four languages. Four clause transducers read symbols and put
marks on them:

* negation: an insult or threat within three tokens after a negation is marked negated;
* reported speech: after a reporting verb, or inside quotation marks, it is marked reported;
* target: with an address (you, your, ...) within four tokens before it, it is marked targeted;
* company: it accepts a clause only if an insult or threat stands there with another word, so a lone word is no match.

They are composed into one machine (:mod:`transducers`), which runs once over each clause. A matched clause's score is
the sum of its events' weights; a document's score is a logistic function of its matched clauses' scores by mark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, small_batches, stored
from .hashing import shingles, word_hashes
from .transducers import Transducer, build, cascade

#: Most labelled rows that lexicon weights and mark weights are learnt from; scoring covers all rows.
FIT_ROWS = 16_000
#: Most lexicon entries kept; a grammar's size is bounded whatever the corpus.
ENTRIES = 3_000
#: Evidence that an entry needs: G-squared of its association, and the ratio of its rates in toxic and other documents.
LEAST_G2, LEAST_RATIO = 18.0, 12.0
#: Distinct toxic texts that an entry occurs in at least; chance words of one text and its copies look strong.
LEAST_TEXTS = 8
THRESHOLD = 0.5

#: Closed word lists of English, German, French and Spanish.
TARGET = "you your youre you're u ur yourself du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
NEGATION = "not never no isn't isnt aren't wasn't don't dont doesn't neither nor without nicht nie kein keine niemals ohne ne pas jamais aucun sans nunca jamás ni sin tampoco".split()
REPORT = "said says say wrote writes called calls quoted quote claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREAT = "kill hurt destroy attack shoot stab beat burn murder töten schlagen umbringen erschießen tuer frapper détruire brûler matar golpear destruir quemar".split()

_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"«»“”„]")
_WORD = re.compile(r"[^\W\d_]{4,}")
_QUOTES = frozenset('"«»“”„')
MARKS = ("plain", "targeted", "negated", "reported")
FEATURES = [*MARKS, "threat", "strongest", "clauses"]
#: What the grammar says before any labels are seen; labels move it.
PRIOR = np.array([1.0, 1.5, 0.3, 0.5, 0.5, 0.5, 0.3])

#: Symbols: a class, and bits of marks in steps of the number of classes.
OTHER, INSULT, THREATENS, ADDRESS, NEGATES, REPORTS, QUOTE = range(7)
CLASSES, NEGATED, REPORTED, TARGETED = 7, 1, 2, 4
ALPHABET = CLASSES * 8


def _marking(states: int, on, after, bit: int) -> Transducer:
    """Puts ``bit`` on insults and threats met in a state that is ``on``; ``after`` gives the next state by class."""

    def rule(state: int, x: int) -> tuple[int, int]:
        marks, kind = divmod(x, CLASSES)
        if kind in (INSULT, THREATENS) and on(state):
            marks |= bit
        return after(state, kind), marks * CLASSES + kind

    return build(states, ALPHABET, rule)


def machines() -> list[Transducer]:
    """The clause transducers, in the order in which they are composed. Quotation marks are no tokens to the counters."""
    within = lambda n, opener: lambda s, kind: s if kind == QUOTE else n if kind == opener else max(0, s - 1)
    told = lambda s, kind: s ^ 2 if kind == QUOTE else s | 1 if kind == REPORTS else s
    negation = _marking(4, bool, within(3, NEGATES), NEGATED)
    reported = _marking(4, bool, told, REPORTED)
    target = _marking(5, bool, within(4, ADDRESS), TARGETED)

    def meets(state: int, x: int) -> tuple[int, int]:  # 0 nothing, 1 words, 2 one event alone, 3 an event with a word
        kind = x % CLASSES
        event = kind in (INSULT, THREATENS)
        return (state if kind == QUOTE else ((2 if event else 1), (3 if event else 1), 3, 3)[state]), x

    company = build(4, ALPHABET, meets, lambda state: state == 3)
    return [negation, reported, target, company]


@dataclass
class Grammar:
    entries: dict[str, tuple[float, bool, bool]]  # text -> weight, whole word only, threat
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    base: float = -3.0

    def __post_init__(self) -> None:
        self._find = None
        self._closed = {**dict.fromkeys(TARGET, ADDRESS), **dict.fromkeys(NEGATION, NEGATES), **dict.fromkeys(REPORT, REPORTS), **dict.fromkeys(_QUOTES, QUOTE)}
        whole = cascade(machines())
        self._step, self._out, self._final = whole.step[:, :CLASSES].tolist(), whole.out[:, :CLASSES].tolist(), whole.final.tolist()

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "weights": self.weights, "base": self.base}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def finder(self):
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for text in self.entries:
                self._find.add_word(text, text)
            if self.entries:
                self._find.make_automaton()
        return self._find

    def lexical(self, token: str) -> tuple[float, bool] | None:
        """The lexical transducer of insults and threats: the longest entry that the token is or begins with."""
        for n in range(len(token), 2, -1):
            found = self.entries.get(token[:n])
            if found and (not found[1] or n == len(token)):
                return found[0], found[2]
        return None

    def clause(self, text: str) -> tuple[list[tuple[str, float]], float]:
        """Events (mark, weight) of a matched clause, and the weight of its threats: one run of the composed machine."""
        state, step, out = 0, self._step, self._out
        events, threat = [], 0.0
        for m in _TOKEN.finditer(text):
            token = m.group()
            kind = self._closed.get(token)
            if kind is None:
                hit = self.lexical(token)
                kind = OTHER if hit is None else THREATENS if hit[1] else INSULT
                if hit:
                    marks = out[state][kind] // CLASSES
                    mark = "negated" if marks & NEGATED else "reported" if marks & REPORTED else "targeted" if marks & TARGETED else "plain"
                    events.append((mark, hit[0]))
                    threat += hit[0] * hit[1]
            state = step[state][kind]
        return (events, threat) if self._final[state] else ([], 0.0)

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text or not self.entries:
            return out
        low = text.lower()
        spots = sorted({e - len(w) + 1 for e, w in self.finder().iter(low) if not (e - len(w) >= 0 and low[e - len(w)].isalpha())})
        done = -1
        for s in spots:
            if s < done:
                continue
            begin = max((low.rfind(c, 0, s) + 1 for c in ".!?;\n"), default=0)
            end = _CLAUSE.search(low, s)
            done = end.start() if end else len(low)
            events, threat = self.clause(low[begin:done])
            if events:
                score = sum(w for _, w in events)
                for mark, w in events:
                    out[MARKS.index(mark)] += w
                out[4] += threat
                out[5] = max(out[5], score)
                out[6] += 1
        return np.log1p(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([self.features(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)))
        return 1 / (1 + np.exp(-(self.base + x @ self.weights)))


def _candidates(text: str | None) -> set[str]:
    """Whole words (with a full stop behind) and stems of four to seven letters."""
    words = set(_WORD.findall((text or "").lower()))
    return {w + "." for w in words} | {w[:n] for w in words for n in range(4, min(8, len(w) + 1))}


def induce(sample: DataFrame) -> dict[str, tuple[float, bool, bool]]:
    """Weighted entries from (text, y): document counts by label are summed over the sample, the strongest come back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = (Counter(), Counter())
            for text, y in zip(b["text"], b["y"], strict=True):
                both[int(y > 0)].update(_candidates(text))
            yield pd.DataFrame([(w, both[1][w], both[0][w]) for w in set(both[0]) | set(both[1])], columns=["entry", "tox", "ok"])

    nt, nc = (int(x or 0) for x in sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not nt or not nc:
        return {}
    sums = sample.select("text", "y").mapInPandas(count, "entry string, tox long, ok long").groupBy("entry").agg(F.sum("tox").alias("a"), F.sum("ok").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both, rest, total = a + b, nt + nc - a - b, float(nt + nc)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g2 = 2 * (term(a, both * nt / total) + term(b, both * nc / total) + term(nt - a, rest * nt / total) + term(nc - b, rest * nc / total))
    ratio = ((a + 0.5) / (nt + 1)) / ((b + 0.5) / (nc + 1))
    seed = F.regexp_replace("entry", r"\.$", "").isin(THREAT) & F.col("entry").endswith(".")
    keep = sums.where(F.col("a") >= LEAST_TEXTS).select("entry", "a", g2.alias("g2"), ratio.alias("ratio"), seed.alias("seed")).where(
        ((F.col("g2") >= LEAST_G2) & (F.col("ratio") >= LEAST_RATIO)) | (F.col("seed") & (F.col("ratio") > 2))
    )
    found = keep.orderBy(F.desc("g2"), "entry").limit(ENTRIES).collect()
    entries: dict[str, tuple[float, bool, bool]] = {}
    seen = {r["entry"]: r["a"] for r in found}
    for word, n in list(seen.items()):  # a stem that one word nearly accounts for gives way to the word
        for stem in (word[:k] for k in range(4, len(word))) if word.endswith(".") else ():
            if seen.get(stem, 1 << 60) * 0.95 <= n:
                del seen[stem]
    found = [r for r in found if r["entry"] in seen]
    for r in sorted(found, key=lambda r: (len(r["entry"]), r["entry"])):  # a stem makes its longer forms superfluous
        text, whole = r["entry"].rstrip("."), r["entry"].endswith(".")
        if not any(text[:n] in entries and not entries[text[:n]][1] for n in range(4, len(text) + 1)):
            entries[text] = (min(6.0, float(np.log(r["ratio"]))), whole, any(text.startswith(t[:6]) for t in THREAT if len(text) >= 4))
    return entries


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One of each group of copies, exact or near: those that share their least shingle of five words and the label.

    A toxic text copied often would make entries of all its words. ``sample`` is bounded, and so are its ids.
    """

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingles(word_hashes(t), 5) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "s": [int(x[0]) if len(x) else 0 for x in own]})

    ids = sample.select("doc_id", "y", "text").mapInPandas(least, "doc_id long, y int, s long").groupBy("y", "s").agg(F.min("doc_id").alias("doc_id"))
    return stored(sample.join(F.broadcast(ids.select("doc_id")), "doc_id"), "toxicity-sample")


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Grammar:
    """Learn entries and mark weights from at most about ``most`` labelled rows outside the held-out fifth."""
    small_batches(docs.sparkSession)
    sample = distinct_texts(stored(labelled_sample(docs.sparkSession, docs, labels, label, most), "toxicity-sample"))
    grammar = Grammar(induce(sample))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [grammar.features(t) for t in b["text"]]})

    rows = sample.mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(float)
    rate = (y.sum() + 1) / (len(y) + 2)
    grammar.base = float(np.log(rate / (1 - rate))) - 2.0 * bool(grammar.entries)
    if len(y) and 0 < y.sum() < len(y):
        x = np.column_stack([np.ones(len(y)), np.stack(rows["x"].tolist())])
        prior = np.concatenate([[grammar.base], PRIOR])
        w, pull = prior.copy(), np.array([0.01, *[1.0] * len(PRIOR)])
        for _ in range(30):  # Newton steps to the posterior mode
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
            w = w + np.clip(step, -2, 2)
        grammar.base, grammar.weights = float(w[0]), w[1:]
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row. Null and empty texts have no clauses and get the base score; repeated
    rows get equal scores; an empty table gives an empty result; other columns are dropped."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = grammar.score(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype("int32")})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(scan, "doc_id long, score double, predicted int")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by a grammar fitted on rows outside the held-out fifth.

    Null and empty texts get the base score, repeated rows equal scores; a null id counts as held out and is kept; an
    empty table gives an empty result, empty labels the prior grammar. Other columns are ignored.
    """
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
