"""Toxicity by a weighted finite-state grammar of clauses.

Words are read as classes: insult, threat, target, intent, negation, reported
speech.  Four transducers rewrite the classes of a clause from left to right:

* reported speech marks insults and threats that follow a word of saying;
* negation marks those that follow a negation within ``REACH`` words;
* target marks an insult near a person addressed, on either side;
* threat marks a threat with an intent before it or a target after it.

They are composed into one machine, whose output symbols a last transducer
weighs.  A clause scores the weighted sum of its insults' and threats' own
weights under those symbols; a text scores the sum of its clauses less what its
length alone leads one to expect, through a logistic function.  Clauses without
an insult or threat are not read.

What is learned, from the distinct texts of a bounded sample of labelled rows
(copies of a text count once, as toxic if any is labelled so): the insults (whole
words or word beginnings that mark the toxic rows, by greedy cover), their
weights, and the weights of the output symbols.

Defined cases: null and empty texts have no clause and score as any text
without a match; rows are scored each for itself, repeated ones alike; labels
that are null or have no document are not learned from, and repeated labels of
one id count by their largest; without toxic labelled rows there are no insults
and every score is below 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, shared, slices, texts

#: Labelled rows that the grammar is fitted on at most.
FIT_ROWS = 20_000
#: Words between a negation or target and what it marks.
REACH = 3
#: Held-out fold of the labelled rows: crc32 of the id's text, modulo 5.
FOLDS = 5

#: Closed word classes of the four languages.
TARGETS = """you your yours yourself youre he she they them him her those these people
du dich dir dein deine ihr euch euer sie er tu te toi ton ta vous votre vos il elle ils elles
tú ti tu vosotros usted ustedes él ella ellos ellas""".split()
INTENTS = "will gonna shall should must going werde wirst soll sollst muss vais vas va doit dois voy vas debes deberías".split()
NEGATIONS = "not no never nobody isnt arent dont doesnt nicht kein keine nie niemals pas jamais aucun ne no nunca jamás ningún".split()
REPORTS = """said says saying called calls wrote writes claimed claims quoted quotes reported reportedly allegedly
sagte sagt nannte schrieb behauptet angeblich dit disait appelé écrit affirme selon dijo dice llamó escribió según""".split()
THREATS = """kill murder hurt stab shoot strangle töten umbringen erschlagen erwürgen tuer assassiner égorger poignarder
matar asesinar apuñalar estrangular""".split()
THREAT_WEIGHT = 4.0

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;:,\n]")
SYMBOLS = "I J n r h K"  # insult, targeted, negated, reported; threat, made threat


# --- machines --------------------------------------------------------------------

@dataclass
class Machine:
    """A transducer that reads a symbol and writes one: (state, in) -> (state,
    out).  Symbols without an entry are copied and move as ``*`` does."""

    start: object
    step: Callable[[object, str], tuple[object, str]]

    def then(self, other: Machine) -> Machine:
        """The composition: what this machine writes, the other one reads."""
        def step(state: tuple, symbol: str) -> tuple[tuple, str]:
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Machine((self.start, other.start), step)

    def compiled(self, alphabet: str) -> dict[tuple[int, str], tuple[int, str]]:
        """The table of all reachable states, numbered from 0."""
        number, table, todo = {self.start: 0}, {}, [self.start]
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                to, out = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                table[number[state], symbol] = number[to], out
        return table


def reported() -> Machine:
    """After R, an insult is r and a threat is h for the rest of the clause."""
    def step(state: int, x: str) -> tuple[int, str]:
        return int(state or x == "R"), ({"I": "r", "H": "h"}.get(x, x) if state else x)

    return Machine(0, step)


def negated() -> Machine:
    """Within REACH words after N, an insult is n and a threat is h."""
    def step(left: int, x: str) -> tuple[int, str]:
        out = {"I": "n", "H": "h"}.get(x, x) if left else x
        return (REACH if x == "N" else max(0, left - 1)), out

    return Machine(0, step)


def targeted() -> Machine:
    """An insult within REACH words after T is J; T within REACH words after an
    insult is written as t."""
    def step(state: tuple[int, int], x: str) -> tuple[tuple[int, int], str]:
        target, insult = state
        out = "J" if x == "I" and target else "t" if x == "T" and insult else x
        return (REACH if x == "T" else max(0, target - 1), REACH if x in "IJ" else 0 if out == "t" else max(0, insult - 1)), out

    return Machine((0, 0), step)


def threatening() -> Machine:
    """A threat within REACH words after an intent, or after a target with
    intent, is K; a bare one is h."""
    def step(left: int, x: str) -> tuple[int, str]:
        out = ("K" if left else "h") if x == "H" else x
        return (REACH if x == "W" else max(0, left - 1)), out

    return Machine(0, step)


def grammar() -> dict[tuple[int, str], tuple[int, str]]:
    return reported().then(negated()).then(targeted()).then(threatening()).compiled("IHTNRWo")


# --- the model -------------------------------------------------------------------

@dataclass
class Model:
    """Insults with their weights (a trailing ``$`` marks a whole word; a weight
    is the log ratio of the rates in toxic and clean rows), the weight of each
    output symbol, that of a hundred words, that of the weights per word, and
    the constant."""

    insults: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: {"I": 1.0, "J": 1.2, "n": 0.5, "r": 0.5, "h": 0.2, "K": 1.5})
    length: float = -0.5
    density: float = 2.0
    constant: float = -2.0


class Scorer:
    """Reads texts with a model; made once in each task."""

    def __init__(self, model: Model):
        self.model, self.table = model, grammar()
        self.finder = ahocorasick.Automaton()
        weights = {w + "$": THREAT_WEIGHT for w in THREATS}
        self.kinds = {k: ("H", v) for k, v in weights.items()} | {k: ("I", v) for k, v in model.insults.items()}
        for k in self.kinds:
            self.finder.add_word(k.rstrip("$"), k)
        self.finder.make_automaton()
        self.classes = {w: c for c, words in (("T", TARGETS), ("W", INTENTS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of the clauses in which an insult or threat begins a word."""
        done = 0
        for end, key in self.finder.iter(text):
            start = end + 1 - len(key.rstrip("$"))
            if start < done or (start and text[start - 1].isalpha()):
                continue
            if key[-1] == "$" and not self._whole(text, end + 1):
                continue
            left = max((text.rfind(c, done, start) for c in ".!?;:,\n"), default=-1) + 1
            right = _CLAUSE_END.search(text, end + 1)
            done = right.start() if right else len(text)
            yield max(left, 0), done

    @staticmethod
    def _whole(text: str, stop: int) -> bool:
        """Whether a word ends here, or after a plural ending."""
        for ending in ("", "s", "es"):
            if text.startswith(ending, stop) and not text[stop + len(ending):stop + len(ending) + 1].isalpha():
                return True
        return False

    def kind(self, word: str) -> tuple[str, float]:
        for stem in (word + "$", word[:-1] + "$" if word[-1] == "s" else "", word[:-2] + "$" if word[-2:] == "es" else ""):
            if stem in self.kinds:
                return self.kinds[stem]
        for n in range(len(word), 2, -1):
            if word[:n] in self.kinds:
                return self.kinds[word[:n]]
        return self.classes.get(word, "o"), 0.0

    def features(self, text: str) -> np.ndarray:
        """Weights of insults and threats under each output symbol, the
        hundreds of words, and the weights per word (of a few words more)."""
        sums = dict.fromkeys(SYMBOLS.split(), 0.0)
        lower = text.lower()
        for start, stop in self.clauses(lower):
            state = 0
            last = 0.0
            for word in _WORD.findall(lower, start, stop):
                symbol, weight = self.kind(word)
                state, out = self.table[state, symbol]
                if out == "t":  # the insult before it turns out to have a target
                    sums["J"] += 0.5 * last
                elif out in sums:
                    sums[out] += weight
                    last = weight
        words = 1 + text.count(" ") + text.count("\n")
        return np.array([*sums.values(), words / 100, sum(sums.values()) / (words + 25)])

    def score(self, text: str) -> float:
        z = float(self.features(text) @ np.array([*self.model.factors.values(), self.model.length, self.model.density])) + self.model.constant
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


# --- learning --------------------------------------------------------------------

def held_out(key: str) -> F.Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``row``, ``text``, ``toxic`` of the distinct texts of at most ``rows``
    labelled rows outside the held-out fold, those with the smallest hashes of
    their ids; ``row`` is the text's hash."""
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id"))
             .groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    chosen = shared(known.orderBy(F.xxhash64("id"), "id").limit(rows), "toxic-labels")
    texts_ = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    once = texts_.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return shared(once.select(F.xxhash64("text").alias("row"), "text", "toxic"), "toxic-rows")


def greedy_cover(has: np.ndarray, toxic: np.ndarray, stems: list[str], least: float = 3.0) -> list[int]:
    """:func:`cover` of a matrix of rows and stems."""
    return cover(*np.nonzero(has), toxic.astype(float), stems, least)


def cover(row: np.ndarray, stem: np.ndarray, weight: np.ndarray, stems: list[str], least: float = 3.0) -> list[int]:
    """Stems that mark the toxic rows, best first; ``row`` and ``stem`` are the
    pairs of a row and a stem in it.  A row counts half as much for each stem
    chosen that it already has, so words that only come along with others gain
    little; a beginning or continuation of a chosen stem counts only where the
    chosen one is not."""
    by = np.argsort(stem, kind="stable")
    row, stem = row[by], stem[by]
    first = np.searchsorted(stem, np.arange(len(stems) + 1))
    live = np.ones(len(row), bool)
    chosen: list[int] = []
    while len(stems):
        gain = np.bincount(stem, weight[row] * live, len(stems))
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < least:
            break
        longer = [i for i, s in enumerate(stems) if s.startswith(stems[best]) and gain[i] >= 0.97 * gain[best]]
        best = max(longer, key=lambda i: len(stems[i]))
        chosen.append(best)
        own = slice(first[best], first[best + 1])
        marked = np.zeros(len(weight), bool)
        marked[row[own][live[own]]] = True
        weight = np.where(marked, weight / 2, weight)
        name = stems[best].rstrip("$")
        for i, s in enumerate(stems):
            if i != best and (s.startswith(name) or name.startswith(s.rstrip("$"))):
                kin = slice(first[i], first[i + 1])
                live[kin] &= ~marked[row[kin]]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression drawn towards ``prior``; the last column is the
    constant."""
    x = np.column_stack([x, np.ones(len(x))])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + pull / 2 * ((w - prior) ** 2).sum()
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w) - 1e-4 * size * (slope @ move):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn a model from labelled rows outside the held-out fold.  What comes
    to the driver is bounded by ``rows``: the toxic texts' pairs with the stems
    that mark them."""
    sample = training_rows(docs, labels, rows)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1):
        return Model()
    pos, neg = size[1], size.get(0, 0)
    words = shared(
        sample.select("row", "toxic", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .filter(F.length("word") >= 3).groupBy("row", "toxic", "word").agg(F.count("*").alias("c")), "toxic-words")
    of = lambda toxic, x: F.sum(F.when(F.col("toxic") == toxic, x).otherwise(0))
    counts = words.groupBy("word").agg(of(1, F.lit(1)).alias("p"), of(0, F.lit(1)).alias("n"), of(1, F.col("c")).alias("cp"), of(0, F.col("c")).alias("cn"))
    begin = F.transform(F.sequence(F.lit(3), F.least(F.length("word"), F.lit(10))), lambda n: F.substring("word", F.lit(1), n))
    stems = counts.select("*", F.explode(F.concat(begin, F.array(F.concat("word", F.lit("$"))))).alias("stem"))
    rare = neg / (10.0 * pos)  # clean rows with the stem for each toxic one
    good = (stems.groupBy("stem").agg(*[F.sum(x).alias(x) for x in ("p", "n", "cp", "cn")])
            .filter((F.col("p") >= 4) & (F.col("n") <= F.col("p") * rare)).select("stem", "cp", "cn"))
    good = shared(good, "toxic-stems")
    pairs = stems.select("word", "stem").join(good, "stem")
    marks = (words.filter("toxic = 1").join(pairs, "word").groupBy("stem", "cp", "cn").agg(F.collect_set("row").alias("rows"))
             .toArrow().sort_by("stem"))
    size_ = {r["toxic"]: r["c"] for r in words.groupBy("toxic").agg(F.sum("c").alias("c")).collect()}
    names, of_toxic, of_clean = (marks.column(x).to_pylist() for x in ("stem", "cp", "cn"))
    rows_of = marks.column("rows").combine_chunks()
    toxic_rows, row = np.unique(rows_of.flatten().to_numpy(), return_inverse=True)
    stem = np.repeat(np.arange(len(names)), rows_of.value_lengths().to_numpy())
    insults = {}
    for i in cover(row, stem, np.ones(len(toxic_rows)), names):
        p, n = float(of_toxic[i]), float(of_clean[i])
        insults[names[i]] = float(np.log((p + 0.5) / (size_.get(1, 0) + 1)) - np.log((n + 0.5) / (size_.get(0, 0) + 1)))
    insults = {k: v for k, v in insults.items() if v > 0}
    model = Model(insults)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for piece in slices(batches, "text"):
            found = [scorer.features(t).tolist() for t in texts(column(piece, "text"))]
            yield pa.RecordBatch.from_arrays([column(piece, "row"), column(piece, "toxic"), pa.array(found, pa.list_(pa.float64()))], ["row", "toxic", "x"])

    rows_ = sorted(map_arrow(sample.select("row", "toxic", "text"), read, "row long, toxic int, x array<double>").collect(), key=lambda r: r["row"])
    prior = np.array([*model.factors.values(), model.length, model.density, model.constant])
    w = logistic(np.array([r["x"] for r in rows_]), np.array([r["toxic"] for r in rows_], float), prior)
    return Model(insults, dict(zip(model.factors, w[:-3].tolist(), strict=True)), *w[-3:].tolist())


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", below: float | None = None) -> DataFrame:
    """Columns ``keep`` and ``score`` of each text; with ``below``, only rows
    that score less, without the score."""
    # a text that is kept goes to the workers once
    read_from = text if text in keep else "__text"
    whole = docs.select(*keep, *([] if text in keep else [F.col(text).alias(read_from)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for piece in slices(batches, read_from):
            score = np.array([scorer.score(t) for t in texts(column(piece, read_from))])
            rest = [column(piece, k) for k in keep]
            if below is None:
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*keep, "score"])
            else:
                yield pa.RecordBatch.from_arrays(rest, keep).filter(pa.array(score < below))

    return map_arrow(whole, read, schema + (", score double" if below is None else ""))
