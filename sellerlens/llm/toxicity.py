"""Toxicity of whole texts by a weighted finite-state grammar over clauses.

A text is cut into clauses, and a clause's words become symbols: insult ``I``, threat ``K``, target
``T``, negation ``N``, reported speech ``R``, mention ``M`` (talk about words), other ``o``. Five deterministic transducers read
them, composed into one machine: one rewrites insults shortly after a mention, one insults and threats shortly after a
negation, one those in reported speech, one threats whose target follows, and the last gives weights, higher once the
clause has named a target, and none to what is only mentioned, or both denied and reported. So a
score is a clause's and not a word's. A document's score is the logistic of its worst clause and of
the sum over its clauses.

The words of the insult class are a short fixed list and what labelled documents teach: stems (words or
beginnings of words) that stand in toxic documents and hardly in others, chosen greedily so that each
new stem explains toxic documents that the ones before don't. Stems and the three numbers of the
logistic are fitted on at most ``SAMPLE`` labelled documents, the first by a hash of the id. Scoring
reads every text whole, and nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches, stored

SAMPLE = 10_000       # labelled documents that are learned from, at most
STEMS = 400           # stems that are learned, at most
LEAST_DOCS = 3        # toxic documents that a new stem explains, at least, and
LEAST_SHARE = 0.003   # at least this share of all toxic ones
PRECISION = 0.95      # share of toxic documents among those that hold a stem, at least
STEM_LENGTHS = (4, 5, 6)

# A few words of each class in four languages.
INSULTS = "idiot moron loser scum pathetic worthless stupid trash disgusting imbecile".split()
THREATS = "kill murder strangle destroy töten umbringen tuer matar".split()
TARGETS = "you your yourself u he she they them him her du dich dir ihr tu toi vous te tú usted ustedes ellos sie".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca".split()
MENTIONS = "word words term noun adjective verb spelling wort begriff mot terme palabra término".split()
REPORTS = "said says say told wrote writes claimed quoted sagte schrieb écrit dijo escribió".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:,\n]+|\s[-–—]\s")


@dataclass(frozen=True)
class Transducer:
    """Deterministic; missing moves stay where they are, write what they read and weigh nothing."""

    start: object
    moves: dict = field(default_factory=dict)  # (state, symbol): (state, symbol written, weight)

    def step(self, state, symbol):
        return self.moves.get((state, symbol), (state, symbol, 0.0))

    def score(self, symbols) -> float:
        state, total = self.start, 0.0
        for symbol in symbols:
            state, _, weight = self.step(state, symbol)
            total += weight
        return total


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """Machine that writes what ``second`` writes on reading what ``first`` writes; weights add up."""
    start = (first.start, second.start)
    moves, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            one, middle, w1 = first.step(state[0], symbol)
            two, written, w2 = second.step(state[1], middle)
            moves[state, symbol] = ((one, two), written, w1 + w2)
            if (one, two) not in seen:
                seen.add((one, two))
                todo.append((one, two))
    return Transducer(start, moves)


NEAR = 3  # words that a negation, a mention and a threat reach
SYMBOLS = "IKTNRMo"

# Weights of insults and threats (small letters: denied; m: mentioned; r behind: in reported speech),
# before and after the clause has named a target. A threat that names its target afterwards counts as one that was aimed.
BARE = {"I": 1.0, "i": 0.1, "Ir": 0.6, "ir": 0.0, "K": 0.2, "k": 0.0, "Kr": 0.1, "kr": 0.0}
AIMED = {"I": 1.5, "i": 0.2, "Ir": 0.8, "ir": 0.0, "K": 1.1, "k": 0.1, "Kr": 0.3, "kr": 0.0}


def _shortly_after(sign: str, changed: dict[str, str], others: str) -> Transducer:
    """Rewrites the first of ``changed`` within ``NEAR`` words after ``sign``."""
    moves = {(0, sign): (NEAR, sign, 0.0)}
    for left in range(1, NEAR + 1):
        moves |= {(left, s): (left - 1, s, 0.0) for s in others}
        moves |= {(left, s): (0, new, 0.0) for s, new in changed.items()} | {(left, sign): (NEAR, sign, 0.0)}
    return Transducer(0, moves)


def grammar() -> Transducer:
    """Mention, negation, reported speech, threats and weights as one machine."""
    mention = _shortly_after("M", {"I": "m"}, "oTRNK")
    negation = _shortly_after("N", {"I": "i", "K": "k"}, "oTRMm")
    reported = Transducer("plain", {("told", s): ("told", s + "r", 0.0) for s in "IiKk"} | {("plain", "R"): ("told", "R", 0.0)})
    weights = {("bare", s): ("bare", s, w) for s, w in BARE.items()} | {("aimed", s): ("aimed", s, w) for s, w in AIMED.items()}
    weights |= {("bare", "T"): ("aimed", "T", 0.0)}
    for threat in ("K", "Kr"):  # a threat that waits for its target
        weights[("bare", threat)] = ((threat, NEAR), threat, BARE[threat])
        for left in range(1, NEAR + 1):
            on = (threat, left - 1) if left > 1 else "bare"
            weights |= {((threat, left), s): (on, s, BARE.get(s, 0.0)) for s in [*BARE, "o", "N", "R", "M", "m"] if s not in ("K", "Kr")}
            weights |= {((threat, left), s): ((s, NEAR), s, BARE[s]) for s in ("K", "Kr")}
            weights[((threat, left), "T")] = ("aimed", "T", AIMED[threat] - BARE[threat])
    machine = compose(mention, negation, SYMBOLS)
    for part in (reported, Transducer("bare", weights)):
        machine = compose(machine, part, SYMBOLS)
    return machine


class Scorer:
    """Clause scores of texts for a list of stems. A learned stem ends in ``*`` if it is a beginning."""

    def __init__(self, stems: list[str]) -> None:
        whole = {s for s in stems if not s.endswith("*")} | set(INSULTS)
        begins = {s[:-1] for s in stems if s.endswith("*")}
        self.machine = grammar()
        self.symbol = {w: s for s, words in (("o", []), ("M", MENTIONS), ("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("K", THREATS), ("I", whole)) for w in words}
        self.begins = tuple(sorted(begins))
        parts = [re.escape(w) + r"(?!\w)" for w in sorted(whole | set(THREATS))] + [re.escape(b) for b in self.begins]
        self.hit = re.compile(r"(?<!\w)(?:" + "|".join(parts) + ")")

    def symbols(self, clause: str) -> list[str]:
        words = _WORD.findall(clause)
        return [self.symbol.get(w) or ("I" if self.begins and w.startswith(self.begins) else "o") for w in words]

    def features(self, text: str | None) -> tuple[float, float]:
        """Worst clause, and logarithm of one more than the sum of all."""
        low = (text or "").lower()
        if not self.hit.search(low):
            return 0.0, 0.0
        scores = [self.machine.score(self.symbols(c)) for c in _CLAUSE.split(low) if self.hit.search(c)]
        return max(scores, default=0.0), float(np.log1p(sum(scores)))


@dataclass(frozen=True)
class Model:
    stems: list[str]
    numbers: tuple[float, float, float]  # intercept, worst clause, sum

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.numbers[0] + features @ np.array(self.numbers[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(ident: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> Model:
    """Stems and logistic from labelled documents that aren't held out.

    Null ids or labels are left out; of several labels for an id the highest counts. Without any
    usable label the fixed words and a fixed logistic remain.
    """
    by_batches(docs.sparkSession)
    marks = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_column).alias("id"), F.lower(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("text"))
    sample = stored(marks.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "labelled")
    known = stored(texts.join(sample, "id"), "texts")
    stems = _stems(known)
    rows = known.select("toxic", "text").mapInPandas(_features_of(stems), "toxic int, worst double, total double").toPandas()
    return Model(stems, _logistic(rows[["worst", "total"]].to_numpy(), rows["toxic"].to_numpy()))


def _stems(known: DataFrame) -> list[str]:
    """Of bounded size throughout: the sample has ``SAMPLE`` documents at most."""
    words = known.select("id", "toxic", F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    forms = F.concat(F.array("word"), *[
        F.when(F.length("word") >= n, F.array(F.concat(F.substring("word", 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>"))
        for n in STEM_LENGTHS
    ])
    held = words.select("id", "toxic", F.explode(forms).alias("stem")).distinct()
    good = held.groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("docs"))
    good = good.where((F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= PRECISION * F.col("docs")))
    rows = held.where("toxic = 1").join(good, "stem").select("stem", "id").toPandas()
    at_least = max(LEAST_DOCS, LEAST_SHARE * rows["id"].nunique())
    found: list[str] = []
    while len(rows) and len(found) < STEMS:
        counts = rows.groupby("stem").size().reset_index(name="n")
        counts = counts.assign(size=counts["stem"].str.len()).sort_values(["n", "size", "stem"], ascending=[False, True, True])
        stem, n = counts["stem"].iloc[0], counts["n"].iloc[0]
        if n < at_least:
            break
        found.append(stem)
        rows = rows[~rows["id"].isin(rows.loc[rows["stem"] == stem, "id"])]
    return found


def _features_of(stems: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(stems)
        for batch in batches:
            found = [scorer.features(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "worst": [a for a, _ in found], "total": [b for _, b in found]})

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small penalty; classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return -2.0, 3.0, 1.0
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w, penalty = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def score_column(model: Model, text: Column) -> Column:
    """Score of each text; null is scored as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.stems)
        for texts in batches:
            found = np.array([scorer.features(t) for t in texts]).reshape(-1, 2)
            yield pd.Series(model.scores(found))

    return score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of a text without any match. A null id isn't held out. Repeated
    rows get a row each, no rows give none, and other columns are not looked at.
    """
    model = learn(docs, labels, id_column, text_column)
    out = docs.select(
        F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), score_column(model, F.col(text_column)).alias("score")
    )
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5; columns unchanged."""
    model = learn(docs, labels, id_column, text_column)
    return docs.where(score_column(model, F.col(text_column)) < 0.5)
