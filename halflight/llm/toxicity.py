"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs and digit substitutions to the letters they stand for. The lexicon joins
fixed words with word stems that labelled rows teach. The weight of a text is that of its matches
outside exception phrases, normalised by its length; one logistic curve makes it a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.llm.common import null_safe_key
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

# Words that are insults by themselves.
INSULTS = (
    "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown "
    "clowns imbecile dumb retard bastard bitch asshole idiota imbécil estúpido estúpida basura "
    "escoria idiotin dummkopf abschaum arschloch connard crétin ordure").split()
# Phrases in which such a word is none.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "dumb bell", "dumb waiter",
    "the idiot by dostoevsky", "worthless check", "not stupid", "stupid simple")
# Characters and the letters they pass for. l and 1 pass for i, in text and lexicon.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "i", "ℓ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "€": "e", "|": "i", "l": "i", "\u200b": "", "\u200c": "", "\u200d": "", "\u00ad": ""}

#: Labelled rows that teach, about, drawn by a hash; the bound of the lexicon's and the curve's sample.
LABELLED_ROWS = 20_000
#: Lengths of learnt stems.
STEM = range(4, 9)
#: A stem is learnt from at least so many toxic rows and different words in them (a word counts in
#: each row), if its share among toxic rows is so many times its share among the others.
MIN_ROWS, MIN_WORDS, MIN_RATIO = 3, 8, 40.0
#: Weight of a fixed word, and the most that a learnt stem can weigh.
FIXED_WEIGHT, MAX_WEIGHT = 5.0, 8.0

_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
                      | {chr(0xFF41 + 11): "i"})
_BREAK = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words with a blank before, between and after; one blank for a text without words."""
    words = _BREAK.sub(" ", (text or "").lower().translate(_FOLD)).strip()
    return f" {words} " if words else " "


@dataclass
class Lexicon:
    """Whole words and stems (word beginnings) with weights, and phrases that take matches back."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, FIXED_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns begin with the blank before a word; ``stems`` are folded already."""
        found: dict[str, float | None] = {f" {s}": w for s, w in self.stems.items()}
        found |= {fold(word): weight for word, weight in self.words.items()}
        found |= {fold(phrase): None for phrase in self.exceptions}
        machine = ahocorasick.Automaton()
        for pattern, weight in found.items():
            machine.add_word(pattern, (len(pattern), weight))
        machine.make_automaton()
        return machine


def weigh(folded: str, machine: ahocorasick.Automaton) -> tuple[float, int]:
    """Weight of the matches and number of words; a word counts once, by its heaviest match."""
    words = folded.count(" ") - 1
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(folded) if len(machine) else ():
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    weight, reach = 0.0, -1
    excused.sort(reverse=True)
    for at in sorted(best):  # one sweep: ``reach`` is the farthest end of the phrases begun so far
        while excused and excused[-1][0] <= at:
            reach = max(reach, excused.pop()[1])
        if at >= reach:
            weight += best[at]
    return weight, max(words, 0)


@dataclass
class Model:
    lexicon: Lexicon
    bias: float = -4.0
    slope: float = 2.0

    def score(self, weight: float, words: int) -> float:
        return 1 / (1 + math.exp(-min(max(self.bias + self.slope * _density(weight, words), -30), 30)))


def _density(weight: float, words: int) -> float:
    """Weight per hundred words on a log scale."""
    return math.log1p(100 * weight / words) if words else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", rows: int = LABELLED_ROWS) -> DataFrame:
    """``text, toxic``: about ``rows`` labelled rows by a hash of the id; the rest of ``labels`` is
    not looked at. Null labels and ids teach nothing; of repeated labels the highest holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        null_safe_key(id_col).alias("_t_key")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("_t_key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    known = cut_lineage(known.filter(draw < min(1.0, rows / max(n, 1))))  # about ``rows``, so texts stay
    return docs.select(null_safe_key(id_col).alias("_t_key"), F.col(text_col).alias("text")).join(
        broadcast_if_small(known), "_t_key").select("text", "toxic")


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Folded word beginnings that tell toxic rows from others, with their log odds as weights.

    Equal texts count once. A stem is left out where a shorter one is in.
    """
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, plain, words = Counter(), Counter(), Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                here = Counter(w[:n] for w in set(fold(text).split()) for n in STEM if len(w) >= n)
                here[""] = 1
                (toxic if label else plain).update(here.keys())
                if label:
                    words.update(here)
            every = list(toxic.keys() | plain.keys())
            yield pd.DataFrame({"stem": every, "t": [toxic[s] for s in every],
                                "p": [plain[s] for s in every], "w": [words[s] for s in every]})

    counts = sample.mapInPandas(count, "stem string, t long, p long, w long").groupBy("stem").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("w").alias("w"))
    counts = counts.filter((F.col("stem") == "") | (
        (F.col("t") >= MIN_ROWS) & (F.col("w") >= MIN_WORDS) & (F.col("p") <= F.col("t"))))
    rows = {r.stem: (r.t, r.p) for r in counts.collect()}  # of a bounded sample
    toxic, plain = rows.pop("", (0, 0))
    found: dict[str, float] = {}
    for stem in sorted(rows, key=lambda s: (len(s), s)):
        t, p = rows[stem]
        ratio = (t / toxic) / ((p + 0.5) / (plain + 1))
        if ratio >= MIN_RATIO and not any(stem[:n] in found for n in STEM if n < len(stem)):
            found[stem] = min(math.log(ratio), MAX_WEIGHT)
    return found


def _curve(density: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the logistic curve, by Newton's method with a small ridge."""
    x, w = np.stack([np.ones(len(density)), density], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2),
                               x.T @ (toxic - p) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = LABELLED_ROWS) -> Model:
    """Model of a bounded sample of labelled rows. Without both kinds of labels the curve is a fixed
    one and the lexicon the fixed words."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows)
    lexicon = Lexicon(stems=learn_stems(sample))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"density": [_density(*weigh(fold(t), machine)) for t in batch["text"]],
                                "toxic": batch["toxic"]})

    seen = sample.mapInPandas(measure, "density double, toxic int").toPandas()  # as many as the sample
    if seen["toxic"].nunique() < 2:
        return Model(lexicon)
    bias, slope = _curve(seen["density"].to_numpy(), seen["toxic"].to_numpy(float))
    return Model(lexicon, bias, slope)


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1. Null and empty texts have no matches; equal texts score alike."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = model.lexicon.automaton()
        for batch in batches:
            yield pd.Series([model.score(*weigh(fold(t), machine)) for t in batch], dtype=float)

    return run(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score under ``threshold``; same columns. Empty tables give empty results."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.filter(toxicity(F.col(text_col), model) < threshold)
