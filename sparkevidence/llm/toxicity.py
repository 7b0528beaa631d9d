"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are densities of toxic terms, their nearness to second-person words,
capitals, punctuation, and signs of obfuscation. The terms are a short general list and a lexicon
learned from labelled texts: words and word beginnings that toxic texts hold much more often than
others. The trees give a raw score, and an isotonic fit on rows that the trees have not seen turns
it into a probability.

Labelled rows outside the held-out fold (crc32 of the id mod 3 is 1) are split: remainder 2 teaches
the lexicon and the trees, remainder 0 the calibration. Each is fitted on ``FIT_ROWS`` rows or so,
chosen by a hash of the id; below that all are used. Every text is scored over its whole length.

Defined results: null and empty texts have zero features and a score; rows with several labels
count as toxic if one says so; null labels are not learned from; a null id counts as held out;
with only one class to learn from, every score is that class' share (0 without labels); repeated
rows are scored each. Labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

FIT_ROWS = 30_000
LEXICON_ROWS = 15_000
LEXICON_SIZE = 3_000
THRESHOLD = 0.7
_HASH_SPACE = 1 << 30

# General insults, and words that address the reader.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb scum trash garbage loser losers worthless pathetic "
    "disgusting clown fool fools hate hated kill die shut ugly freak freaks filth vermin pig pigs "
    "bastard bitch crap damn hell jerk liar liars retard shit fuck fucking ass asshole whore slut".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous "
    "votre vos tú ti tuyo usted ustedes vosotros".split()
)
_WORD = re.compile(r"\w+")
_RAW = re.compile(r"\S+")
_STRETCHED = re.compile(r"(.)\1{3,}", re.DOTALL)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_PREFIXES = range(5, 10)

FEATURES = (
    "log_words", "strong_density", "strong_count", "strong_distinct", "strong_weight", "mild_density",
    "insult_density", "insult_count", "second_person_density", "near_second_person", "capital_rate",
    "shouted_rate", "exclamation_rate", "question_rate", "punctuation_rate", "digit_rate",
    "mixed_rate", "masked_count", "stretched_rate", "repeat_rate",
)


def remainder(doc_id: Column, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(1))


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a circumflex."""
    return [word, *("^" + word[:k] for k in _PREFIXES if len(word) > k)]


class Features:
    """Features of a text, given the learned terms with their weights (log odds)."""

    STRONG, MILD, NEAR = 3.0, 1.5, 6

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = max((self.lexicon.get(x, 0.0) for x in terms_of(word)), default=0.0)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def _masked(self, raw: list[str]) -> int:
        """Tokens that become an insult or a strong term once their symbols are read as letters."""
        count = 0
        for token in raw:
            if not token.isalpha():
                plain = token.strip(".,;:!?\"'()").lower()
                if plain.isalpha() or not plain:
                    continue
                letters = re.sub(r"[^\w]|_", "", plain.translate(_LEET))
                count += letters in INSULTS or self.lexicon.get(letters, 0.0) >= self.STRONG
        return count

    def of(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        n = max(len(words), 1)
        weights = list(map(self.weight, words))
        strong = [i for i, w in enumerate(weights) if w >= self.STRONG]
        mild = sum(1 for w in weights if self.MILD <= w < self.STRONG)
        insults = [i for i, w in enumerate(words) if w in INSULTS]
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if persons and (strong or insults):
            at = np.array(sorted({*strong, *insults}))
            place = np.array(persons)
            right = place[np.minimum(np.searchsorted(place, at), len(place) - 1)]
            left = place[np.maximum(np.searchsorted(place, at) - 1, 0)]
            near = int((np.minimum(np.abs(right - at), np.abs(at - left)) <= self.NEAR).sum())
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        size = max(len(data), 1)
        upper = int(((data >= 65) & (data <= 90)).sum())
        digits = int(((data >= 48) & (data <= 57)).sum())
        marks = int(((data >= 33) & (data <= 47) | (data >= 58) & (data <= 64)).sum())
        raw = _RAW.findall(text)
        odd = [x for x in raw if not x.isalpha()]
        mixed = sum(1 for x in odd if any(map(str.isdigit, x)) and any(map(str.isalpha, x)))
        shouted = sum(1 for x in raw if len(x) > 2 and x.isupper())
        return [
            math.log1p(len(words)), 1000 * len(strong) / n, len(strong),
            len({words[i] for i in strong}), sum(weights[i] for i in strong) / n, 1000 * mild / n,
            1000 * len(insults) / n, len(insults), 1000 * len(persons) / n, near, upper / size,
            shouted / n, text.count("!") / n, text.count("?") / n, marks / size, digits / size,
            mixed / n, self._masked(odd), len(_STRETCHED.findall(text)) / n, 1 - len(set(words)) / n,
        ]


def _term_counts(batches):
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            terms = {t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)}
            counts[toxic].update(terms)
        terms = sorted(counts[0].keys() | counts[1].keys())
        made = [pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *made], names=["term", "bad", "good"])


def _chosen(rows: int, total: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_SPACE)) < int(min(1.0, rows / max(total, 1)) * _HASH_SPACE)


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Terms with log odds above ``Features.MILD``, from labels (doc_id, toxic) of LEXICON_ROWS rows."""
    total, bad = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == total:
        return {}
    some = F.broadcast(labels.where(_chosen(LEXICON_ROWS, total)))  # LEXICON_ROWS ids or so
    counted = (
        docs.select("doc_id", "text")
        .join(some, "doc_id")
        .select("text", "toxic")
        .mapInArrow(_term_counts, "term string, bad bigint, good bigint")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    share = min(1.0, LEXICON_ROWS / total)
    n_bad, n_good = bad * share + 1, (total - bad) * share + 1
    odds = F.log((F.col("bad") + 0.5) / n_bad) - F.log((F.col("good") + 0.5) / n_good)
    top = (
        counted.where("bad >= 4")
        .select("term", odds.alias("odds"), (odds * F.sqrt("bad")).alias("weight"))
        .where((F.col("odds") >= Features.MILD) & (F.col("weight") >= 6))
        .orderBy(F.desc("weight"), "term")
        .limit(LEXICON_SIZE)
        .collect()
    )
    return {r.term: r.odds for r in top}


def featured(docs: DataFrame, lexicon: dict[str, float], keep=("doc_id",)) -> DataFrame:
    """The ``keep`` columns and one double for each feature."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = {x.name: x.dataType.simpleString() for x in docs.schema.fields}
    schema = ", ".join([*(f"`{x}` {fields[x]}" for x in keep), *(f"{x} double" for x in FEATURES)])

    def run(batches):
        maker = Features(shared.value)
        for batch in batches:
            found = [maker.of(x or "") for x in batch.column("text").to_pylist()]
            columns = np.array(found, dtype=np.float64).reshape(len(found), len(FEATURES)).T
            made = [pa.array(np.ascontiguousarray(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), *made], names=[*keep, *FEATURES]
            )

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learned from labels (doc_id, toxic)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = stored(known.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 1"))
    sizes = {r.fold: r for r in known.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    fit = known.where("fold = 2")
    base = stored(featured(rows, learn_lexicon(rows, fit.select("doc_id", "toxic"))))
    held_out = (remainder(F.col("doc_id")) == 1).alias("held_out")
    both = [k for k, r in sizes.items() if 0 < r.bad < r.n]
    if 2 not in both:
        n, bad = sum(r.n for r in sizes.values()), sum(r.bad for r in sizes.values())
        scored = base.select("doc_id", F.lit(bad / n if n else 0.0).alias("score"))
    else:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(base)
        taught = known.where(_chosen(FIT_ROWS, max(r.n for r in sizes.values()))).hint("shuffle_merge")
        samples = stored(assembled.join(taught, "doc_id").select("doc_id", "fold", "x", F.col("toxic").cast("double").alias("label")))
        trees = GBTClassifier(
            featuresCol="x", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, minInstancesPerNode=5, seed=7
        ).fit(samples.where("fold = 2").select("x", "label"))
        raw = vector_to_array("probability")[1].alias("raw")
        scored = trees.transform(assembled.select("doc_id", "x")).select("doc_id", raw)
        if 0 in both:
            seen = trees.transform(samples.where("fold = 0").select("x", "label")).select(raw, "label")
            curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="fitted").fit(seen)
            # the flat steps of the curve keep the order of the raw scores
            scored = curve.transform(scored).withColumn("raw", 0.999 * F.col("fitted") + 0.001 * F.col("raw"))
        scored = scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "raw")).alias("score"))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
