"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a given and of a learned lexicon (as written and with disguises undone),
closeness to words for "you", capitals, punctuation and rates of obfuscation. Trees are
fitted to some of the labelled documents, the calibration to others.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results
from seclog.session import materialize

#: A given lexicon of insults and of words for the one spoken to; both are parameters.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers trash garbage scum worthless pathetic "
    "disgusting clown jerk dumbass retard retarded imbecile bastard filth filthy vermin ugly hate "
    "idiota imbécil estúpido basura dummkopf abschaum müll crétin imbécile ordure".split())
SECOND = frozenset("you your yours yourself u ur tu te ti vos usted du dich dir dein ihr euch vous toi votre".split())
#: Words learned per corpus, documents a learned word must be in, and its least log odds.
LEARNED, SUPPORT, LEAST_ODDS = 100_000, 5, 2.0
#: Labelled documents that trees and calibration are fitted to, at most; the lexicon counts all.
FIT_ROWS = 40_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 7
NEAR = 5

FEATURES = (
    "insults", "insult_kinds", "learned", "learned_top", "learned_kinds", "disguised", "near_you", "you",
    "capitals", "shouted", "exclaimed", "mixed", "spaced", "stretched", "symbols", "log_words")

_WORD = re.compile(r"[^\W\d_]+")
#: Signs that stand for letters in disguised words.
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"\b[a-z]+[0134578@$!*]+[a-z]+\b", re.I)
_SPACED = re.compile(r"\b(?:[a-z][ .*_-]){3,}[a-z]\b", re.I)
_STRETCHED = re.compile(r"([a-z])\1{2,}", re.I)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Lexicon:
    insults: frozenset[str]
    second: frozenset[str]
    learned: dict[str, float]


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, insults=INSULTS, second=SECOND, size: int = LEARNED, support: int = SUPPORT,
) -> Lexicon:
    """Words whose presence is likeliest to mean label 1, from all texts whose ids are in ``labels``.

    ``labels`` is as ``valid_labels`` gives it. A word is in it with ``support`` documents and log odds above
    those of all documents by LEAST_ODDS; the ``size`` strongest stay, ties by the word. A text's distinct
    words, not the text, move to meet its label; the empty word counts documents.
    """
    spaced = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")
    distinct = F.array_join(F.array_distinct(F.concat(F.array(F.lit("")), F.split(spaced, " "))), " ")
    known = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", distinct.alias("words"))
    word = known.join(labels.hint("shuffle_hash"), "doc_id").select(
        "label", F.explode(F.split("words", " ")).alias("word"))
    seen = word.groupBy("word").agg(
        F.sum(F.col("label").cast("long")).alias("toxic"), F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.where((F.col("n") >= support) | (F.col("word") == "")))
    total = seen.where("word = ''").first()
    rate = min(max(total.toxic / total.n if total else 0.0, 1e-4), 1 - 1e-4)
    odds = F.log((F.col("toxic") + rate) / (F.col("n") - F.col("toxic") + (1 - rate))) - math.log(rate / (1 - rate))
    strongest = seen.where("word <> ''").withColumn("odds", odds).where(
        F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.log("n")), "word").limit(size)
    return Lexicon(frozenset(insults), frozenset(second), {r["word"]: r["odds"] for r in strongest.collect()})


def measure(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features, in the order of FEATURES; a NULL or empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    words = words_of(text)
    n = len(words)
    learned, insults, second = lexicon.learned, lexicon.insults, lexicon.second
    hits = [i for i, w in enumerate(words) if w in insults or w in learned]
    you = [i for i, w in enumerate(words) if w in second]
    odds = [learned.get(words[i], 0.0) for i in hits]
    insulting = [words[i] for i in hits if words[i] in insults]
    disguises = _MIXED.findall(text)
    spaced = _SPACED.findall(text) and [re.sub(r"[^a-z]", "", m[0].lower()) for m in _SPACED.finditer(text)]
    uncovered = [w.translate(_PLAIN) for w in map(str.lower, disguises)] + list(spaced or ())
    uncovered += [_STRETCHED.sub(r"\1", w) for w in words if _STRETCHED.search(w)] if _STRETCHED.search(text) else []
    disguised = sum(w in insults or w in learned for w in uncovered)
    near, at = 0, 0
    for i in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        near += at < len(you) and you[at] <= i + NEAR
    size, per_word = len(text), 1 / max(n, 1)
    upper = sum(map(str.isupper, text)) if text.isascii() else sum(c.isupper() for c in text)
    return [
        100 * len(insulting) * per_word, float(len(set(insulting))), 100 * sum(odds) * per_word,
        max(odds, default=0.0), float(len({words[i] for i in hits if words[i] in learned})),
        float(disguised), float(near), 100 * len(you) * per_word, upper / size,
        sum(w.isupper() and len(w) > 2 for w in text.split()) * per_word,
        100 * (text.count("!") + text.count("?")) / size, 100 * len(disguises) * per_word,
        100 * len(spaced or ()) * per_word, 100 * len(uncovered) * per_word,
        100 * sum(map(text.count, "#*$%&@")) / size, math.log1p(n)]


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``features``, an array in the order of FEATURES."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        own = sent.value

        def work(columns):
            for text in columns[0]:
                yield (measure(text, own),)

        return work

    return add_results(docs, ["text"], make, "features array<double>", keep)


@dataclass(frozen=True)
class Model:
    """Without trees (no two labels to learn from) every score is the share of label 1."""

    lexicon: Lexicon
    rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def valid_labels(labels: DataFrame) -> DataFrame:
    """One row ``doc_id, label`` per id, without those that lack an id or have a label other than 0 and 1;
    an id with both is a 1."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(
        F.max("label").alias("label"))


def fit_shares(valid: DataFrame, fit_rows: int = FIT_ROWS) -> dict[int, float]:
    """The share of each label's rows to fit to: all that are label 1, up to half of ``fit_rows`` or to what
    label 0 leaves, then label 0."""
    n = dict(valid.groupBy("label").agg(F.count(F.lit(1))).collect())
    ones = min(n.get(1, 0), max(fit_rows // 2, fit_rows - n.get(0, 0)))
    return {1: ones / max(n.get(1, 0), 1), 0: min(1.0, (fit_rows - ones) / max(n.get(0, 0), 1))}


def fit_labels(labels: DataFrame, fit_rows: int = FIT_ROWS, shares: dict[int, float] | None = None) -> DataFrame:
    """About ``fit_rows`` rows of ``valid_labels`` at most, chosen evenly within a label by a hash of the id."""
    valid = valid_labels(labels)
    shares = fit_shares(valid, fit_rows) if shares is None else shares
    # as a fraction of the hash's range, so that the rows are the same in every run
    least = F.when(F.col("label") == 1, round(1_000_000 * shares[1])).otherwise(round(1_000_000 * shares[0]))
    return valid.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < least)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From the texts of ``docs`` whose ids are in ``labels`` (``doc_id, label``).

    All of them give the lexicon. Trees and calibration are fitted to ``fit_rows`` at most, few enough to
    broadcast: four fifths to the trees, the rest to the calibration, which weighs labels as they are in all.
    """
    valid = valid_labels(labels)
    lexicon = learn_lexicon(docs, valid)
    shares = fit_shares(valid, fit_rows)
    few = F.broadcast(fit_labels(labels, fit_rows, shares))
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(few, "doc_id")
    measured = with_features(chosen.select("doc_id", "label", "text"), lexicon, ["doc_id", "label"])
    stands_for = {k: 1 / v if v else 0.0 for k, v in shares.items()}  # rows of the label per chosen one
    rows = materialize(measured.select(
        F.col("row.label").cast("double").alias("label"), array_to_vector("features").alias("features"),
        F.when(F.col("row.label") == 1, stands_for[1]).otherwise(stands_for[0]).alias("stands_for"),
        (F.pmod(F.xxhash64(F.lit("calibrate"), "row.doc_id"), F.lit(5)) == 0).alias("calibrates")).repartition(8))
    by_part = {r[0]: (r[1], r[2]) for r in rows.groupBy("calibrates").agg(
        F.count(F.lit(1)), F.sum("label")).collect()}
    ones = sum(v[1] for v in by_part.values())
    zeros = sum(v[0] for v in by_part.values()) - ones
    rate = ones * stands_for[1] / max(1, ones * stands_for[1] + zeros * stands_for[0])
    fitted, held = by_part.get(False, (0, 0.0)), by_part.get(True, (0, 0.0))
    if not 0 < fitted[1] < fitted[0]:
        return Model(lexicon, rate)
    # label 1 is rare: both labels weigh the same in the trees, calibration sets the level right
    weight = F.when(F.col("label") == 1, fitted[0] / (2 * fitted[1])).otherwise(fitted[0] / (2 * (fitted[0] - fitted[1])))
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, weightCol="weight", maxBins=64,
        featureSubsetStrategy="all", cacheNodeIds=False,
    ).fit(rows.where(~F.col("calibrates")).withColumn("weight", weight))
    if not 0 < held[1] < held[0]:
        return Model(lexicon, rate, trees)
    raw = trees.transform(rows.where("calibrates")).select(
        "label", "stands_for", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="stands_for").fit(raw)
    return Model(lexicon, rate, trees, calibration)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``score`` (0 to 1), ``raw`` of the trees and ``predicted``.

    Only the whole text is looked at. NULL and empty texts have zero features and a score like others.
    Calibration gives steps; within a step the trees' own probability orders by at most a thousandth.
    """
    found = with_features(docs, model.lexicon, keep)
    if model.trees is None:
        found = found.withColumn("raw", F.lit(float(model.rate)))
    else:
        trees = model.trees.copy().setFeaturesCol("vector")
        found = trees.transform(found.withColumn("vector", array_to_vector("features")))
        found = found.withColumn("raw", vector_to_array("probability")[1])
    level = F.col("raw")
    if model.calibration is not None:
        found = model.calibration.copy().setFeaturesCol("raw").setPredictionCol("level").transform(found)
        level = F.col("level")
    settled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), level * 0.999 + F.col("raw") * 0.001))
    return found.select("row", settled.alias("score"), "raw", (settled >= 0.5).cast("int").alias("predicted"))
