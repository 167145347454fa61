"""Language ID by mixtures: expectation-maximisation over the n-gram likelihoods of a text's words.

Training counts hashed letter n-grams per language over all labelled documents. A text's words
get a likelihood under every language; expectation-maximisation finds the proportions of the
languages in it, and languages are dropped while that lowers a penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results, map_rows, portions

#: Hashed n-grams: three characters with the word's ends, in 2**BITS buckets.
BITS = 16
#: A bound on the languages of a model, so that it fits into a task: 2**BITS floats each.
MAX_LANGUAGES = 256
ROUNDS, TOLERANCE = 30, 1e-4
#: Likelihood a language must add per logarithm of the number of words, to stay in the set.
PENALTY = 2.0
#: Characters of texts that are looked at together, and the floor of a relative log likelihood.
PORTION, LEAST_LOG = 1 << 20, -60.0

UNKNOWN = "und"
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _letters() -> np.ndarray:
    """True for the letters of the basic plane; other planes are asked one by one."""
    return np.array([chr(c).isalpha() for c in range(0x10000)], bool)


_IS_LETTER = _letters()


def letters_of(points: np.ndarray) -> np.ndarray:
    found = _IS_LETTER[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        found[high] = [chr(c).isalpha() for c in points[high]]
    return found


def word_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, place of the first n-gram of every word, number of words by text).

    Words are runs of letters in lower case; with a mark at both ends, n letters have n n-grams.
    """
    lower = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters_of(points)
    at = np.flatnonzero(is_letter)
    marked = np.where(is_letter, points, np.uint32(0))  # the first and the last are no letters
    before, own, after = marked[at - 1], marked[at], marked[at + 1]
    h = before * _A + own * _B + after * _C
    h ^= h >> np.uint32(15)
    buckets = (h * _A) >> np.uint32(32 - BITS)
    starts = np.flatnonzero(before == 0)
    ends = np.cumsum([len(t) + 1 for t in lower])
    upto = np.searchsorted(at[starts], ends, "right") if len(at) else np.zeros(len(lower), np.int64)
    return buckets, starts, np.diff(upto, prepend=0)


def gram_counts(docs: DataFrame, language: Column) -> DataFrame:
    """``lang, bucket, n`` over all texts with a language: one dense count per task and language."""
    given = docs.where(language.isNotNull() & F.col("text").isNotNull()).select(
        language.alias("lang"), "text")

    def make():
        held: dict[str, np.ndarray] = {}

        def work(columns):
            langs, texts = columns
            for lang in set(langs):
                buckets, _, _ = word_grams([t for k, t in zip(langs, texts) if k == lang])
                if lang not in held:
                    held[lang] = np.zeros(1 << BITS, np.int64)
                held[lang] += np.bincount(buckets, minlength=1 << BITS)
            return ()

        def finish():
            for lang, counts in held.items():
                found = np.flatnonzero(counts)
                yield from zip([lang] * len(found), found.tolist(), counts[found].tolist())

        return work, finish

    return map_rows(given, make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """Logarithms of bucket probabilities: one row per language, in the order of the names."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def train(docs: DataFrame, language: Column | None = None) -> LanguageModel:
    """A model of all documents with text and language; equal documents count every time.

    Without such a document the model has no language and every prediction is ``und``.
    """
    counts = gram_counts(docs, F.col("lang") if language is None else language)
    rows = counts.groupBy("lang").agg(
        F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"),
    ).limit(MAX_LANGUAGES + 1).collect()  # 2**BITS numbers for each of at most MAX_LANGUAGES
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES")
    rows = sorted(rows, key=lambda r: r["lang"])
    log_p = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, row in enumerate(rows):
        n = np.zeros(1 << BITS)
        n[row["bucket"]] = row["n"]
        log_p[k] = np.log((n + 0.1) / (n.sum() + 0.1 * (1 << BITS)))
    return LanguageModel(tuple(r["lang"] for r in rows), log_p)


def word_likelihoods(model: LanguageModel, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row per word: its log likelihood under every language."""
    if not len(starts):
        return np.empty((0, len(model.languages)))
    return np.stack([np.add.reduceat(p[buckets], starts) for p in model.log_p], axis=1)


class Mixtures:
    """Language proportions of several texts at once; ``counts`` are their words, none of them 0."""

    def __init__(self, scores: np.ndarray, counts: np.ndarray):
        self.counts = counts
        self.starts = np.cumsum(counts) - counts
        top = scores.max(axis=1, keepdims=True)
        self.top = np.add.reduceat(top[:, 0], self.starts, dtype=np.float64)
        self.p = np.exp(np.maximum(scores - top, LEAST_LOG)).astype(np.float32)

    def part(self, chosen: np.ndarray) -> Mixtures:
        """The texts where ``chosen`` is true."""
        out = object.__new__(Mixtures)
        out.counts, out.top = self.counts[chosen], self.top[chosen]
        out.starts = np.cumsum(out.counts) - out.counts
        out.p = self.p[np.repeat(chosen, self.counts)]
        return out

    def _joint(self, share: np.ndarray) -> np.ndarray:
        return self.p * np.repeat(share, self.counts, axis=0)

    def fit(self, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Expectation-maximisation from ``share``, whose zeros stay; settled texts step aside."""
        share, own, at = share.astype(np.float32), self, np.arange(len(share))
        for _ in range(rounds):
            joint = own._joint(share[at])
            joint /= joint.sum(axis=1, keepdims=True)
            new = np.add.reduceat(joint, own.starts, axis=0) / own.counts[:, None]
            moving = np.abs(new - share[at]).max(axis=1) > TOLERANCE
            share[at] = new
            if not moving.any():
                break
            if own.counts[moving].sum() < 0.7 * own.counts.sum():
                own, at = own.part(moving), at[moving]
        return share

    def log_likelihood(self, share: np.ndarray) -> np.ndarray:
        fit = np.log(self._joint(share.astype(np.float32)).sum(axis=1), dtype=np.float64)
        return np.add.reduceat(fit, self.starts) + self.top


def language_sets(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of the languages of every text's set, 0 for others.

    From all languages, the one with the least proportion is dropped while the likelihood less
    ``penalty`` * log(words) for each language does not fall.
    """
    texts, names = Mixtures(scores, counts), scores.shape[1]
    share = texts.fit(np.full((len(counts), names), 1 / names))
    fit = texts.log_likelihood(share)
    cost = penalty * np.log(counts + 1.0)
    at = np.arange(len(counts))
    for size in range(names - 1, 0, -1):
        order = np.argsort(share[at], axis=1, kind="stable")
        rest = share[at].copy()
        np.put_along_axis(rest, order[:, :names - size], 0.0, axis=1)
        rest = texts.fit(rest / rest.sum(axis=1, keepdims=True))
        new = texts.log_likelihood(rest)
        lower = new + cost >= fit[at]
        if not lower.any():
            break
        share[at[lower]], fit[at[lower]] = rest[lower], new[lower]
        if not lower.all():
            texts, at, cost = texts.part(lower), at[lower], cost[lower]
    return share


RESULT = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def predict(model: LanguageModel, texts: list[str | None]) -> list[tuple]:
    """(language, its proportion, all languages of the set): und, 0 and none without a letter."""
    found: list[tuple] = [(UNKNOWN, 0.0, [])] * len(texts)
    if not model.languages:
        return found
    buckets, starts, counts = word_grams(texts)
    if not len(starts):
        return found
    with_words = np.flatnonzero(counts)
    shares = language_sets(word_likelihoods(model, buckets, starts), counts[with_words])
    for at, share in zip(with_words.tolist(), shares.tolist()):
        held = sorted((-s, k) for s, k in zip(share, model.languages) if s > 0)
        found[at] = (held[0][1], min(1.0, -held[0][0]), [{"lang": k, "share": -s} for s, k in held])
    return found


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``lang_pred, score, languages`` of every whole text.

    Only the text is looked at. NULL texts and those without a letter are ``und`` with score 0;
    equal texts get equal results; ties go to the name that sorts first. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def work(columns):
            for texts in portions(columns[0], PORTION):
                yield from predict(own, texts)

        return work

    return add_results(docs, ["text"], make, RESULT, keep)


def known_language(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The documents with a known language that holds at least ``least`` of their words."""
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def held_out(parts: int, rest: int) -> Column:
    """Rows by the checksum of their id's text; NULL ids have none and are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))
