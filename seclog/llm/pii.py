"""Personal data by a skip-chain conditional random field beside fixed patterns.

Fixed patterns give the base spans. Tokens with a digit or an @ are the nodes of a field: neighbours
in the text are linked in a chain, and repeated or similar tokens, however distant, by skip edges that
share potentials, so that loopy message passing gives them consistent labels. Potentials are
log ratios of counts over all documents, with the base spans as labels (piecewise training).
A token that the field is sure of, and that no base span holds, adds a span.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results, map_rows

# The kinds in their order and the patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = ("none", *KINDS)
N = len(LABELS)
BUCKETS = 1 << 13
CHAIN, SAME, ALIKE = range(3)
#: Marginal a token needs for a span, the share a new message gets, and the change below which one has settled.
SURE, DAMPING, SETTLED = 0.9, 0.6, 1e-4
#: Rounds after which new messages get a quarter of that share, and after which those that swing for ever stop.
SLOW_ROUNDS, MOST_ROUNDS = 200, 5000
#: Digits an added span of a kind must have.
DIGITS = {"card": (13, 19), "phone": (7, 15)}

_DIGIT = re.compile("[0-9]")
_SEED = re.compile(r"[0-9@]")
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+()@-")
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Around each @: all characters of the local part before it, the longest domain after it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of letters, digits and the signs of addresses and numbers that hold a digit or an @."""
    found, end, size = [], 0, len(text)
    m = _SEED.search(text)
    while m:
        start, stop = m.start(), m.end()
        while start > end and text[start - 1] in _PART:
            start -= 1
        while stop < size and text[stop] in _PART:
            stop += 1
        end = stop
        last = stop
        while last > start and text[last - 1] in ".-%+(":
            last -= 1
        found.append((start, last))
        m = _SEED.search(text, end)
    return found


def shape(token: str) -> str:
    return _RUNS.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0][0].isdigit() else "a", token)


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % BUCKETS


def _words_beside(text: str, start: int, stop: int) -> tuple[str, str]:
    before = text[max(0, start - 24):start].split()
    after = text[stop:stop + 24].split()
    return (before[-1].lower() if before else ""), (after[0].lower() if after else "")


@dataclass
class Graph:
    """Nodes and edges of one text; features are bucket numbers."""

    spans: list[tuple[int, int]]
    features: list[tuple[int, int, int, int]]
    edges: list[tuple[int, int, int]]  # node, node, type
    labels: list[int]  # by the base spans


def graph(text: str, base: list[tuple[str, int, int]]) -> Graph | None:
    spans = tokens(text)
    if not spans:
        return None
    features, edges, labels = [], [], [0] * len(spans)
    starts = [a for a, _ in spans]
    for kind, a, b in reversed(base):  # kinds listed first win
        n = max(bisect_left(starts, a) - 1, 0)
        while n < len(spans) and spans[n][0] < b:
            if min(b, spans[n][1]) - max(a, spans[n][0]) > (spans[n][1] - spans[n][0]) // 2:
                labels[n] = LABELS.index(kind)
            n += 1
    same: dict[str, int] = {}
    alike: dict[str, int] = {}
    for n, (a, b) in enumerate(spans):
        token = text[a:b]
        form = shape(token)
        digits = _NOT_DIGIT.sub("", token)
        before, after = _words_beside(text, a, b)
        features.append((_bucket("shape", form), _bucket("digits", str(min(len(digits), 30))),
                         _bucket("before", shape(before)), _bucket("after", shape(after))))
        if n and a - spans[n - 1][1] <= 2 and "\n" not in text[spans[n - 1][1]:a]:
            edges.append((n - 1, n, CHAIN))
        # the first equal token, so that any two mentions are two links apart, or else the last alike
        # one, at any distance: as many edges as tokens
        key = digits[-7:] if len(digits) >= 7 else token.lower()
        if key in same:
            edges.append((same[key], n, SAME))
        elif form in alike:
            edges.append((alike[form], n, ALIKE))
        same.setdefault(key, n)
        alike[form] = n
    return Graph(spans, features, edges, labels)


#: Counted: features by label, labels, pairs of labels by type of edge, all in one vector.
LABEL_AT = BUCKETS * N
PAIR_AT = LABEL_AT + N
COUNTED = PAIR_AT + 3 * N * N


def counts(docs: DataFrame) -> DataFrame:
    """``at, n``: counts over all documents; each task sends at most one number per place."""
    def make():
        total = np.zeros(COUNTED, np.int64)

        def work(columns):
            for text in columns[0]:
                g = graph(text, base_spans(text)) if text else None
                if g is None:
                    continue
                y = np.array(g.labels)
                np.add.at(total, np.array(g.features) * N + y[:, None], 1)
                np.add.at(total, LABEL_AT + y, 1)
                if g.edges:
                    e = np.array(g.edges)
                    np.add.at(total, PAIR_AT + (e[:, 2] * N + y[e[:, 0]]) * N + y[e[:, 1]], 1)
            return ()

        def finish():
            found = np.flatnonzero(total)
            return zip(found.tolist(), total[found].tolist())

        return work, finish

    return map_rows(docs.select("text"), make, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Field:
    """Log potentials: of features and of pairs, by type of edge."""

    features: np.ndarray
    prior: np.ndarray
    pairs: np.ndarray


def train(docs: DataFrame) -> Field:
    """A field from all documents; without a token it knows nothing and adds no span."""
    total = np.zeros(COUNTED)
    for at, n in counts(docs).collect():  # COUNTED numbers at most
        total[at] = n
    return field_of(total)


def field_of(total: np.ndarray) -> Field:
    by_feature = total[:LABEL_AT].reshape(BUCKETS, N)
    labels = total[LABEL_AT:PAIR_AT]
    pairs = total[PAIR_AT:].reshape(3, N, N)
    prior = np.log((labels + 1) / (labels.sum() + N))
    # how much likelier a label is where the feature is seen; nothing for features never seen
    seen = by_feature.sum(axis=1, keepdims=True)
    features = np.log((by_feature + 2 * np.exp(prior)) / (seen + 2)) - prior
    pairs = pairs + pairs.transpose(0, 2, 1) * np.array([0, 1, 1])[:, None, None]
    joint = pairs + 4 * np.exp(prior[:, None] + prior[None, :])
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    ratio = np.log(joint) - np.log(joint.sum(axis=2, keepdims=True)) - np.log(joint.sum(axis=1, keepdims=True))
    return Field(features, prior, np.clip(ratio, -6, 6))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(field: Field, unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Label probabilities of all nodes by damped loopy message passing, until messages settle.

    A message is renewed while it or the belief it was made from still moves, so a text that has settled
    waits for no other and gets the same result alone as among others.
    """
    belief = unary.copy()
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        table = np.concatenate([field.pairs[edges[:, 2]], field.pairs[edges[:, 2]].transpose(0, 2, 1)])
        message, used = np.zeros((len(source), N)), np.zeros((len(source), N))
        due = np.arange(len(source))
        for n in range(MOST_ROUNDS):
            used[due] = belief[source[due]]
            new = _log_sum((used[due] - message[back[due]])[:, :, None] + table[due], 1)
            new -= new.max(axis=1, keepdims=True)
            step = (DAMPING if n < SLOW_ROUNDS else DAMPING / 4) * (new - message[due])
            message[due] += step
            np.add.at(belief, target[due], step)
            moves = np.abs(belief[source] - used).max(axis=1) >= SETTLED
            moves[due] |= np.abs(step).max(axis=1) >= SETTLED
            due = np.flatnonzero(moves)
            if not len(due):
                break
    belief = belief - belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def _plausible(kind: str, text: str) -> bool:
    if kind == "email":
        return "@" in text[1:-1]
    digits = _NOT_DIGIT.sub("", text)
    if kind == "ip":
        parts = _NOT_DIGIT.split(text.strip("."))
        return len(parts) == 4 and all(p and int(p[:4]) <= 255 for p in parts)
    least, most = DIGITS[kind]
    return least <= len(digits) <= most and (kind != "card" or luhn(digits))


def added_spans(text: str, g: Graph, p: np.ndarray, base) -> list[tuple[str, int, int]]:
    """Runs of neighbouring tokens with one sure label, if they look like their kind and are clear
    of base spans."""
    found = []
    best = p.argmax(axis=1)
    sure = (best > 0) & (p.max(axis=1) >= SURE)
    joined = {b for a, b, kind in g.edges if kind == CHAIN}
    n = 0
    while n < len(g.spans):
        first = n
        n += 1
        if not sure[first]:
            continue
        while n < len(g.spans) and n in joined and sure[n] and best[n] == best[first]:
            n += 1
        kind, a, b = LABELS[best[first]], g.spans[first][0], g.spans[n - 1][1]
        if _plausible(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
            found.append((kind, a, b))
    return found


def label_texts(field: Field, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text, by kind as listed, then start.

    The texts' graphs share no edge and pass their messages side by side.
    """
    bases = [base_spans(t) for t in texts]
    graphs = [graph(t, b) if t else None for t, b in zip(texts, bases)]
    found = [(b, b) for b in bases]
    held = [n for n, g in enumerate(graphs) if g]
    if not held:
        return found
    sizes = [len(graphs[n].spans) for n in held]
    first = np.cumsum([0, *sizes])
    features = np.concatenate([np.array(graphs[n].features) for n in held])
    unary = field.prior + field.features[features].sum(axis=1)
    edges = [np.array(graphs[n].edges) + [at, at, 0] for n, at in zip(held, first) if graphs[n].edges]
    p = marginals(field, unary, np.concatenate(edges) if edges else np.empty((0, 3), int))
    for n, a, b in zip(held, first, first[1:]):
        more = added_spans(texts[n], graphs[n], p[a:b], bases[n])
        if more:
            found[n] = bases[n], sorted(bases[n] + more, key=lambda s: (KINDS.index(s[0]), s[1]))
    return found


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), ``base`` and ``spans``: kind, start, end in code points.

    NULL and empty texts have none; repeated rows and NULL ids are documents like others. Only
    the text is looked at, to its end. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def named(spans):
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def make():
        own = sent.value

        def work(columns):
            for base, spans in label_texts(own, columns[0]):
                yield named(base), named(spans)

        return work

    return add_results(docs, ["text"], make, f"base {SPANS}, spans {SPANS}", keep)


def masked(text: str | None, spans) -> str | None:
    """The text with a mark in the place of every span; overlapping ones become one."""
    if not text or not spans:
        return text
    parts, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= end:
            parts += [text[end:s["start"]], f"[{s['kind'].upper()}]"]
        end = max(end, s["end"])
    return "".join([*parts, text[end:]])
