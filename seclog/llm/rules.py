"""Quality rules: every rule once per document into failure bits and measurements; policies are masks.

A policy is a named, versioned set of rules. Verdicts and ablations are bitwise operations on
the ledger, without another look at a text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES, _SPACES = SYMBOLS.encode(), b" \t\n\v\f\r"
_CAPITAL_BYTES = bytes(range(65, 91))


@dataclass(frozen=True)
class Rule:
    """Fails where ``measure`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The place of a rule is its bit for ever: new rules go to the end.
RULES = (
    Rule("too_few_words", "n_words", least=50),
    Rule("repeated_words", "repeat_share", most=0.5),
    Rule("symbols_per_word", "symbol_share", most=0.2),
    Rule("duplicate_lines", "dup_line_share", most=0.5),
    Rule("capitals", "capital_share", most=0.5),
    Rule("word_length_low", "mean_word_chars", least=1.5),
    Rule("word_length_high", "mean_word_chars", most=25),
    Rule("longest_word", "longest_word", most=1000),
    Rule("digits", "digit_share", most=0.5),
    Rule("one_word", "distinct_share", least=0.02),
)
BIT = {rule.name: 1 << n for n, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in dict.fromkeys(names))


#: Versioned policies: a document is kept when none of the policy's bits is set.
POLICIES = {
    "base-1": mask("too_few_words", "repeated_words"),
    "standard-1": mask(*BIT),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("repeat_share", "symbol_share", "dup_line_share", "capital_share", "mean_word_chars",
          "longest_word", "digit_share", "distinct_share")
LEDGER = ", ".join([*[f"{c} long" for c in COUNTS], *[f"{c} double" for c in SHARES],
                    "failed_bits long", "rules_version int"])
RULES_VERSION = 1


def _repeat_words(ids: np.ndarray) -> int:
    """Words in three-word windows that stand in the text twice or more."""
    if len(ids) < 4:
        return 0
    kinds = np.uint64(int(ids.max()) + 1)
    u = ids.astype(np.uint64)
    if int(kinds) ** 3 < 2**63:
        windows = (u[:-2] * kinds + u[1:-1]) * kinds + u[2:]
    else:  # number the pairs first, so that keys stay exact
        _, pairs = np.unique(u[:-1] * kinds + u[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.uint64) * kinds + u[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows) + 1, bool)
    twice[:-2] = same
    twice[1:-1] |= same
    hit = np.zeros(len(ids), bool)
    starts = order[twice[:-1]]
    for j in range(3):
        hit[starts + j] = True
    return int(hit.sum())


def measure(text: str | None) -> dict[str, float]:
    """Everything the rules look at, in one pass over a text; NULL and empty texts have no words."""
    text = text or ""
    data = text.encode()
    words = data.split()  # on space and \\t to \\r only
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.array([number(w, len(seen)) for w in words], np.int64)
    n = len(words)
    packed = data.translate(None, _SPACES)
    word_chars = n_chars(packed)
    symbols = len(data) - len(data.translate(None, _SYMBOL_BYTES))
    capitals = len(data) - len(data.translate(None, _CAPITAL_BYTES))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = _repeat_words(ids)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
        "repeat_share": repeated / n if n else 0.0, "symbol_share": symbols / n if n else 0.0,
        "dup_line_share": dup_lines / len(lines) if lines else 0.0,
        "capital_share": capitals / word_chars if n else 0.0,
        "mean_word_chars": word_chars / n if n else 0.0,
        "longest_word": float(max(map(len, seen), default=0)),
        "digit_share": digits / word_chars if n else 0.0,
        "distinct_share": len(seen) / n if n else 0.0,
    }


def n_chars(data: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but those that continue one."""
    return len(data) if data.isascii() else len(data.decode())


def failed_bits(measured: dict[str, float], rules: Iterable[Rule] = RULES) -> int:
    bits = 0
    for n, rule in enumerate(rules):
        value = measured[rule.measure]
        if (rule.least is not None and value < rule.least) or (rule.most is not None and value > rule.most):
            bits |= 1 << n
    return bits


def rule_ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns), counts, measurements, ``failed_bits`` and ``rules_version``.

    One row per input row, repeated rows and NULL ids included; NULL and empty texts have
    counts of 0 and fail the rules with a least value. No shuffle.
    """
    def make():
        def work(columns):
            for text in columns[0]:
                m = measure(text)
                yield *m.values(), failed_bits(m), RULES_VERSION

        return work

    return add_results(docs, ["text"], make, LEDGER, keep)


def fails(policy: str) -> Column:
    """Whether a ledger row breaks a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` and the policy's name."""
    return ledger.withColumns({"kept": ~fails(policy), "policy": F.lit(policy)})


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: ``rule, n_failed, n_only`` and ``n_kept_without`` that rule.

    One aggregation of the ledger, whatever the number of rules. An empty ledger gives zeros.
    """
    chosen = POLICIES[policy]
    used = [(r.name, BIT[r.name]) for r in RULES if BIT[r.name] & chosen]
    bits = F.col("failed_bits").bitwiseAND(F.lit(chosen))
    counts = ledger.agg(*[
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            F.count_if(bits == bit).alias("n_only"),
            F.count_if(bits.bitwiseAND(F.lit(chosen & ~bit)) == 0).alias("n_kept_without"),
        ).alias(f"r{n}") for n, (name, bit) in enumerate(used)
    ])
    return counts.select(F.inline(F.array(*[F.col(c) for c in counts.columns])))
