"""Text measures, keyword classes and captures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclog import fixed_values as fv


def char_entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters; 0.0 for missing or blank text.

    For counts c of n characters this is log2(n) - sum(c * log2(c)) / n. Sorting the
    characters brings equal ones together, and only runs of two or more add to the sum.
    """
    length = F.length(text)
    blank = text.rlike(r"(?U)^[\s\x1c-\x1f]*$")
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))
    weighted = F.aggregate(
        runs, F.lit(0.0), lambda total, run: total + F.length(run) * F.log2(F.length(run))
    )
    return F.when(text.isNull() | blank, F.lit(0.0)).otherwise(
        F.log2(length) - weighted / length
    )


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def all_of(text: Column, words: list[str]) -> Column:
    return reduce(and_, [text.contains(w) for w in words])


def first_class(text: Column, rules: list[tuple[str, list[str]]], default: str,
                test=any_of) -> Column:
    """Class of the first rule whose words occur in the text."""
    if not rules:
        return F.lit(default)
    chain = F
    for name, words in rules:
        chain = chain.when(test(text, words), name)
    return chain.otherwise(default)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def known(value: Column) -> Column:
    """NULL for empty text."""
    return F.nullif(value, F.lit(""))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group, NULL where the pattern does not match or captures nothing."""
    return bound(F.regexp_extract(text, pattern, group), known)


def captures(text: Column, pattern: str, groups: list[int]) -> Column:
    """Several groups from the first match, as an array (group 0: empty text); NULL where
    the pattern does not match.

    Groups are told apart by a control character. A text that holds it, as no honest line does, is
    matched once per group instead, so a text cannot forge a group.
    """
    mark = "\x01"
    wanted = "".join(mark + (f"${g}" if g else "") for g in groups)
    around = pattern if pattern.startswith("^") else rf"(?s:^.*?){pattern}(?s:.*)$"
    marked = F.regexp_replace(text, around, wanted)
    pieces = lambda m: F.split(F.substring(m, 2, 1 << 30), mark, len(groups))
    apart = F.array(*[F.regexp_extract(text, pattern, g) if g else F.lit("") for g in groups])
    return F.when(text.contains(mark), F.when(text.rlike(pattern), apart)).otherwise(
        bound(marked, lambda m: F.when(m != text, pieces(m))))


def evaluated_once(value: Column) -> Column:
    """A generator that gives the value as it is.

    Filters on parts of the value stay above a generator, where on a projection they would
    be pushed below it and the value be worked out again.
    """
    return F.explode(F.array(value))


def attack_type_in(lowered: Column) -> Column:
    """Attack type a free-text finding, in lower case, talks about; NULL when it reports
    none."""
    named = first_class(lowered, fv.ATTACK_TEXT_RULES, fv.ATTACK_TEXT_DEFAULT)
    return F.when((F.length(lowered) > 0) & ~lowered.contains(fv.NO_ATTACK_TEXT), named)


def is_dangerous_command(command: Column) -> Column:
    return command.rlike("(?i)" + "|".join(f"(?:{p})" for p in fv.DANGEROUS_COMMANDS))


def shown(value: Column) -> Column:
    """Text of a value as it stands in a sentence."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def reasons(*named: tuple[Column, Column]) -> Column:
    """Comma list of the texts whose condition holds."""
    return F.concat_ws(", ", *[F.when(condition, text) for condition, text in named])
