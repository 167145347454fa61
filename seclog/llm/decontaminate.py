"""Benchmark decontamination: a broadcast set of benchmark word windows met by every document."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results, rows_again, schema_of
from seclog.session import materialize

WINDOW = 13
#: Benchmark characters that are broadcast at a time; more are met in several passes.
BLOCK_CHARS = 4_000_000

#: The same words in a text as it is, with its capitals.
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Lower case for A-Z, and a space for every ASCII character that is no digit or letter.
_PLAIN = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and any non-ASCII characters, A-Z in lower case, as UTF-8."""
    return text.encode().translate(_PLAIN).split() if text else []


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    count = len(ids) - size + 1
    found = np.zeros(max(count, 0), np.uint64)
    for j in range(size if count > 0 else 0):
        found = found * _MIX + ids[j:j + count].astype(np.uint64)
    return found


class WindowIndex:
    """Windows of benchmark items by length: sorted hashes, the word ids of each, its items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.words: dict[bytes, int] = {}
        held: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in plain_words(text)]
            length = min(size, len(ids))
            for start in range(len(ids) - length + 1 if length else 0):
                held[length][tuple(ids[start:start + length])].add(name)
        self.lengths = {}
        for length, windows in held.items():
            rows = np.array(list(windows), np.int64).reshape(-1, length)
            hashes = np.array([window_hashes(r, length)[0] for r in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            names = list(windows.values())
            self.lengths[length] = hashes[order], rows[order], [sorted(names[i]) for i in order]

    def hits(self, words: list[bytes]):
        """(start, length, items) of every occurrence; equal hashes are compared word by word."""
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        if not ids.any():
            return
        for length, (hashes, rows, names) in self.lengths.items():
            found = window_hashes(ids, length)
            low = np.searchsorted(hashes, found, "left")
            near = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == found)
            for start in near.tolist():
                at, own = int(low[start]), ids[start:start + length]
                while at < len(hashes) and hashes[at] == found[start]:
                    if (rows[at] == own).all():
                        yield start, length, names[at]
                    at += 1


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[str, str]]]:
    """The items in blocks of a bounded size, brought to the driver block by block."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text",
    ).where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    count = max(1, -(-2 * total // block_chars) if total > block_chars else 1)
    kept = items if count == 1 else materialize(items)
    at = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for n in range(count):
        yield [tuple(r) for r in kept.where(at == n).toLocalIterator()]


def _merged(starts, lengths) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for start, length in sorted(zip(starts, lengths)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + length)
        else:
            runs.append([start, start + length])
    return [tuple(r) for r in runs]


def _result(text: str | None, n_words: int, runs, items, share: int) -> tuple:
    spans, n_hit = [], sum(b - a for a, b in runs)
    if runs:
        places = [m.span() for m in _SPAN.finditer(text)]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
    return n_words, n_hit, items, spans, n_hit > 0 and share * n_hit >= n_words


def _pass(given: DataFrame, keep, items, size: int, share: int, last: bool) -> DataFrame:
    """One look of every document at one block of the benchmark."""
    sent = given.sparkSession.sparkContext.broadcast(WindowIndex(items, size))

    def make():
        index = sent.value

        def work(columns):
            texts = columns[0]
            before = zip(*columns[1:]) if columns[1:] else (([], [], []) for _ in texts)
            for text, (starts, lengths, names) in zip(texts, before):
                words, names = plain_words(text), set(names)
                found = list(index.hits(words))
                starts = starts + [s for s, _, _ in found]
                lengths = lengths + [n for _, n, _ in found]
                names.update(*[x for _, _, x in found])
                if last:
                    yield _result(text, len(words), _merged(starts, lengths), sorted(names), share)
                else:
                    yield starts, lengths, sorted(names)

        return work

    ddl = RESULT if last else "starts array<int>, lengths array<int>, items array<string>"
    if "row" not in given.columns or "starts" not in given.columns:
        return add_results(given, ["text"], make, ddl, keep)
    # a further pass: the row with its text, and what the passes before have found
    return add_results(
        given, [F.col("row.text"), "starts", "lengths", "items"], make, ddl, ["row"],
    ).select("row.*", *[f.name for f in schema_of(ddl)])


RESULT = ("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, "
          "contaminated boolean")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20,
    block_chars: int = BLOCK_CHARS, keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the ``keep`` columns, all by default) and ``n_words, n_hit, items, spans, contaminated``.

    ``items`` are the ids, as text, of items with a window in the document; ``spans`` the places
    [start, end) in code points of the runs of hit words. A document is contaminated when it
    has a hit and ``share`` times its hits are at least its words. An item with fewer words than a
    window is one window; items and documents that are NULL, empty or without words have none.
    Items without id are listed as "null", repeated items once. One row per input row, no shuffle.
    A benchmark above ``block_chars`` is met in several passes, each with a bounded block.
    """
    blocks = _blocks(benchmark, block_chars)
    at, items = docs, next(blocks)
    for following in blocks:
        at = materialize(_pass(at, None, items, size, share, last=False))
        items = following
    out = _pass(at, keep, items, size, share, last=True)
    if keep is None or at is docs:
        return out
    return out.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in keep]))


def cut_spans(text: str, spans) -> str:
    """The text without the spans; a space stands for each."""
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return " ".join([*parts, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options,
) -> DataFrame:
    """The documents without contaminated ones, or (``remove="spans"``) without their hit words.

    Columns and their order stay. Documents with hits below the share are kept as they are.
    """
    found = contamination(docs, benchmark, **options)
    if remove == "documents":
        return rows_again(found.where(~F.col("contaminated")))
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    cut = F.udf(cut_spans)(F.col("row.text"), F.col("spans"))
    text = F.when(F.col("contaminated"), cut).otherwise(F.col("row.text"))
    return rows_again(found.withColumn("row", F.col("row").withField("text", text)))
