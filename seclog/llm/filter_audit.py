"""How filters interact: a count-weighted decision diagram of failure masks per part, in every order.

A document's failures are a mask with one bit per filter. Spark counts the masks of a part; a part is
then at most 2^filters counts. Their diagram has one level per filter, and equal sub-diagrams are one
node. Two neighbouring levels are swapped in place, so one swap leads from an order of the filters to the
next, and the path on which every filter passes gives what each step keeps and removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from seclog.functions.text import evaluated_once
from seclog.llm.common import digest128, schema_of
from seclog.session import materialize, ship_code

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SIGNS = "[#$%&*|]"
SPACES = r"[\x09-\x0D ]+"
#: n! orders come out, so the number of filters is bounded.
MOST_FILTERS = 8

AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")
_EMPTY = 0


class Diagram:
    """Decision diagram over masks with weights (tuples that add up) at its ends.

    Level k asks the filter ``order[k]``. Node 0 is the diagram without documents, at any level.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], filters: str):
        self.order = list(filters)
        width = len(next(iter(weights.values())))
        self.weight: list[tuple[int, ...]] = [(0,) * width]
        self.passing, self.failing = [_EMPTY], [_EMPTY]
        ends: dict[tuple, int] = {}
        below = {m: self._end(w, ends) for m, w in weights.items() if any(w)}
        self.levels: list[list[int]] = []
        for k in reversed(range(len(filters))):  # masks lose the bits of the levels already made
            bit, known = 1 << k, {}
            below = {
                m: self._node(below.get(m, _EMPTY), below.get(m | bit, _EMPTY), known)
                for m in {m & ~bit for m in below}
            }
            self.levels.insert(0, list(known.values()))
        self.root = below.get(0, _EMPTY)

    def _add(self, weight: tuple[int, ...], passing: int, failing: int) -> int:
        self.weight.append(weight)
        self.passing.append(passing)
        self.failing.append(failing)
        return len(self.weight) - 1

    def _end(self, weight: tuple[int, ...], known: dict[tuple, int]) -> int:
        if weight not in known:
            known[weight] = self._add(weight, _EMPTY, _EMPTY)
        return known[weight]

    def _node(self, passing: int, failing: int, known: dict[tuple, int]) -> int:
        if passing == failing == _EMPTY:
            return _EMPTY
        if (passing, failing) not in known:
            both = tuple(map(sum, zip(self.weight[passing], self.weight[failing])))
            known[passing, failing] = self._add(both, passing, failing)
        return known[passing, failing]

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1; nodes of level k keep their names, so those above stay as they are."""
        known: dict[tuple, int] = {}
        for node in self.levels[k]:
            p, f = self.passing[node], self.failing[node]
            self.passing[node], self.failing[node] = (
                self._node(self.passing[p], self.passing[f], known),
                self._node(self.failing[p], self.failing[f], known),
            )
        self.levels[k + 1] = list(known.values())
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def all_pass_path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """Per level: its filter, the weight that passes, and the weight that it removes."""
        node = self.root
        for name in self.order:
            yield name, self.weight[self.passing[node]], self.weight[self.failing[node]]
            node = self.passing[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places k of swaps (k, k + 1) that lead through all n! orders, each once, by plain changes."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the last item stands first or last
        down = not down


def orders_of(weights: dict[int, tuple[int, int, int]], filters: str) -> Iterator[tuple]:
    """Rows of the audit, without the part, of one part's (documents, good, toxic) by failure mask."""
    diagram, paths = Diagram(weights, filters), []
    paths.append(list(diagram.all_pass_path()))
    for k in adjacent_swaps(len(filters)):
        diagram.swap(k)
        paths.append(list(diagram.all_pass_path()))
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for path in paths:
        fails[path[0][0]], alone[path[-1][0]] = path[0][2][0], path[-1][2][0]  # asked first and asked last
        for name, _, removed in path:
            shapley[name] += removed[0]
    for path in paths:
        order = "".join(name for name, _, _ in path)
        for step, (name, kept, (n, good, toxic)) in enumerate(path, 1):
            yield order, step, kept[0], n, fails[name] - n, alone[name], good, toxic, shapley[name]


def text_failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, d1, d2, mask``: the failures A to D of every document and the digests of its text.

    NULL texts are empty ones; a NULL part is the empty string.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d1, d2 = digest128(text)
    n, kinds = F.col("n_words"), F.col("n_kinds")
    pieces = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        d1.alias("d1"), d2.alias("d2"), F.length(text).alias("chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("capitals"),
        text.rlike(SIGNS).alias("signs"), evaluated_once(F.split(text, SPACES)).alias("words"),
    ).select(
        "*", F.size(F.array_remove("words", "")).alias("n_words"),
        F.size(F.array_remove(F.array_distinct("words"), "")).alias("n_kinds"),
    )
    failed = [
        n < LEAST_WORDS, 100 * kinds.cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * F.col("capitals").cast("long") > MOST_CAPITALS * F.col("chars").cast("long"), F.col("signs"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    return pieces.select("doc_id", "part", "d1", "d2", mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by failure mask, those labelled good and those labelled toxic.

    A document fails E (bit 16) if its text is that of a document with a smaller id; NULL ids are neither
    smaller nor larger than others. Repeated rows are documents of their own. Of several labels of an id each
    counts as one. Texts never move: rows of ids and digests meet their labels, and equal texts are counted
    before they meet, so that a text in a third of all rows is a few rows per task.
    """
    rows = text_failures(docs, part).groupBy("doc_id", "part", "d1", "d2", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id match nothing; they are dealt out by their text.
    rows = rows.withColumn("apart", F.when(F.col("doc_id").isNull(), F.pmod("d1", F.lit(1 << 20))).otherwise(0))
    # Kept once, so that the join's sides come straight from an exchange and a hot id can be split.
    marks = materialize(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("toxic"),
    )).withColumn("zero", F.lit(0).cast("long"))
    same = (F.col("doc_id") == F.col("id")) & (F.col("apart") == F.col("zero"))
    judged = rows.join(marks, same, "left").select(
        "doc_id", "part", "d1", "d2", "mask", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    # of each text, part and label: its least id with the rows that have it (NULL ids apart), and all rows
    kinds = ["d1", "d2", "part", "mask", "good", "toxic"]
    unnamed = F.col("doc_id").isNull()
    by_id = judged.groupBy(*kinds, "doc_id").agg(F.sum("n").alias("n"))
    by_text = by_id.groupBy(*kinds).agg(
        F.min(F.when(~unnamed, F.struct("doc_id", "n"))).alias("first"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(unnamed, F.col("n"))), F.lit(0)).alias("n_unnamed"),
    )
    # which of them holds the least id of the text: at most four rows a part
    entry = F.struct("part", "mask", "good", "toxic", "n", "n_unnamed", F.col("first.n").alias("n_first"),
                     F.col("first.doc_id").alias("id"))
    texts = by_text.groupBy("d1", "d2").agg(F.min("first.doc_id").alias("least"), F.collect_list(entry).alias("entries"))
    entries = texts.select("least", F.inline("entries"))
    passing = F.col("n_unnamed") + F.when(F.col("id") == F.col("least"), F.col("n_first")).otherwise(0)
    both = entries.select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", passing.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")),
    )))
    return both.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    )


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row per part, order of the filters and step. ``masks`` has ``part, mask, n, good, toxic``, one row
    per part and mask; bit k stands for ``filters[k]``. Parts without rows have none; no rows give none.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of their own: {filters!r}")
    fields = to_arrow_schema(schema_of(AUDIT))
    ship_code(masks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(*[c.to_pylist() for c in batch.columns]):  # one part is held at a time
                weights = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}
                columns = zip(*[(part, *row) for row in orders_of(weights, filters)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(columns, fields)], schema=fields)

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(run, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five standard filters over whole texts."""
    return audit(mask_counts(docs, labels, part))
