"""Near-duplicates by ProbMinHash: weighted word shingles, exponential arrivals, banding, verification.

Every distinct shingle of a text sends points of a Poisson process, whose rate is its weight, to
random components; the earliest point in a component names its hash. Shingles stop once their next
point is later than all that is held. Two texts agree in a component with their probability
Jaccard similarity. Texts that agree in a whole band are compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seclog.llm.common import add_results, digest128, map_rows, portions, rows_again, whole_row
from seclog.llm.decontaminate import plain_words
from seclog.session import materialize

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares none of the bands with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, BAND_ROWS = 32, 5
KNOWN_WORDS = 400_000
#: Rows of a bucket that meet in one task; a larger bucket is cut into blocks, and all pairs of
#: its blocks meet.
BLOCK_ROWS = 1024
#: Shingles that count as one row there: a longer text counts for more, so a block is bounded in bytes.
ROW_SHINGLES = 4096
#: Characters of texts that are hashed side by side.
PORTION = 1 << 22
#: Standard deviations below the wanted similarity at which a sketch rules a pair out.
DEVIATIONS = 4.0

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASH_OF = WordHashes()  # a worker's, over its tasks


def shingles(text: str | None, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive words, sorted, and their weights 1 + log2(count).

    A text with fewer words is one shingle; one without words has none.
    """
    words = plain_words(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0)
    ids = np.array(list(map(_HASH_OF.__getitem__, words)), np.uint64)
    width = min(size, len(ids))
    found = np.full(len(ids) - width + 1, width, np.uint64)
    for j in range(width):
        found = mixed(found * _GOLD + ids[j:j + len(found)])
    kinds, counts = np.unique(found, return_counts=True)
    return kinds, 1 + np.log2(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """A row of ``size`` shingle hashes for every (hashes, weights), none of them empty."""
    counts = np.array([len(h) for h, _ in sets])
    owner = np.repeat(np.arange(len(sets)), counts)
    element = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    time = np.zeros(len(element))
    earliest = np.full(len(sets) * size, np.inf)
    held = np.zeros(len(sets) * size, np.uint64)
    point = 0
    while len(element):
        point += 1
        draw = mixed(element + _GOLD * np.arange(point, point + 1, dtype=np.uint64))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        slot = owner * size + (mixed(draw ^ _M2) % np.uint64(size)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        first = time == earliest[slot]
        held[slot[first]] = element[first]
        latest = earliest.reshape(-1, size).max(axis=1)
        going = time < latest[owner]  # later points can change nothing
        element, rate, time, owner = element[going], rate[going], time[going], owner[going]
    return held.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band and text."""
    grouped = signature.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2])
    for r in range(rows):
        key = mixed(key * _GOLD + grouped[:, :, r])
    return key.astype(np.int64)


def probability_jaccard(a, b) -> float:
    """Exact similarity of two (sorted hashes, weights): over shared shingles, the sum of
    1 / sum over all of max(weight ratio in a, weight ratio in b)."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = np.zeros(len(a[0]) + len(b[0]) - len(both)), np.zeros(len(a[0]) + len(b[0]) - len(both))
    rest_a, rest_b = np.delete(a[1], at), np.delete(b[1], bt)
    n = len(both)
    x[:n], y[:n] = a[1][at], b[1][bt]
    x[n:n + len(rest_a)] = rest_a
    y[n + len(rest_a):] = rest_b
    # max(x_k / x_i, y_k / y_i) = x_k / x_i where x_k / y_k >= x_i / y_i, else y_k / y_i
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(-ratio, kind="stable")
    sum_x, sum_y = np.cumsum(x[order]), np.cumsum(y[order])
    own = ratio[:n]
    upto = np.searchsorted(-ratio[order], -own, "right") - 1
    total = sum_x[upto] / x[:n] + (sum_y[-1] - sum_y[upto]) / y[:n]
    return float((1 / total).sum())


FEATURES = "node binary, bands array<long>, sketch binary, weight int"


def features(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, d1, d2`` (the digests of the text), ``node`` (a name of its shingles and weights),
    band keys, 8 bits of every component, and how many rows of a block the text counts for. Texts
    without words have none of the last four.
    """
    d1, d2 = digest128(F.col("text"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d1.alias("d1"), d2.alias("d2"), "text")

    def make():
        def of_texts(texts):
            sets = [shingles(t) for t in texts]
            full = [x for x in sets if len(x[0])]
            if full:
                signature = signatures(full, bands * rows)
                keys = iter(band_keys(signature, bands, rows).tolist())
                sketches = iter((signature >> np.uint64(56)).astype("u1"))
            for kinds, weights in sets:
                if len(kinds):
                    name = blake2b(kinds.tobytes() + weights.tobytes(), digest_size=16).digest()
                    yield name, next(keys), next(sketches).tobytes(), -(-len(kinds) // ROW_SHINGLES)
                else:
                    yield None, None, None, None

        def work(columns):
            for texts in portions(columns[0], PORTION):
                yield from of_texts(texts)

        return work

    found = add_results(named, ["text"], make, FEATURES, ["doc_id", "d1", "d2"])
    return found.select("row.*", "node", "bands", "sketch", "weight")


def in_groups(columns: list[list], width: int, held: list) -> Iterator[list[tuple]]:
    """Whole groups of rows, equal in the first ``width`` columns and sorted by them; the last
    group stays in ``held``."""
    held.extend(zip(*columns))
    groups = [list(g) for _, g in itertools.groupby(held, key=lambda r: r[:width])]
    held[:] = groups.pop() if groups else []
    yield from groups


def _likely(sketches: np.ndarray, keys: np.ndarray, at: int, least: float, band: int) -> np.ndarray:
    """Rows after ``at`` that may be similar and whose first band in common with it is ``band``.

    Bands are compared by (half of) the keys that dealt them out, so a pair is looked at where it met first.
    """
    near = np.flatnonzero((sketches[at + 1:] == sketches[at]).mean(axis=1) >= least) + at + 1
    return near[(keys[near] == keys[at]).argmax(axis=1) == band]


class Sets:
    """Disjoint sets of row numbers; the root is the first row."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)


def _by_group(df: DataFrame, keys: list[str], of_group, ddl: str) -> DataFrame:
    """Each group, of a bounded size, through a function; groups stream by in sorted order."""
    def make():
        held: list = []

        def work(columns):
            for group in in_groups(columns, len(keys), held):
                yield from of_group(group)

        def finish():
            if held:
                yield from of_group(held)

        return work, finish

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, "node")
    return map_rows(dealt, make, ddl)


def shingle_blob(text: str | None) -> bytes:
    """Number of shingles, their upper 32 bits in order, and their weights."""
    kinds, weights = shingles(text)
    short, first = np.unique((kinds >> np.uint64(32)).astype("<u4"), return_index=True)
    weights = np.add.reduceat(weights, first) if len(first) else weights
    return short.tobytes() + weights.astype("<f4").tobytes()


def of_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8
    return np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<f4", n, 4 * n).astype(float)


def similar_links(
    docs: DataFrame, known: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS,
    rows: int = BAND_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``node, other``: links that connect all texts with a verified similarity.

    Nodes that share a band meet in a bucket, in blocks of a bounded number of shingles. Sketches name the
    rows with a possible partner; only those get their shingles, and pairs not yet connected
    are compared exactly. What is given are links to the first of each connected set.
    """
    size = bands * rows
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / size) ** 0.5
    nodes = known.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("weight").alias("weight"),
        F.min(F.struct("doc_id", "d1", "d2")).alias("text_key"),
    )
    nodes = materialize(nodes)
    member = nodes.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    crowded = member.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weights")).where("n > 1")
    blocks = F.least(F.ceil(F.col("weights") / block_rows), "n").cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = member.drop("weight").join(crowded, ["band", "key"]).withColumn("blocks", blocks).select(
        "band", "key", "node", own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node")
    keys = ["band", "key", "lo", "hi"]
    # half of each key, 32 bits, is enough to tell a common band here
    halves = F.transform("bands", lambda k: (F.shiftrightunsigned(k, 32) - (1 << 31)).cast("int"))
    meeting = placed.join(nodes.select("node", "sketch", halves.alias("halves")), "node").select(
        *keys, "node", "sketch", "halves")

    def matrix(group):
        sketches = np.frombuffer(b"".join(r[5] for r in group), "u1").reshape(len(group), -1)
        return sketches, np.array([r[6] for r in group], np.int32)

    def possible(group):
        (sketches, band_of), found = matrix(group), set()
        for at in range(len(group) - 1):
            partners = _likely(sketches, band_of, at, least, group[0][0])
            if len(partners):
                found.update([at, *partners.tolist()])
        for at in sorted(found):
            yield group[at]

    ddl = "band int, key long, lo int, hi int, node binary, sketch binary, halves array<int>"
    flagged = materialize(_by_group(meeting, keys, possible, ddl))

    # the texts of the flagged nodes only
    wanted = nodes.join(flagged.select("node").distinct(), "node", "left_semi").select("node", "text_key.*")
    d1, d2 = digest128(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d1.alias("e1"), d2.alias("e2"), "text")
    same = (wanted["doc_id"].eqNullSafe(texts["doc_id"]) & (F.col("d1") == F.col("e1"))
            & (F.col("d2") == F.col("e2")))
    with_text = texts.join(wanted, same).select("node", "text")

    def make_blobs():
        def work(columns):
            for node, text in zip(*columns):
                yield node, shingle_blob(text)

        return work

    blobs = map_rows(with_text, make_blobs, "node binary, shingles binary").dropDuplicates(["node"])

    def verified(group):
        (sketches, band_of), sets = matrix(group), Sets(len(group))
        read = [of_blob(r[7]) for r in group]
        for at in range(len(group) - 1):
            for partner in _likely(sketches, band_of, at, least, group[0][0]).tolist():
                if sets.root(at) != sets.root(partner) and (
                    probability_jaccard(read[at], read[partner]) >= similarity
                ):
                    sets.join(at, partner)
        for at, row in enumerate(group):
            if sets.root(at) != at:
                yield row[4], group[sets.root(at)][4]

    compared = flagged.join(blobs, "node").select(*keys, "node", "sketch", "halves", "shingles")
    return _by_group(compared, keys, verified, "node binary, other binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node each linked node is connected with.

    Stars alternate: every node sends its larger, then its smaller neighbours to the least
    one. Hot nodes are aggregated before the shuffle; each round is cut in the shared folder.
    """
    edges = materialize(links.where("node <> other").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("m").alias("other"))
        large = large.where("node <> other").distinct()
        # now every edge points from a larger node to a smaller one
        low = large.groupBy("node").agg(F.min("other").alias("m"))
        moved = large.join(low, "node")
        small = moved.where("other <> m").select(F.col("other").alias("node"), F.col("m").alias("other"))
        new = materialize(small.unionByName(low.select("node", F.col("m").alias("other"))).distinct())
        if new.join(edges, ["node", "other"], "left_anti").isEmpty() and edges.join(
                new, ["node", "other"], "left_anti").isEmpty():
            return new.select("node", F.col("other").alias("root"))
        edges = new


def near_duplicate_classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, d1, d2`` (digests of its text), ``class_key, class_id, class_size``.

    Documents are in one class when a chain of pairs, each at least ``similarity`` alike, joins them;
    texts with equal shingles are alike. ``class_id`` is the least doc_id in the class (NULL if all
    are), ``class_key`` a name of the class, ``class_size`` its documents. A text without words
    (NULL, empty, signs only) is alone: no class_key, its own id, size 1. Repeated rows are
    documents like others.
    """
    known = materialize(features(docs, bands, rows))
    roots = components(similar_links(docs, known, similarity, bands, rows, block_rows))
    # by node first, so that many equal texts are one row when classes are put together
    nodes = known.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"),
    ).join(roots, "node", "left").withColumn("class_key", F.coalesce("root", "node"))
    sizes = nodes.groupBy("class_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = materialize(nodes.select("node", "class_key").join(sizes, "class_key"))
    # both sides come straight from an exchange: adaptive execution can split a hot node
    return known.select("doc_id", "d1", "d2", "node").join(of_node, "node", "left").select(
        "doc_id", "d1", "d2", F.hex("class_key").alias("class_key"),
        F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the least (doc_id, digests); columns stay.

    Of rows equal in id and text one stays. Documents without words all stay.
    """
    classes = near_duplicate_classes(docs, **options).where(F.col("class_size") > 1)
    key = F.struct("doc_id", "d1", "d2")
    copies = materialize(classes.groupBy("class_key", "doc_id", "d1", "d2").agg(F.count(F.lit(1)).alias("n")))
    # kept apart, so that both sides of the join come straight from an exchange and a hot class can be split
    first = materialize(copies.groupBy("class_key").agg(F.min(key).alias("first")))
    judged = copies.join(first, "class_key").select(
        F.col("doc_id").alias("id"), "d1", "d2", (key == F.col("first")).alias("stays"), "n")
    e1, e2 = digest128(F.col("text"))
    given = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        e1.alias("e1"), e2.alias("e2"))
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("e1") == F.col("d1"))
            & (F.col("e2") == F.col("d2")))
    met = given.join(judged, same, "left").where(F.coalesce("stays", F.lit(True)))
    met = met.select("row", "doc_id", "e1", "e2", (F.coalesce("n", F.lit(1)) > 1).alias("repeated"))
    once = met.where("repeated").dropDuplicates(["doc_id", "e1", "e2"])
    return rows_again(met.where(~F.col("repeated")).unionByName(once))
