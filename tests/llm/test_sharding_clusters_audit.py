"""Filter audit, centroid clustering and sharding against brute force, on odd rows and whole small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclog.llm import clustering, filter_audit, sharding
from seclog.llm.queries import op12_centroid_clustering, op13_sharding

# ---- filter audit ----

LABELS = "doc_id long, quality int, toxic int, extra string"
MARKS = [(1, 1, 0, "x"), (1, 0, 1, "x"), (3, 1, 1, None), (4, None, None, "x"), (None, 1, 1, "x"), (6, 0, 1, "x")]


def brute_audit(rows, labels):
    """rows: (doc_id, text, part)."""
    good = {r[0] for r in labels if r[1] == 1 and r[0] is not None}
    toxic = {r[0] for r in labels if r[2] == 1 and r[0] is not None}
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    judged = []
    for doc_id, text, part in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = "".join(name for name, failed in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t),
            doc_id is not None and doc_id > least[t]]) if failed)
        judged.append((part or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = [], Counter()
    for part, order in itertools.product(sorted({j[0] for j in judged}), itertools.permutations("ABCDE")):
        left = [j for j in judged if j[0] == part]
        of_part = list(left)
        for step, f in enumerate(order, 1):
            gone = [j for j in left if f in j[1]]
            left = [j for j in left if f not in j[1]]
            shapley[part, f] += len(gone)
            out.append([part, "".join(order), step, len(left), len(gone),
                        sum(f in j[1] for j in of_part) - len(gone), sum(j[1] == f for j in of_part),
                        sum(j[2] for j in gone), sum(j[3] for j in gone)])
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_of_odd_rows(spark, docs, cases):
    more = [(20, "A#B " * 300, "en", 0), (21, "A#B " * 300, None, 0), (None, "A#B " * 300, "en", 0),
            (20, "A#B " * 300, "fr", 0), (22, " ".join(f"w{n}" for n in range(250)), "en", 0)]
    given = docs.unionByName(spark.createDataFrame([m[:3] for m in more], "doc_id long, text string, lang string"), True)
    found = filter_audit.filter_audit(given, spark.createDataFrame(MARKS, LABELS))
    want = brute_audit([c[:3] for c in cases] + [m[:3] for m in more], MARKS)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_audit_of_nothing(spark, docs, no_docs):
    marks = spark.createDataFrame(MARKS, LABELS)
    assert filter_audit.filter_audit(no_docs, marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.audit(marks, "AAB")


def test_swaps_visit_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), set()
        for k in [None, *filter_audit.adjacent_swaps(n)]:
            if k is not None:
                order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def test_equal_subdiagrams_are_one_node():
    diagram = filter_audit.Diagram({m: (2, 1, 0) for m in range(32)}, "ABCDE")
    for k in [None, *filter_audit.adjacent_swaps(5)]:
        if k is not None:
            diagram.swap(k)
        assert [len(level) for level in diagram.levels] == [1] * 5


# ---- centroid clustering ----

VECTORS = "vec_id long, embedding array<double>, cluster int, row string"


def brute_clusters(rows, clusters=8, rounds=10, scale=1024, components=64):
    """rows: (id, vector); everything in Python's integers."""
    kept = [(i, [math.floor(int(x) * scale if abs(x) > 2**52 else x * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), n in zip(kept, own) if n == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    of = Counter()
    for _, c, d in found:
        of[c] += d
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, c, long(d), long(of[c]), long(sum(of.values())), names[c]) for i, c, d in found), key=repr)


def clusters_of(frame, **options):
    found = clustering.cluster(frame, **options)
    return sorted((tuple(r) for r in found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters_of_the_table(spark, sf_dir, table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    found = op12_centroid_clustering(spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(n, (rng.integers(-4, 5, 64) / 1024).tolist()) for n in range(60)]
    rows += [(60 + n, rows[n % 3][1]) for n in range(40)]  # copies and ties
    rows += [(7, rows[7][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [None] + [0.0] * 63),
             (205, [float("nan")] + [0.0] * 63), (206, [float("-inf")] + [0.0] * 63)]
    return rows


def test_odd_vectors(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], VECTORS).repartition(3)
    assert clusters_of(frame) == brute_clusters(rows)
    assert clusters_of(frame, clusters=500) == brute_clusters(rows, clusters=500)


def test_huge_values_are_exact(spark):
    rows = odd_vectors() + [(300, [1e30] * 64), (301, [-3e38] + [2.5] * 63), (302, [2.0**40 + 0.5] * 64)]
    frame = spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], VECTORS).repartition(3)
    assert clusters_of(frame) == brute_clusters(rows)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "x")]):
        assert clustering.cluster(spark.createDataFrame(rows, VECTORS)).count() == 0


@pytest.mark.parametrize("huge", [1, 10**30])
def test_tree_finds_what_comparing_all_finds(huge):
    rng = np.random.default_rng(huge % 97)
    for size in (1, 2, 3, 9, 40):
        centroids = rng.integers(-3, 4, (size, 3))
        vectors = rng.integers(-4, 5, (400, 3))
        if huge > 1:
            centroids, vectors = centroids.astype(object) * huge, vectors.astype(object) * huge
        best, distance = clustering.nearest(clustering.VantageTree(centroids), vectors)
        full = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        want = [min(range(size), key=lambda c: (row[c], c)) for row in full.tolist()]
        assert best.tolist() == want and distance.tolist() == [r[c] for r, c in zip(full.tolist(), want)]


# ---- sharding ----

def shards_of(found):
    return [r.asDict() for r in found.select("row.doc_id", "row.text", "size", "text_crc32", "law", "shard", "slot",
                                             "grown_shard").collect()]


def assert_law(rows, given, shards):
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(given, key=repr)
    counts = Counter(r["shard"] for r in rows)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.get(s, 0) for s in range(shards)) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["law"] == "rows" and r["grown_shard"] is None


def split_groups(rows):
    held = {}
    for r in rows:
        held.setdefault(r["text"] or "", set()).add(r["shard"])
    return {t: s for t, s in held.items() if len(s) > 1}


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_of_odd_rows(docs, cases, no_docs, shards):
    rows = shards_of(sharding.shard_documents(docs, shards))
    assert_law(rows, [c[:2] for c in cases], shards)
    assert sharding.shard_documents(no_docs, shards).count() == 0


def test_groups_stay_together(spark, sf_dir, table):
    """One group of a third of all rows fills whole shards, all other groups are whole."""
    docs = table("documents").select("doc_id", "text")
    n = docs.count()
    hot = spark.range(n // 2).select((F.col("id") + 10**6).alias("doc_id"), F.lit("hot text").alias("text"))
    both = docs.unionByName(hot).repartition(5)
    rows = shards_of(sharding.shard_documents(both, 24))
    assert_law(rows, [tuple(r) for r in both.collect()], 24)
    torn = split_groups(rows)
    quota = math.ceil(len(rows) / 24)
    at_best = math.ceil((n // 2) / quota)
    assert set(torn) <= {"hot text"} and len(torn["hot text"]) <= at_best + 2


def test_all_linked_rows_are_moved_by_swaps(spark):
    """Without a document to spare every move is a swap: most pairs still come together."""
    pairs = spark.range(6000).select("id", F.concat(F.lit("t"), (F.col("id") / 2).cast("long")).alias("text"))
    docs = pairs.withColumnRenamed("id", "doc_id").repartition(4)
    rows = shards_of(sharding.shard_documents(docs, 6, rounds=5))
    assert_law(rows, [tuple(r) for r in docs.collect()], 6)
    assert len(split_groups(rows)) < 0.25 * 3000


def test_shares_keep_within_room():
    shares = sharding.granted({(0, 1): 10, (1, 0): 4, (2, 1): 6, (0, 2): 5}, [0, 3, 5])
    into = {(o, t): s for o, t, s in shares}
    assert into[1, 0] == 1 and into[0, 2] == 1
    assert math.isclose(into[0, 1] * 10 - 4 + into[2, 1] * 6, 3)


def test_sharding_query_is_native_and_whole(spark, sf_dir, table):
    found = op13_sharding(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    rows = [r.asDict() | {"text": None} for r in found.collect()]
    text = {r.doc_id: r.text for r in table("documents").collect()}
    for r in rows:
        r["text"] = text[r["doc_id"]]
    assert_law(rows, list(text.items()), 24)
    assert not split_groups(rows)
