import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import components, shingles
from oracle import DATA
from tessera.llm import ngram_join
from tessera.llm.common import Workspace
from tessera.llm.ngram_join import PartEnum
from tessera.llm.tokens import shingle_set, word_hashes


def features(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)


@pytest.mark.parametrize("num, cells", [(90, 3), (80, 3), (80, 2), (60, 2), (100, 3)])
def test_similar_sets_share_a_signature(num, cells):
    """Random pairs at the very threshold, all of which must meet."""
    rng, scheme = random.Random(num + cells), PartEnum(num, 100, cells)
    for size in [1, 2, 3, 5, 9, 10, 11, 19, 20, 33, 50, 101, 300, 1000] * 4:
        both = features(rng, size)
        most = (size * 100) // num - size  # |A and B| = size, |A or B| = size + most at most
        left = rng.randint(0, most)
        a, b = np.concatenate([both, features(rng, left)]), np.concatenate([both, features(rng, most - left)])
        a.sort(), b.sort()
        assert set(scheme.signatures(a).tolist()) & set(scheme.signatures(b).tolist())


def test_unrelated_sets_share_none():
    rng, scheme = random.Random(3), PartEnum(80, 100, 3)
    seen = [set(scheme.signatures(np.sort(features(rng, 200))).tolist()) for _ in range(30)]
    assert sum(len(a & b) for i, a in enumerate(seen) for b in seen[:i]) == 0


def test_a_sketch_never_overstates_the_distance():
    rng = random.Random(5)
    for _ in range(50):
        both = features(rng, 200)
        a, b = np.concatenate([both, features(rng, 9)]), np.concatenate([both, features(rng, 14)])
        apart = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(ngram_join.sketch(a).view(np.uint64), ngram_join.sketch(b).view(np.uint64), strict=True))
        assert apart <= 23


@pytest.mark.parametrize("sizes", [(900, 60, 70), (1900, 90, 200), (3000, 300, 250), (1000, 20, 200)])
def test_wide_sketches_let_similar_pairs_pass(spark, sizes):
    """Pairs over the threshold pass, wherever the two widths differ; unrelated long sets don't."""
    both, left, right = (features(random.Random(k), n) for k, n in enumerate(sizes))
    a, b, c = np.concatenate([both, left]), np.concatenate([both, right]), features(random.Random(9), sizes[0])
    rows = [(len(x), len(y), ngram_join.sketch(x).tolist(), ngram_join.sketch(y).tolist()) for x, y in ((a, b), (b, a), (a, c))]
    found = spark.createDataFrame(rows, "na long, nb long, sa array<long>, sb array<long>").select(ngram_join._similar(75, 100, *map(F.col, ("na", "nb", "sa", "sb"))).alias("x")).collect()
    assert [r["x"] for r in found] == [True, True, False]


def test_shingle_sizes(given):
    texts = [t for _, t, *_ in given]
    low = [(t or "").encode().lower() if (t or "").isascii() else (t or "").encode() for t in texts]
    for n in (1, 3, 5):
        assert [len(shingle_set(w, n)) for w in word_hashes(low)] == [len(shingles(t, n)) for t in texts]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80), (1, 50)])
def test_edges(edge, given, n, num):
    found = sorted((tuple(r) for r in ngram_join.ngram_components(edge, n, num, 100).where("doc_id is not null").collect()))
    assert found == sorted(components([(i, t) for i, t, *_ in given if i is not None], n, num, 100))


def test_null_ids_and_empty_tables(edge, nothing, given, spark):
    found = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(edge).where("doc_id is null").collect()]
    assert sorted(found) == sorted((len(shingles(t, 5)), None) for i, t, *_ in given if i is None)
    alone = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(4, "x")] * 2, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_components(alone).collect()), key=repr) == [(4, 1, 4)] * 2 + [(None, 2, None)] * 3
    assert ngram_join.ngram_components(nothing).count() == 0
    assert ngram_join.one_of_each(nothing).columns == nothing.columns


def test_query_against_brute_force(spark):
    from tessera.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t, 3) for i, t in docs}
    index, root = {}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        met = {}
        for x in s:
            for j in index.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            index[x].append(i)
        for j, k in met.items():
            if 100 * k >= 90 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_partenum_join(spark, DATA).collect()}
    assert found == {i: (len(s), find(i)) for i, s in sets.items()}


def test_chains_of_near_copies(spark):
    """Documents of which only neighbours in a chain are similar enough, and a star without a common link."""
    rng = random.Random(8)
    words = [f"w{rng.getrandbits(40)}" for _ in range(300)]
    docs, now = [], list(words)
    for i in range(40):
        docs.append((1000 - i, " ".join(now)))
        for _ in range(3):
            now[rng.randrange(300)] = f"x{rng.getrandbits(40)}"
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for rounds in (0, 1, 4):
        found = sorted(map(tuple, ngram_join.ngram_components(df, 3, 90, 100, rounds=rounds).collect()))
        assert found == sorted(components(docs, 3, 90, 100))


@pytest.mark.parametrize("rounds, picks", [(0, 1), (0, 4), (0, 1000), (2, 2)])
def test_large_groups_of_uneven_copies(spark, rounds, picks):
    """Two crowds of copies, many below the threshold to each other, and a few members that link to one or two only."""
    rng, docs = random.Random(12), []
    for crowd in range(2):
        words = [f"{crowd}w{i}" for i in range(120)]
        for i in range(90):
            now = list(words)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 5])):
                now[rng.randrange(120)] = f"x{rng.getrandbits(40)}"
            docs.append((crowd * 90 + i, " ".join(now)))
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string").repartition(6)
    found = sorted(map(tuple, ngram_join.ngram_components(df, 3, 90, 100, rounds=rounds, picks=picks).collect()))
    assert found == sorted(components(docs, 3, 90, 100))
    assert 2 < len({r[2] for r in found}) < 120


def test_connected(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7)]
    found = dict(map(tuple, ngram_join.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()))
    assert found == {i: 1 for i in range(2, 61)} | {101: 100, 103: 100}


def joined(edges):
    """The smallest vertex that each vertex reaches, for those that reach a smaller one."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = sorted(map(find, e))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


def jobs(spark, name, run):
    """What ``run`` returns, and how many Spark jobs it started."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_forest():
    rng = random.Random(2)
    for n, m in ((1, 0), (5, 3), (300, 200), (300, 900)):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)] + [(2**62, -(2**62))]
        v, root = ngram_join.forest(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
        assert len(v) == len(set(v.tolist())) and dict(zip(v.tolist(), root.tolist(), strict=True)) == joined(edges)


def test_connected_in_many_tasks(spark):
    """With edges dealt over tasks that never meet in one, so that the steps between tasks are needed."""
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 - i, 999 - i) for i in range(90)] + [(2000, 3000 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("9", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        found = list(map(tuple, ngram_join.connected(df, Workspace(spark, "test")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == len(dict(found)) and dict(found) == joined(edges)


def test_small_components_take_few_jobs(spark):
    """Each query leaves plans, broadcasts and threads with the driver: over 1500 MB of them in a session of several runs."""
    edges = [(i, i + 1) for i in range(60)]
    found, count = jobs(spark, "connected", lambda: ngram_join.connected(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")))
    assert dict(map(tuple, found.collect())) == joined(edges)
    assert 0 < count <= 8
