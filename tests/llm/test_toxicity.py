import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from oracle import DATA
from tessera.llm import quality, toxicity
from tessera.llm.toxicity import Model, maximal_segments


def by_definition(scores):
    """All maximal scoring segments: take the best one, then look left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for z in range(a, len(scores)):
            total += scores[z]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) <= 1e-9 and z - a < best[1] - best[0]):
                best = (a, z, total)
    if best is None:
        return []
    a, z, s = best
    shift = lambda found, by: [(x + by, y + by, v) for x, y, v in found]
    return by_definition(scores[:a]) + [best] + shift(by_definition(scores[z + 1 :]), z + 1)


def test_segments_by_definition():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(0, 40)
        scores = [rng.choice([-1.0, -1.0, -1.0, round(rng.uniform(-4, 0), 3), round(rng.uniform(0.5, 4), 3)]) for _ in range(n)]
        found = maximal_segments([(i, s) for i, s in enumerate(scores) if s != -1.0], 1.0)
        wanted = by_definition(scores)
        assert [(a, z) for a, z, _ in found] == [(a, z) for a, z, _ in wanted]
        assert np.allclose([s for *_, s in found], [s for *_, s in wanted])


def test_many_hits_take_linear_time():
    hits = [(2 * i, 1.5) for i in range(200_000)]
    assert len(maximal_segments(hits, 1.0)) == 1
    assert len(maximal_segments([(10 * i, 1.5) for i in range(200_000)], 1.0)) == 200_000


def test_lambda_and_p_values():
    lam = toxicity.solve_lambda([(2.0, 0.1)], 1.0)
    assert abs(0.9 * np.exp(-lam) + 0.1 * np.exp(2 * lam) - 1) < 1e-6 and lam > 0
    m = Model({"bad": 3.0}, lam=1.0, k=0.1)
    assert 0 < m.p_value(9, 100) < m.p_value(3, 100) < m.p_value(3, 10_000) <= 1


def test_scores_by_brute_force(spark):
    """Counts, log-odds, lambda, K, the logistic curve and the segments, each worked out plainly on a small table."""
    rng = random.Random(12)
    vocab, bad = [f"w{i}" for i in range(60)], ["vile", "rotten", "foul"]
    docs, labels = [], []
    for i in range(400):
        words, toxic = rng.choices(vocab, k=rng.randint(3, 40)), int(rng.random() < 0.3)
        if toxic and rng.random() < 0.9:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=rng.randint(1, 4))
        elif not toxic and rng.random() < 0.5:
            words.append("kind")
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lf = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_documents(df, toxicity.fit(df, lf)).collect()}

    text, label = dict(docs), dict(labels)
    learn = [i for i in text if zlib.crc32(str(i).encode()) % 5]
    thirds = {r["i"]: r["x"] for r in spark.range(400).select(F.col("id").alias("i"), F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(3)).alias("x")).collect()}
    counts = {}
    for i in learn:
        if thirds[i]:
            for w in set(text[i].split()):
                counts.setdefault(w, [0, 0])[label[i]] += 1
    n0, n1 = (sum(c[k] for c in counts.values()) for k in (0, 1))
    score, share = {}, {}
    for w, (c, t) in counts.items():
        a = 50.0 * (c + t) / (n0 + n1)
        odds = [np.log((y + a) / (n + 50.0 - y - a)) for y, n in ((c, n0), (t, n1))]
        g = 2 * sum(y * np.log(y * (n0 + n1) / (n * (c + t))) for y, n in ((c, n0), (t, n1)) if y)
        if g >= 10.83:
            score[w], share[w] = odds[1] - odds[0] - 1.0, (c + 0.5) / (n0 + 1)
    assert min(score.values()) < -1.0 and set(bad) <= set(score) and "kind" in score
    over = lambda x: sum(p * np.exp(score[w] * x) for w, p in share.items()) + max(0, 1 - sum(share.values())) * np.exp(-x) - 1
    low, high = 1e-3, 20.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if over((low + high) / 2) < 0 else (low, (low + high) / 2)
    parts = lambda i: [s for *_, s in by_definition([score.get(w, -1.0) for w in text[i].split()])]
    held = [i for i in learn if not thirds[i]]
    floor = min(s for s in score.values() if s > 0)
    clean = [i for i in held if not label[i]]
    k = (sum(s >= floor for i in clean for s in parts(i)) + 0.5) / max(1.0, sum(len(text[i].split()) for i in clean) * np.exp(-high * floor))

    def evidence(i):
        p = [1 - np.exp(-k * len(text[i].split()) * np.exp(-high * s)) for s in parts(i)]
        return sum(-np.log(x) for x in p if x < 0.05)

    pos = sum(label[i] for i in held)
    aim = {1: (pos + 1) / (pos + 2), 0: 1 / (len(held) - pos + 2)}
    w = np.zeros(2)
    z = np.array([[evidence(i), 1.0] for i in held])
    t = np.array([aim[label[i]] for i in held])
    for _ in range(4000):  # small steps along the curvature's inverse
        p = 1 / (1 + np.exp(-z @ w))
        w += 0.5 * np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-3 * np.eye(2), z.T @ (t - p) - 1e-3 * w)
    wanted = {i: 1 / (1 + np.exp(-(w[0] * evidence(i) + w[1]))) for i in text}
    assert all(abs(found[i] - wanted[i]) < 1e-6 for i in text) and max(wanted.values()) > 0.9


def test_repeated_ids_count_once(spark):
    """Rows that repeat a labelled id don't add to the sample."""
    docs = [(i, f"t{i % 7} vile") for i in range(40)] + [(7, f"again {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    sample = quality.labelled_sample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), labels, "toxic", 20)
    ids = [r["_id"] for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 20


def test_held_out_accuracy(spark):
    folder = DATA.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["predicted"] for r in clean]) < 0.02
    assert all(r["segments"] for r in toxic if r["predicted"])


def test_edges(spark, edge, nothing, given):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(i, 1, int(i == 7)) for i in (7, 8, 9, 14)], none.schema)):
        model = toxicity.fit(edge, labels)
        rows = toxicity.score_documents(edge, model).collect()
        assert len(rows) == len(given) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert toxicity.score_documents(nothing, model).count() == 0
    toxicity.fit(nothing, none)
    spans = toxicity.score_documents(spark.createDataFrame([(1, "Ok. BAD bad, fine")], "doc_id long, text string"), Model({"bad": 9.0}, k=1e-3)).first()["segments"]
    assert [(s["start"], s["end"]) for s in spans] == [(4, 11)]
