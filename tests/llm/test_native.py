"""Packing, sharding, mixing, quality rules and chat formatting."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from brute import stats, words
from oracle import DATA, assert_same
from tessera.llm import chat, mixing, packing, quality, queries, sharding

PYTHON = ("Python", "Pandas", "Arrow")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in PYTHON)


# packing


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_boundaries_are_optimal(buckets):
    lengths, counts = [0, 1, 3, 4, 9, 10, 30], [5, 1, 7, 2, 2, 9, 1]
    found = packing.optimal_boundaries(lengths, counts, buckets)
    best = min(padding(lengths, counts, [*c, 30]) for k in range(min(buckets, 7)) for c in itertools.combinations(lengths[:-1], k))
    assert len(found) <= buckets and padding(lengths, counts, found) == best


def test_packing_edges(edge, nothing, given):
    found = packing.pack_lengths(edge, buckets=4, max_len=100, token_budget=250).collect()
    whole = Counter()
    for r in found:
        whole[r["doc_id"]] += r["length"]
        assert r["length"] + r["padding"] == r["bucket_len"] and r["place"] < max(1, 250 // max(1, r["bucket_len"]))
    wanted = Counter()
    for i, t, *_ in given:
        wanted[i] += len(words(t))
    assert +whole == +wanted and {r["doc_id"] for r in found} == {i for i, *_ in given}
    for b in {r["bucket"] for r in found}:
        sizes = Counter(r["batch"] for r in found if r["bucket"] == b)
        full = max(1, 250 // max(1, next(r["bucket_len"] for r in found if r["bucket"] == b)))
        assert sorted(sizes) == list(range(len(sizes))) and all(n == full for k, n in sizes.items() if k < len(sizes) - 1)
        assert len({(r["batch"], r["place"]) for r in found if r["bucket"] == b}) == sum(sizes.values())
    assert packing.pack_lengths(nothing).count() == 0


def test_packing_by_brute_force(spark):
    """The query's buckets waste as little as any, and its batches hold every piece once."""
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op4_length_buckets(spark, DATA).collect()
    pieces = {(i, p): min(4096, n - 4096 * p) for i, n in ((i, len(words(t))) for i, t in text.items()) for p in range(max(1, -(-n // 4096)))}
    assert {(r["doc_id"], r["piece"]): r["length"] for r in found} == pieces and len(found) == len(pieces)
    assert all(r["start"] == 4096 * r["piece"] for r in found)
    count = sorted(Counter(pieces.values()).items())
    best = {0: 0}  # lengths covered -> least padding, one bucket more in each round
    for _ in range(16):
        more = dict(best)
        for j in range(1, len(count) + 1):
            cost, top = 0, count[j - 1][0]
            for i in range(j - 1, -1, -1):
                cost += count[i][1] * (top - count[i][0])
                if i in best and best[i] + cost < more.get(j, math.inf):
                    more[j] = best[i] + cost
        best = more
    assert sum(r["padding"] for r in found) == best[len(count)]
    bounds = sorted({(r["bucket"], r["bucket_len"]) for r in found})
    assert [b for b, _ in bounds] == list(range(len(bounds))) and len(bounds) <= 16
    for r in found:
        assert r["bucket_len"] == min(b for _, b in bounds if b >= r["length"]) == r["length"] + r["padding"]
    for k, b in bounds:
        full = max(1, 65_536 // max(1, b))
        places = sorted((r["batch"], r["place"]) for r in found if r["bucket"] == k)
        assert places == [divmod(i, full) for i in range(len(places))]


# sharding


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def test_shards_of_the_documents(spark):
    df = queries.op6_histogram_sort(spark, DATA)
    no_python(df)
    found = df.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(found) == len(texts)
    by = shards_of(found)
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    biggest = max(r["size"] for r in found)
    assert set(by) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * biggest
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    for r in found:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    split = sum(len(s) > 1 for s in (lambda d: [d.setdefault(texts[r["doc_id"]], set()).add(r["shard"]) for r in found] and d.values())({}))
    assert split <= 7


def test_a_hot_group_is_cut_by_rows(spark):
    rows = [(i, "same text for all of these") for i in range(3000)] + [(10_000 + i, f"text {i} " * (i % 5 + 1)) for i in range(500)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = [sum(r["size"] for r in x) for x in shards_of(found).values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 100


def test_groups_of_copies_whole_or_cut(spark):
    """``whole`` never divides a group; ``cut`` does, and says which."""
    rows = [(i, "one text for all of these") for i in range(3000)] + [(10_000 + i, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = sharding.assign_shards(df, copies="whole").collect()
    assert len({r["shard"] for r in whole if r["doc_id"] < 3000}) == 1 and not any(r["group_cut"] for r in whole)
    cut = sharding.assign_shards(df).collect()
    assert {r["doc_id"] for r in cut if r["group_cut"]} == set(range(3000))
    with pytest.raises(ValueError, match="cut or whole"):
        sharding.assign_shards(df, copies="some")


def test_shard_edges(spark, edge, nothing, given, tmp_path):
    found = sharding.assign_shards(edge, shards=5).collect()
    assert len(found) == len(given) and {r["size"] for r in found if r["doc_id"] in (0, 1)} == {1}
    for rows in shards_of(found).values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sharding.assign_shards(nothing).count() == 0
    one = sharding.assign_shards(edge.where("doc_id = 10"), shards=8).collect()
    assert sorted(r["slot"] for r in one) in ([0, 1, 2], [0, 0, 1], [0, 0, 0])
    assert sharding.write_shards(edge, str(tmp_path / "s"), 3) == "shard_"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(given) and {r["shard"] for r in back.collect()} == {"shard"} and set(back.columns) == {*edge.columns, "shard_"}


# mixing


def test_mixing_matches_sql(spark):
    df = queries.op7_poisson_mixing(spark, DATA)
    no_python(df)
    assert_same(df, queries.ORACLES["op7_poisson_mixing"])


def test_poisson_counts(spark):
    """Counts follow the distribution, also for means drawn in parts."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    for budget in (0.5, 1.0, 20.0):
        got = Counter(r["doc_id"] for r in mixing.mix_sources(docs, {"s": 1.0}, budget=budget).select("doc_id").collect())
        counts = [got.get(i, 0) for i in range(n)]
        assert abs(np.mean(counts) - budget) < 5 * math.sqrt(budget / n) and abs(np.var(counts) / budget - 1) < 0.06
        if budget == 1.0:
            assert abs(counts.count(0) / n - math.exp(-1)) < 0.02


def test_target_shares(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 6000, "hot").otherwise(F.when(F.col("id") < 8000, "b").otherwise("c")).alias("source"))
    mixed = Counter(r["source"] for r in mixing.mix_sources(docs, {"hot": 1.0, "b": 2.0}).collect())
    assert abs(mixed["b"] / mixed["hot"] - 2) < 0.15 and "c" not in mixed
    broadcast = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    salted = mixing.mix_sources(docs, most_broadcast=0)
    assert sorted(map(tuple, salted.collect())) == broadcast


def test_mixing_edges(edge, nothing, given):
    found = mixing.mix_sources(edge, budget=3.0)
    assert found.columns == [*edge.columns, "mix_copy_", "mix_copies", "mix_key"]
    rows = found.collect()
    assert {r["doc_id"] for r in rows} <= {i for i, *_ in given} and any(r["source"] is None for r in rows)
    assert Counter(r["doc_id"] for r in rows)[10] % 3 == 0  # three rows with one id draw one count
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mix_sources(edge, extras=False).columns == edge.columns


# quality


def test_base_statistics(spark, edge, given):
    found = quality.apply_rules(edge, quality.DecisionList())
    no_python(found)
    got = sorted(((r["doc_id"], *[r[c] for c in quality.BASE]) for r in found.collect()), key=repr)
    assert got == sorted(((i, *stats(t)) for i, t, *_ in given), key=repr)


def test_statistics_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op8_decision_list(spark, DATA).collect()}
    for r in docs.collect():
        f, s = found[r["doc_id"]], stats(r["text"])
        assert tuple(f[c] for c in quality.BASE) == s
        assert f["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (f["base_failed"] and f["kept"])


def test_held_out_verdicts(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["kept"]) for r in queries.op8_decision_list(spark, DATA).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([bool(a) == b for a, b in held]) > 0.85


def features(text):
    """What the rules test, plainly."""
    n, chars, symbols, dups, repeats = stats(text)
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    alpha = sum(bool(regex.fullmatch(r"\p{L}+[.,;:!?]?", x)) for x in w)
    a, b = max(1, n), max(1, len(lines))
    return {"words": n, "mean_word": chars / a, "symbol_share": symbols / a, "dup_line_share": dups / b, "repeat_share": repeats / a, "distinct_share": len(set(w)) / a, "alpha_share": alpha / a, "words_a_line": n / b}


def test_verdicts_by_brute_force(spark):
    """The list learned from plain features, and each row's verdict from that list."""
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["quality"] is not None}
    row = {i: features(t) for i, t in text.items()}
    learn = sorted(i for i in label if i in text and zlib.crc32(str(i).encode()) % 5)
    order = np.random.default_rng(0).permutation(len(learn))
    names = list(quality.FEATURES)
    x, y = (np.array(v, dtype=float)[order] for v in ([[row[i][n] for n in names] for i in learn], [label[i] for i in learn]))
    learned = quality.learn_decision_list(x, y > 0, names)
    for r in queries.op8_decision_list(spark, DATA).collect():
        assert r["kept"] == (not r["base_failed"] and learned.decide(row[r["doc_id"]]))


def test_learned_rules():
    rng, names = np.random.default_rng(1), ["a", "b", "c"]
    x = rng.random((900, 3))
    good = ~((x[:, 0] > 0.7) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9))
    learned = quality.learn_decision_list(x, good, names)
    kept = np.array([learned.decide(dict(zip(names, v, strict=True))) for v in x])
    assert (kept == good).mean() > 0.95 and 0 < len(learned.rules) < 12
    assert quality.learn_decision_list(x, np.ones(900, bool), names) == quality.DecisionList()
    assert quality.learn_decision_list(x, np.zeros(900, bool), names) == quality.DecisionList((), False)


def test_order_decides(spark):
    """An exception inside an exception takes rules of both classes; the column says what the list says, and swapped rules say something else."""
    rng, names = np.random.default_rng(2), list(quality.FEATURES)
    x = np.column_stack([rng.integers(0, 100, 3000)] + [rng.random(3000) for _ in names[1:]])
    good = np.where(x[:, 0] < 30, True, np.where(x[:, 2] > 0.6, x[:, 4] > 0.7, True))
    learned = quality.learn_decision_list(x, good, names)
    assert {r.verdict for r in learned.rules} | {learned.default} == {True, False}
    rules = (quality.Rule((("words", False, 30.0),), True), quality.Rule((("symbol_share", True, 0.6),), False))
    lists = [learned, quality.DecisionList(rules), quality.DecisionList(rules[::-1])]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha"]
    counts = rng.integers(0, 60, (400, len(base)))
    df = spark.createDataFrame([tuple(map(int, r)) for r in counts], ", ".join(f"{c} long" for c in base))
    found = df.select(*[quality.FEATURES[n](F.col).cast("double").alias(n) for n in names], *[quality.verdict(k).alias(f"v{i}") for i, k in enumerate(lists)]).collect()
    for i, k in enumerate(lists):
        assert [r[f"v{i}"] for r in found] == [k.decide(r.asDict()) for r in found]
    assert any(r["v1"] != r["v2"] for r in found)


def test_quality_without_labels(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(edge, none) == quality.fit_rules(nothing, none) == quality.DecisionList()
    some = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    quality.fit_rules(edge, some)
    assert quality.apply_rules(nothing, quality.DecisionList()).count() == 0


# chat


def conversation(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))


def test_chat_matches_sql(spark):
    df = queries.op10_chat_format(spark, DATA)
    no_python(df)
    assert_same(df, queries.ORACLES["op10_chat_format"])


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n### assistant: ", "\\b\\h\\e\\c", "####", "<</turn", "", "a: b\n", "\\", "\U0001f600 é"]
    rows = [(i, t, r, x, "clash") for i, x in enumerate(nasty) for t, r in ((0, "user"), (1, "assistant"), (2, "odd: ### role\\"))]
    found = {r["conv_id"]: r for r in conversation(spark, rows).select("*", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_texts(F.col("segments")).alias("l")).collect()}
    for i, x in enumerate(nasty):
        assert [tuple(t) for t in found[i]["t"]] == [("user", x), ("assistant", x), ("odd: ### role\\", x)] and found[i]["l"] == [x]
        assert "".join(s["text"] for s in found[i]["segments"]) == found[i]["formatted"] and not found[i]["valid"]


def test_chat_states_and_edges(spark):
    turns = {1: ["system", "user", "assistant"], 2: ["user", "assistant", "user", "assistant"], 3: ["assistant"], 4: ["user", "user"], 5: ["user"], 6: ["user", None]}
    rows = [(i, k, r, None if k == 1 else "t", None) for i, rs in turns.items() for k, r in enumerate(rs)] + [(None, None, "user", "x", None), (7, 1, "user", "b", None), (7, 1, "assistant", "a", None), (7, None, "user", "first", None)]
    found = {r["conv_id"]: r for r in conversation(spark, rows).select("*", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert {i: found[i]["valid"] for i in turns} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert [t["text"] for t in found[7]["t"]] == ["first", "a", "b"] and len(found) == 8
    assert conversation(spark, []).count() == 0
    digest = {r["conv_id"]: r for r in chat.digests(conversation(spark, rows)).collect()}
    assert digest[1]["turns_sha256"] == hashlib.sha256(b"system\nt\nuser\n\nassistant\nt\n").hexdigest() and digest[1]["loss_chars"] == 1
