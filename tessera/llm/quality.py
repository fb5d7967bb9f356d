"""Quality rules: text statistics and learned decision lists.

Native: the statistics and the learned rules are DataFrame expressions. The
list is learned by sequential covering on a bounded sample of labelled rows:
for either class grow a conjunction of thresholds on two thirds of the rows
left and prune it on the other third; append the better of the two rules if it is
good enough, remove what it covers, repeat. The rows left at the end decide what
holds where no rule is met. The first rule met decides, so an accepting rule
shields its rows from all that follow it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, held_out, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the rules may test: ratios, so that they mean the same for long and short texts.
FEATURES = {
    "words": lambda c: c("n_words"),
    "mean_word": lambda c: c("word_chars") / F.greatest(F.lit(1), c("n_words")),
    "symbol_share": lambda c: c("n_symbols") / F.greatest(F.lit(1), c("n_words")),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(F.lit(1), c("n_lines")),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(F.lit(1), c("n_words")),
    "distinct_share": lambda c: c("n_distinct") / F.greatest(F.lit(1), c("n_words")),
    "alpha_share": lambda c: c("n_alpha") / F.greatest(F.lit(1), c("n_words")),
    "words_a_line": lambda c: c("n_words") / F.greatest(F.lit(1), c("n_lines")),
}


def window_hashes(w: Column) -> Column:
    """The 64-bit hash of each 3-word window, in order."""
    n = F.size(w)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def _covered(positions: Column) -> Column:
    """Words under 3-word windows at the given ascending positions."""
    return F.aggregate(positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``BASE`` and the counts that ``FEATURES`` use.

    Null counts as an empty text; an empty text has all counts 0. Words in
    3-word windows that occur twice or more are found by the windows' hashes,
    first sorted as longs. With few repeated windows their positions are looked
    up directly; with many, the windows are sorted with their positions, so the
    cost stays n log n.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(*keep, t.alias("_t"), words(F.col(text)).alias("_w"))
    second = first.select(*keep, "_t", "_w", window_hashes(F.col("_w")).alias("_h"))
    third = second.select(*keep, "_t", "_w", "_h", F.sort_array("_h").alias("_s"))
    dups = F.array_distinct(F.filter("_s", lambda x, i: x == F.get(F.col("_s"), i + 1)))
    fourth = third.select(*keep, "_t", "_w", "_h", dups.alias("_d"))
    few = F.filter(F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    many = F.when(F.size("_d") > 32, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    fifth = fourth.select(*keep, "_t", "_w", "_h", "_d", many.alias("_p"))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_p", lambda x, i: same(x, F.get(F.col("_p"), i + 1)) | same(x, F.get(F.col("_p"), i - 1))), lambda x: x["i"]))
    spots = F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= 32, few).otherwise(twice)
    sixth = fifth.select(*keep, "_t", "_w", spots.alias("_at"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("_l"))
    gone = F.translate("_t", "#*$%&|<>", "")
    return sixth.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(gone)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_at")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"), F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.size(F.filter("_w", lambda x: x.rlike("^\\p{L}+[.,;:!?]?$"))).cast("long").alias("n_alpha"),
    )


@dataclass(frozen=True)
class Rule:
    """``verdict`` for rows that meet all of (feature, at_least, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]
    verdict: bool

    def met(self, row: dict[str, float]) -> bool:
        return all((row[name] >= cut) == at_least for name, at_least, cut in self.tests)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; ``default`` holds for rows that meet none."""

    rules: tuple[Rule, ...] = ()
    default: bool = True

    def decide(self, row: dict[str, float]) -> bool:
        return next((r.verdict for r in self.rules if r.met(row)), self.default)


def grow(x: np.ndarray, y: np.ndarray, names: list[str], most_tests: int = 4) -> list[tuple[str, bool, float]]:
    """Add the test with the largest FOIL gain until no row of the other class is left."""
    inside, tests = np.ones(len(y), dtype=bool), []
    while len(tests) < most_tests and y[inside].sum() < inside.sum():
        p, n = y[inside].sum(), inside.sum()
        best, rest = (1e-9, None), inside.copy()
        for f, name in enumerate(names):
            v = x[inside, f]
            order = np.argsort(v, kind="stable")
            vs, pos = v[order], np.cumsum(y[inside][order])
            edge = np.flatnonzero(vs[1:] > vs[:-1])  # a cut lies between different values only
            if not len(edge):
                continue
            cut, below, hit = (vs[edge] + vs[edge + 1]) / 2, edge + 1.0, pos[edge].astype(float)
            for at_least, covered, right in ((False, below, hit), (True, n - below, p - hit)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(right > 0, right * (np.log2(right / covered) - np.log2(p / n)), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best, rest = (gain[k], (name, at_least, float(cut[k]))), None
        if best[1] is None:
            break
        tests.append(best[1])
        inside = inside & _meets(x, names, tests[-1:])
    return tests


def _meets(x: np.ndarray, names: list[str], tests: list) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, at_least, cut in tests:
        v = x[:, names.index(name)]
        out &= v >= cut if at_least else v < cut
    return out


def prune(x: np.ndarray, y: np.ndarray, names: list[str], tests: list) -> list:
    """Drop final tests while the share of right rows less wrong ones doesn't fall."""

    def worth(part: list) -> float:
        m = _meets(x, names, part)
        return (2 * y[m].sum() - m.sum()) / m.sum() if m.any() else -1.0

    best = max(range(1, len(tests) + 1), key=lambda k: (worth(tests[:k]), -k))
    return tests[:best]


def learn_decision_list(x: np.ndarray, good: np.ndarray, names: list[str], most_rules: int = 16, precision: float = 0.9, least: int = 5) -> DecisionList:
    """An ordered list of accepting and rejecting rules.

    Rows are dealt to growing and pruning by position, two to one. In each step
    one rule is made for either class; the one that is right more often (by
    Laplace's estimate over all rows left, ties to the larger) is appended, if
    it covers ``least`` rows with the given precision. The default is the class
    of most rows left, accepting on a tie; final rules that say the same go.
    """
    y, left, rules = good.astype(bool), np.ones(len(good), dtype=bool), []
    part = np.arange(len(good)) % 3 == 0
    while len(rules) < most_rules and min(y[left].sum(), (~y)[left].sum()) >= least:
        best: tuple | None = None
        for says in (False, True):
            right, g, v = y == says, left & ~part, left & part
            tests = grow(x[g], right[g], names)
            if tests and v.any():
                tests = prune(x[v], right[v], names, tests)
            covered = left & _meets(x, names, tests)
            n, hits = int(covered.sum()), int(right[covered].sum())
            if tests and n >= least and hits >= precision * n and (best is None or ((hits + 1) / (n + 2), n) > best[:2]):
                best = ((hits + 1) / (n + 2), n, Rule(tuple(tests), says), covered)
        if best is None:
            break
        rules.append(best[2])
        left &= ~best[3]
    default = bool(2 * y[left].sum() >= left.sum())
    while rules and rules[-1].verdict == default:
        rules.pop()
    return DecisionList(tuple(rules), default)


def verdict(learned: DecisionList) -> Column:
    """The list as one conditional expression over the columns of ``text_stats``: the first rule met decides."""
    out = F.lit(learned.default)
    for rule in reversed(learned.rules):
        cond = F.lit(True)
        for name, at_least, cut in rule.tests:
            v = FEATURES[name](F.col)
            cond = cond & ((v >= F.lit(cut)) if at_least else (v < F.lit(cut)))
        out = F.when(cond, F.lit(rule.verdict)).otherwise(out)
    return out


def sampled_labels(labels: DataFrame, label: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids that models may learn from, by hash order; an id labelled twice has its larger label."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    one = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label)).alias("_label"))
    return one.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _label, _t): at most ``most_rows`` labelled documents that are not held out, one row for each id.

    Of rows that repeat an id the text with the smallest hash is taken; a null
    text counts as empty.
    """
    chosen = F.broadcast(sampled_labels(labels, label, most_rows, doc_id))  # its bound is most_rows
    rows = docs.select(F.col(doc_id).alias("_d_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(chosen, F.col("_d_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.max("_label").alias("_label"), F.min_by("_t", F.xxhash64("_t")).alias("_t"))


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> DecisionList:
    """Learn a decision list from at most ``most_rows`` labelled documents, none of them held out."""
    names = list(FEATURES)
    stats = text_stats(labelled_sample(docs, labels, label, most_rows, doc_id, text), ["_id", "_label"], "_t").select("_id", "_label", *[FEATURES[n](F.col).cast("double").alias(n) for n in names])
    rows = sorted(tuple(r) for r in stats.collect())
    if not rows:
        return DecisionList()
    order = np.random.default_rng(0).permutation(len(rows))
    x, y = np.array([r[2:] for r in rows])[order], np.array([r[1] for r in rows])[order]
    return learn_decision_list(x, y > 0, names)


def apply_rules(docs: DataFrame, learned: DecisionList, doc_id: str = "doc_id", text: str = "text", least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base statistics, base_failed, kept.

    Edge cases: null and empty texts have no words, so they fail the base rule;
    null ids and repeated rows are rows like others; an empty table gives no
    rows; other columns are ignored. Without labelled rows the list is empty,
    accepts, and the base rule alone decides.
    """
    stats = text_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), ["doc_id"], "_text")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(learned))
    return out.select("doc_id", *BASE, "base_failed", "kept")


__all__ = ["BASE", "BLANKS", "FEATURES", "DecisionList", "Rule", "apply_rules", "fit_rules", "labelled_sample", "learn_decision_list", "sampled_labels", "text_stats", "verdict"]
