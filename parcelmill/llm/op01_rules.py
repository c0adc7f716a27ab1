"""Quality rules as a learned decision list, in DataFrame operations only.

Every document gets counts (words, symbols, repeated lines, words in repeated windows ...) and from
them ratios.  Sequential covering learns, from labelled documents, an ordered list of rules that
reject; each is a conjunction of thresholds on ratios:

* *grow* on two thirds of the labelled rows: of all features, thresholds and directions take the one
  with the best FOIL gain, until the rule rejects no good document or nothing gains;
* *prune* on the last third: drop the last conditions as long as precision there doesn't fall;
* keep the rule if it is precise enough, take what it covers out, and begin again.

The learner sees label statistics only: a histogram by feature, bin and label for each step, made by
one aggregation in the cluster (map-side sums; at most features * bins rows reach the driver).
Thresholds lie half-way between neighbours among the quantiles of either class.  All labelled rows count, at every size.  The list is
emitted as one conditional expression.

Edge cases: null and empty texts have no words and fail the base rule; ratios of nothing are 0;
null labels and labels of unknown documents are left out; several labels of a document count
each; with no labels, or only one kind, the list is empty and the base rule decides alone;
repeated rows get equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, with_key
from .op07_winnow import let, upto

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
QUANTILES = 24
MAX_RULES = 10
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "long": ("n_words", None),
}


def repeated(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that are found twice or more in the text."""

    def places(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(twin(x, j), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def spread(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(order, places),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["sum"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("sum")),
            lambda a: a["sum"],
        )

    # Two independent 32-bit halves would not do; 64 bits tell a text's windows apart.
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(upto(F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spread(h)))


def stats(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text")
    counted = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    base = docs.select(
        *keep,
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        counted(r"[#*$%&|<>]+").alias("n_symbols"),
        counted(r"\p{Lu}+").alias("n_upper"),
        counted(r"[0-9]+").alias("n_digits"),
        counted(r"[!?]+").alias("n_marks"),
    )
    whole = ("n_symbols", "n_upper", "n_digits", "n_marks")
    out = base.select(*keep, *(F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")), *(F.col(f"l.{c}").cast("long").alias(c) for c in ("n_lines", "n_dup_lines")), *(F.col(c).cast("long").alias(c) for c in whole))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false where a rule fires, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(holds(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    shares = F.array(*(F.lit((k + 0.5) / QUANTILES) for k in range(QUANTILES)))
    edge = rows.groupBy("bad").agg(*(F.percentile_approx(feature(f), shares, 1000).alias(f) for f in FEATURES)).collect()  # two rows
    values = {f: sorted({float(x) for r in edge for x in (r[f] or [])}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """By feature and bin: bad and good rows.  Bin k holds values over k thresholds."""
    below = lambda f: F.filter(F.array(*(F.lit(t) for t in cuts[f])), lambda t: t < feature(f))
    bins = [F.struct(F.lit(f).alias("f"), F.size(below(f)).alias("b")) for f in FEATURES]
    made = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
    for r in made.collect():  # features * bins at most
        out[r.f][r.b] = [r.p, r.n]
    return out


def _best(histogram: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    total = histogram[next(iter(FEATURES))]
    p0, n0 = sum(x[0] for x in total), sum(x[1] for x in total)
    best: tuple[float, Condition | None, int, int] = (0.0, None, p0, n0)
    if not p0:
        return best
    before = math.log2((p0 + 0.5) / (p0 + n0 + 1))
    for f in FEATURES:
        low_p = low_n = 0
        for k, t in enumerate(cuts[f]):
            low_p, low_n = low_p + histogram[f][k][0], low_n + histogram[f][k][1]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                if p and n < n0:
                    gain = p * (math.log2((p + 0.5) / (p + n + 1)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, t), p, n)
    return best


def learn(rows: DataFrame, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules from labelled statistics: ``rows`` has the counts, ``bad`` (0/1) and ``part`` (0, 1: grow, 2: prune)."""
    cuts = _thresholds(rows)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = rows.where(verdict(rules))
        grow, rule = left.where("part < 2"), ()
        while len(rule) < MAX_CONDITIONS:
            _, c, p, n = _best(_histogram(grow.where(holds(rule)), cuts), cuts)
            if c is None:
                break
            rule += (c,)
            if not n:
                break
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            on = holds(rule[:k])
            sums += [F.count_if(on & (F.col("bad") == 1)).alias(f"p{k}"), F.count_if(on & (F.col("bad") == 0)).alias(f"n{k}")]
        got = left.where("part = 2").agg(*sums).first()
        precision = [(got[f"p{k}"] + 1) / (got[f"p{k}"] + got[f"n{k}"] + 2) for k in range(1, len(rule) + 1)]
        size = max(range(len(rule)), key=lambda k: (precision[k], -k)) + 1
        p, n = got[f"p{size}"], got[f"n{size}"]
        if not p or p < min_precision * (p + n):
            break
        rules.append(rule[:size])
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict and the learned verdict for every document."""
    found = cut(stats(with_key(docs), "doc_id"))
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    rules = learn(cut(found.join(known, F.col("doc_id") == F.col("id")).withColumn("part", part)))
    kept = ~F.col("base_failed") & verdict(rules)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.lit("; ".join(" and ".join(map(str, r)) for r in rules)).alias("rules"))


def op1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
