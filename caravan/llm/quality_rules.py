"""Learned quality rules: a decision list of threshold conjunctions over native text statistics.

Sequential covering: a rule grows on two thirds of the labelled rows that no earlier rule covers, by the condition with the
best information gain, and is pruned on the last third to the prefix that separates best. All counting is done by Spark
aggregations; the list ends as ordered conditional expressions. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.columns import filtered
from caravan.llm.shared import materialize, small

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labelled rows that a fit looks at, about: those whose ids have the smallest hashes.
FIT_ROWS = 20_000
#: Thresholds tried for each statistic; conditions of a rule; rules; rows that a rule covers at least; their share of bad
#: rows among rows that no rule grew on, at least.
THRESHOLDS, CONDITIONS, RULES, COVERED, PRECISION = 32, 3, 12, 8, 0.9
#: Bits of a packed number that hold a window's position, as many as any array's positions take; the rest is its hash.
POSITION = 31

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
STATISTICS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "words": "cast(n_words as double)",
}


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that are found twice or more.

    Windows are sorted by a hash with their position in the low bits, so equal ones stand side by side; those whose hash
    repeats are sorted again by their words, which decide.
    """
    low = (1 << POSITION) - 1
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    last = F.size(words) - 3
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    def twins(sorted_values: Column, same) -> Column:
        return F.filter(sorted_values, lambda x, i: F.coalesce(same(x, F.get(sorted_values, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_values, i - 1)), F.lit(False)))

    likely = twins(F.col("_sorted"), lambda x, y: F.shiftright(x, POSITION) == F.shiftright(y, POSITION))
    spelled = F.sort_array(F.transform(F.col("_likely"), lambda x: F.struct(window(x.bitwiseAND(F.lit(low)).cast("int")).alias("w"), x.bitwiseAND(F.lit(low)).alias("p"))))
    real = F.sort_array(F.transform(twins(F.col("_spelled"), lambda x, y: x["w"] == y["w"]), lambda x: x["p"]))
    covered = F.aggregate(F.transform(F.col("_real"), lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("_real"), i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return {"_sorted": F.when(last >= 0, F.sort_array(hashed)).otherwise(F.array().cast("array<bigint>")), "_likely": likely, "_spelled": spelled, "_real": real, "n_repeat_words": covered}


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals (long).

    Words are runs of characters other than ASCII white space; a null text has none. Former columns of these names go. A text
    is worked on whole, as arrays of its words and lines in one row.
    """
    rows = docs.drop(*COLUMNS)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    empty = F.array().cast("array<string>")
    without = lambda chars: (F.length("_text") - F.length(F.translate("_text", chars, ""))).cast("long")
    rows = rows.withColumn("_text", text).withColumn("_words", F.when(trimmed == "", empty).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_symbols": without(SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long"), "n_capitals": without(UPPER),
    })
    for name, value in _repeat_words(F.col("_words")).items():
        rows = rows.withColumn(name, value)
    return rows.drop("_text", "_words", "_lines", "_sorted", "_likely", "_spelled", "_real")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass
class Rule:
    """Conditions (statistic, sign, threshold), all of which must hold; how many bad and good rows it covered when pruned."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    def expression(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            x = F.expr(STATISTICS[name])
            out = out & ((x > F.lit(value)) if sign == ">" else (x <= F.lit(value)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {v:.6g}" for n, s, v in self.conditions)


class DecisionList:
    """Ordered rules; a row is rejected by the first that covers it, else it stays."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def rejecting_rule(self) -> Column:
        """Number of the first rule that covers a row, or null."""
        out = None
        for i, rule in enumerate(self.rules):
            out = F.when(rule.expression(), F.lit(i)) if out is None else out.when(rule.expression(), F.lit(i))
        return F.lit(None).cast("int") if out is None else out


def _gain(bad: float, good: float, all_bad: float, all_good: float) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def _best_condition(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[tuple[str, str, float] | None, float]:
    """The condition of the highest gain over rows: one aggregation counts both classes in every interval of every statistic."""
    above = lambda name: lambda t: t < F.expr(STATISTICS[name])
    interval = [F.struct(F.lit(n).alias("n"), F.size(F.filter(F.array(*map(F.lit, b)), above(n))).alias("k")) for n, b in bounds.items()]
    place = F.explode(F.array(*interval))
    counts: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in bounds}
    for x in rows.select(place.alias("c"), "bad").groupBy("c.n", "c.k").agg(F.sum("bad").alias("b"), F.count("*").alias("m")).collect():
        counts[x["n"]][x["k"]] = x["b"], x["m"] - x["b"]
    best, score = None, 1e-9
    for name, found in sorted(counts.items()):
        all_bad, all_good = (sum(v[i] for v in found.values()) for i in (0, 1))
        below = [0, 0]
        for k, value in enumerate(bounds[name]):  # interval k holds what is at most bounds[k] and over bounds[k - 1]
            below = [below[i] + found.get(k, (0, 0))[i] for i in (0, 1)]
            for sign, (b, g) in (("<=", below), (">", (all_bad - below[0], all_good - below[1]))):
                if b >= COVERED and (gain := _gain(b, g, all_bad, all_good)) > score:
                    best, score = (name, sign, value), gain
    return best, score


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learn a list that rejects what labels(doc_id, quality) call 0 and keeps what they call 1.

    The fit looks at about fit_rows labelled documents, those whose ids have the smallest hashes; statistics of these alone are
    computed and written. Labels without a document, or null, are left out; repeated ones count as often as they come. Rows
    that the base rule rejects teach nothing. Without rows of both kinds the list is empty.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad")).dropna()
    total = known.count()
    share = min(1.0, fit_rows / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(chosen, chosen.count() * 16), "doc_id")
    rows = materialize(with_statistics(rows).drop("text"), "fit").where(~base_failed())
    rows = rows.withColumn("grow", F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0)
    grid = rows.agg(*(F.percentile_approx(F.expr(e), [i / THRESHOLDS for i in range(THRESHOLDS)], 10_000).alias(n) for n, e in STATISTICS.items())).first()
    if grid["words"] is None:
        return DecisionList([])
    bounds = {n: sorted(set(grid[n])) for n in STATISTICS}
    rules: list[Rule] = []
    while len(rules) < RULES:
        left = rows.where(F.col("bad").isNotNull())
        for rule in rules:
            left = left.where(~rule.expression())
        rule = Rule()
        while len(rule.conditions) < CONDITIONS:
            condition, _ = _best_condition(left.where(F.col("grow") & rule.expression()), bounds)
            if condition is None or condition in rule.conditions:
                break
            rule.conditions.append(condition)
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[:i]) for i in range(1, len(rule.conditions) + 1)]
        counted = left.where(~F.col("grow")).agg(*(f(F.when(p.expression(), x)).alias(f"{k}{i}") for i, p in enumerate(prefixes) for k, f, x in (("b", F.sum, F.col("bad")), ("n", F.count, F.lit(1))))).first()
        for i, p in enumerate(prefixes):
            p.bad, p.good = counted[f"b{i}"] or 0, counted[f"n{i}"] - (counted[f"b{i}"] or 0)
        best = max(prefixes, key=lambda p: ((p.bad - p.good) / max(1, p.bad + p.good), p.bad, -len(p.conditions)))
        if best.bad < max(1, COVERED // 4) or best.bad < PRECISION * (best.bad + best.good):
            break
        rules.append(best)
    return DecisionList(rules)


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs(text, ...) that are kept, with their own columns."""

    def kept(rows: DataFrame) -> DataFrame:
        # a filter on a row number stays above it, and so above the statistics: below, each use of one would compute it anew
        judged = judge(rows, rules).withColumn("_row", F.monotonically_increasing_id())
        return judged.where(F.col("kept") & (F.col("_row") >= 0))

    return filtered(docs, [*COLUMNS, "base_failed", "rule", "kept", "_row"], kept)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs(text, ...) with its statistics, base_failed, rule (number of the rejecting rule, or null) and kept.

    Rows are judged where they are: no shuffle, no row is dropped. Null, empty and wordless texts fail the base rule; texts of any
    length are judged whole. Empty tables give empty results.
    """
    rows = with_statistics(docs.drop("base_failed", "rule", "kept")).withColumn("base_failed", base_failed())
    return rows.withColumn("rule", rules.rejecting_rule()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
