"""Quality rules (operator 5): a learned decision list.

Sequential covering over labelled statistics: a rule is a conjunction of
thresholds that holds on unwanted documents.  Growing adds the threshold
with the best information gain on the growing rows until no wanted row is
covered; pruning drops conditions from the end as long as the worth on the
pruning rows does not fall; a rule that is not precise enough there ends the
list.  Covered rows leave and the next rule is learned.  The list is emitted
as one ordered Spark conditional expression (``F.when(...).when(...)``) that
any DataFrame with the counts can evaluate.

Cases: null text has no words; an empty table gives no rows; without both
labels the list is empty and keeps all that the base rules keep; ties between
thresholds go to the first statistic and the smallest threshold; repeated
rows are judged each; very long texts are counted whole.  Only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .staging import apart, staged

BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rates(counts: str = "") -> dict[str, Column]:
    """The interpretable statistics that conditions are made of; ``counts``
    names the struct column that holds the counts (empty: plain columns)."""
    of = lambda name: F.col(f"{counts}.{name}" if counts else name)
    per = lambda name, base: of(name) / F.greatest(of(base), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "next_word_repeat_share": per("n_repeat_next", "n_words"),
        "capital_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "bars_per_word": per("n_bars", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "distinct_word_share": per("n_distinct_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.statistic]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, statistics: dict[str, Column]) -> Column:
        c = statistics[self.statistic]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _best_condition(table, bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold with the largest information gain for the covered rows.
    Thresholds lie midway between neighbouring values."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    start = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name, all_values in table.items():
        values, is_bad = all_values[inside], bad[inside]
        order = np.argsort(values, kind="stable")
        values, is_bad = values[order], is_bad[order]
        ends = np.flatnonzero(values[1:] > values[:-1])
        if not len(ends):
            continue
        p_low, seen = np.cumsum(is_bad)[ends].astype(float), ends + 1.0
        for above, p, m in ((False, p_low, seen), (True, p0 - p_low, len(values) - seen)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / m) - start), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best = gain[k]
                found = Condition(name, above, float((values[ends[k]] + values[ends[k] + 1]) / 2))
    return found


def learn(table: dict[str, np.ndarray], bad: np.ndarray, prune_row: np.ndarray, min_precision: float = 0.9,
          min_covered: int = 5, max_conditions: int = 6) -> list[Rule]:
    """The ordered rules for unwanted rows."""
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while True:
        grow, prune = left & ~prune_row, left & prune_row
        if (bad & grow).sum() < min_covered or not (~bad).any():
            return rules
        rule: list[Condition] = []
        inside = grow.copy()
        while (~bad & inside).any() and len(rule) < max_conditions:
            condition = _best_condition(table, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(table)

        def worth(r):
            c = covers(tuple(r), table, len(bad)) & prune
            return ((bad & c).sum() - (~bad & c).sum()) / max(1, c.sum()), (bad & c).sum()

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            return rules
        hit = covers(tuple(rule), table, len(bad)) & left
        if (bad & hit).sum() < min_covered or (bad & hit).sum() < min_precision * hit.sum():
            return rules
        rules.append(tuple(rule))
        left &= ~hit


def fit(rows: DataFrame, sample_rows: int = 50_000, **params) -> list[Rule]:
    """Learn from labelled rows (id, label, statistics).  At most about
    ``sample_rows`` of them, chosen by a hash of the id, come to the driver:
    a documented bound on the fit alone (a millionth of them, where that is more).  Every third is for pruning."""
    names = list(rates())
    rows = staged(rows, "rule-rows")
    total = rows.count()
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_000))
    if total > sample_rows:
        rows = rows.where(place < max(1, int(1_000_000 * sample_rows / total)))
    data = rows.select(F.col("label"), (F.pmod(F.xxhash64(F.col("id"), F.lit("prune")), F.lit(3)) == 0).alias("prune"),
                       F.col("id").cast("string").alias("id"), *(F.col(c) for c in names)).toPandas()
    data = data.sort_values(["id", *names], kind="stable")
    table = {c: data[c].to_numpy(float) for c in names}
    return learn(table, data["label"].to_numpy() == 0, data["prune"].to_numpy(bool), **params)


def decision_list(rules: list[Rule], statistics: dict[str, Column] | None = None) -> Column:
    """The rules as one ordered conditional expression: the number of the
    first rule that holds (1, 2, ...), or 0.  ``statistics``: the expression
    of each statistic; without it, columns of those names."""
    statistics = statistics or {name: F.col(name) for name in rates()}
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column(statistics)
        for c in rule[1:]:
            condition = condition & c.column(statistics)
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(counts: str = "", min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    of = lambda name: F.col(f"{counts}.{name}" if counts else name)
    return (of("n_words") < min_words) | (F.lit(100) * of("n_repeat_words") > F.lit(max_repeat_percent) * of("n_words"))


def fitted(counted: DataFrame, labels: DataFrame, id_col: str, label_col: str, **params) -> list[Rule]:
    """The rules learned from a table of counts and the labels."""
    known = stats.agreed_labels(labels, id_col, label_col)
    return fit(counted.select("id", *(e.alias(k) for k, e in rates().items())).join(known, "id"), **params)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", **params) -> DataFrame:
    """Per row of ``docs``: id, the counts, base_failed, rule (number of the
    first learned rule that rejects it, 0: none) and kept."""
    counted = staged(stats.count_table(docs, id_col, text_col), "rule-stats")
    rules = fitted(counted, labels, id_col, label_col, **params)
    return counted.select(F.col("id").alias(id_col), *stats.COUNTS, base_failed().alias("base_failed"),
                          decision_list(rules, rates()).alias("rule")) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.  The
    texts are read twice (to learn, to judge) and never shuffled."""
    rules = fitted(stats.count_table(docs, id_col, text_col), labels, id_col, label_col, **params)
    (name,) = apart(docs.columns, "counts")
    judged = stats.with_counts(docs, name, text_col)
    return judged.where(~base_failed(name) & (decision_list(rules, rates(name)) == 0)).drop(name)
