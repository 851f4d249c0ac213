"""Quality rules: a learned decision list of threshold conjunctions, as Spark expressions."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.storage import materialize

#: Fixed value: a word is a run of anything but space and the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_lines", "repeat_share"]


class Condition(NamedTuple):
    feature: str
    above: bool  # else at most
    threshold: float

    def expression(self, f: Column) -> Column:
        c = f[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


class Rule(NamedTuple):
    """All conditions hold: the document is rejected."""

    conditions: tuple[Condition, ...]
    rejected: int
    of: int

    def expression(self, f: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expression(f)
        return out


def let(value: Column, body) -> Column:
    """``body`` of the value. Bound as a lambda's variable, the value is computed once, whatever
    the optimizer does with projections and predicates around it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Puts equal windows side by side; it need not tell all others apart.
window_hash = F.xxhash64


def repeated(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more.

    Windows are sorted by a hash of their words and by place; one whose neighbour in that order has
    an equal hash is repeated. If two neighbours of equal hash differ in their words, which nearly
    never happens, the text's windows are sorted by the words as well. Each repeated place covers as
    many words as there are to the next one, at most 3.
    """

    def windows(w: Column, exact: bool) -> Column:
        def one(i: Column) -> Column:
            three = [F.get(w, i + k) for k in range(3)]
            return F.struct(window_hash(*three).alias("h"), *([x.alias(f"w{k}") for k, x in enumerate(three)] if exact else []), i.alias("at"))

        return F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), one)))

    def twice(s: Column, keys: list[str]) -> Column:
        same = lambda x, y: F.coalesce(functools.reduce(Column.__and__, [x[k] == y[k] for k in keys]), F.lit(False))
        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def clash(t: Column, w: Column) -> Column:
        def differ(x: Column, k: Column) -> Column:
            y = F.get(t, k + 1)
            return F.coalesce(x["h"] == y["h"], F.lit(False)) & functools.reduce(Column.__or__, [F.get(w, x["at"] + n) != F.get(w, y["at"] + n) for n in range(3)])

        return F.size(F.filter(t, differ)) > 0

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))
        return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    places = lambda t: F.sort_array(F.transform(t, lambda x: x["at"]))
    exact = lambda w: let(windows(w, True), lambda s: places(twice(s, ["h", "w0", "w1", "w2"])))
    found = lambda w: let(windows(w, False), lambda s: let(twice(s, ["h"]), lambda t: F.when(clash(t, w), exact(w)).otherwise(places(t))))
    return let(found(words), covered)


def counts(text: Column) -> Column:
    """The five counts of a whole text as a struct, in DataFrame functions only."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            repeated(w).alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), of)


def features(c: Column) -> Column:
    """The counts and what rules may test."""
    words = F.greatest(c["n_words"], F.lit(1)).cast("double")
    return F.struct(
        *[c[n].alias(n) for n in COUNTS],
        (c["word_chars"] / words).alias("mean_word"),
        (c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1)).cast("double")).alias("symbol_share"),
        c["n_dup_lines"].cast("double").alias("dup_lines"),
        (c["n_repeat_words"] / words).alias("repeat_share"),
        ((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])).alias("base_failed"),
    )


def first_rule(f: Column, rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, from 1; 0 if none does."""
    chain = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(rule.expression(f), k).otherwise(chain)
    return chain


def kept(text: Column, rules: list[Rule]) -> Column:
    """Whether the base rules and the learned list keep a text; null counts as empty."""
    return let(counts(F.coalesce(text, F.lit(""))), lambda c: let(features(c), lambda f: ~f["base_failed"] & (first_rule(f, rules) == 0)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = 20_000,
    bins: int = 12,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_share: float = 0.002,
) -> list[Rule]:
    """Sequential covering over labelled documents that the base rules keep (label 0: reject).

    At most ``max_docs`` labelled documents, chosen by a hash of the id, are counted in a grid of
    quantile cells (``bins`` a feature over all and over the rejected); the driver gets the
    non-empty cells. Each rule grows on two thirds of the counts, condition by condition, by the
    rejected documents it covers times the gain in precision; it is pruned on the other third by
    dropping last conditions while that does not hurt; and it stays if its precision is at least
    ``min_precision``.
    """
    held = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    chosen = held.orderBy(F.xxhash64(F.lit("quality"), id_col), id_col).limit(max_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    fold = (F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(3)) == 0).cast("int").alias("fold")
    known = materialize(known.select("label", fold, let(counts(text), features).alias("f")).select("label", "fold", "f.*"), "quality-sample")
    return cover(known.where(~F.col("base_failed")), bins, max_rules, max_conditions, min_precision, min_share)


def cover(known: DataFrame, bins: int, max_rules: int, max_conditions: int, min_precision: float, min_share: float) -> list[Rule]:
    cuts: dict[str, list[float]] = {}
    for f, some, more in zip(FEATURES, known.approxQuantile(FEATURES, [k / bins for k in range(1, bins)], 0.005), known.where("label = 0").approxQuantile(FEATURES, [k / bins for k in range(1, bins)], 0.005)):
        cuts[f] = sorted({*some, *more})
    cell = [sum((F.col(f) > c).cast("int") for c in cuts[f]) + F.lit(0) for f in FEATURES]
    cell = [c.alias(f) for c, f in zip(cell, FEATURES)]
    cells = known.select("label", "fold", *cell).groupBy("label", "fold", *FEATURES).count().collect()  # at most max_docs rows
    at = np.array([[r[f] for f in FEATURES] for r in cells], dtype=np.int64).reshape(len(cells), len(FEATURES))
    weight = np.array([r["count"] for r in cells], dtype=np.int64)
    bad = weight * np.array([r["label"] == 0 for r in cells], dtype=np.int64)
    grown = np.array([r["fold"] == 0 for r in cells], dtype=bool)
    total = int(weight.sum())
    left = np.ones(len(cells), dtype=bool)

    def inside(conditions: list[tuple]) -> np.ndarray:
        """Cells, of those that no rule covers yet, where all conditions hold."""
        held = left.copy()
        for f, above, c in conditions:
            held &= (at[:, f] > c) == above
        return held

    def best_next(held: np.ndarray) -> tuple | None:
        """The condition of the highest gain: rejected documents it covers, times the rise in precision."""
        bad0, all0 = int(bad[held].sum()), int(weight[held].sum())
        best, gain = None, 0.0
        if not bad0 or bad0 == all0:
            return None
        for f, name in enumerate(FEATURES):
            low_bad = np.bincount(at[held, f], weights=bad[held], minlength=len(cuts[name]) + 1).cumsum()
            low_all = np.bincount(at[held, f], weights=weight[held], minlength=len(cuts[name]) + 1).cumsum()
            for c in range(len(cuts[name])):
                for above in (True, False):
                    b, n = (bad0 - low_bad[c], all0 - low_all[c]) if above else (low_bad[c], low_all[c])
                    if b and n >= min_share * total * 2 / 3 and (g := b * ((b + 0.1) / (n + 0.2) - bad0 / all0)) > gain:
                        best, gain = (f, above, c), g
        return best

    def precision(conditions: list[tuple]) -> float:
        """On the third that rules are pruned on."""
        held = inside(conditions) & ~grown
        return (bad[held].sum() + 0.5) / (weight[held].sum() + 1) if held.any() else 0.0

    rules: list[Rule] = []
    while len(rules) < max_rules:
        chosen: list[tuple] = []
        while len(chosen) < max_conditions and (o := best_next(inside(chosen) & grown)) is not None:
            chosen.append(o)
        while len(chosen) > 1 and precision(chosen[:-1]) >= precision(chosen):
            chosen.pop()
        held = inside(chosen)
        b, n = int(bad[held].sum()), int(weight[held].sum())
        if not chosen or not n or b / n < min_precision or precision(chosen) < min_precision - 0.03:
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][c]) for f, above, c in chosen), b, n))
        left &= ~held
    return rules


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the five counts, base_failed, rule (the first that rejects, from 1; 0: none) and kept of every document.

    Null texts have no words and fail the base rules, as empty ones do. Without labels there are no
    learned rules. Repeated rows are judged one by one, an empty table gives no rows, and other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    f = F.col("f")
    judged = docs.select(F.col(id_col), let(counts(text), features).alias("f")).select(id_col, "f", first_rule(f, rules).alias("rule"))
    return judged.select(id_col, *[f[n].alias(n) for n in (*COUNTS, "base_failed")], "rule", (~f["base_failed"] & (F.col("rule") == 0)).alias("kept"))
