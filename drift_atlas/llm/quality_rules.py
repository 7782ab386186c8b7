"""Quality rules: native text statistics and a learned decision list.

``text_statistics`` computes every statistic inside the row with built-in array
functions: nothing is exploded, so nothing is shuffled and a long text costs its
own length only. ``learn_rules`` grows threshold conjunctions by sequential
covering on a bounded labelled sample, prunes each on rows it was not grown on,
and ``verdict`` turns the list into one ordered CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import common

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Labelled rows, chosen by the smallest hash of their id, on which the list is learned.
SAMPLE_ROWS = 20_000

#: What the rules may test, as expressions over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(windows: Column) -> Column:
    """Words that lie in windows whose hash occurs more than once, given the hashes in text order."""
    def among(ordered: Column) -> Column:
        twin = lambda k, h: F.get(ordered, k)["h"].eqNullSafe(h)
        starts = F.array_sort(F.transform(F.filter(ordered, lambda s, k: twin(k - 1, s["h"]) | twin(k + 1, s["h"])), lambda s: s["at"]))
        nothing = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
        step = lambda a, at: F.struct(at.alias("last"), (a["words"] + F.least(F.lit(WINDOW), at - a["last"])).alias("words"))
        return F.aggregate(starts, nothing, step, lambda a: a["words"])

    located = F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    repeated = _let(F.array_sort(located), among)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeated)


def _repeat_words(hashes: Column) -> Column:
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(_let(windows, _covered))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every whole text; null counts as empty, and then all are 0.

    Words are runs of characters other than U+0020 and U+0009-U+000D. Lines are
    split at ``\\n``; an empty text has one line and no line with a word. Repeated
    rows and ids are each treated alone; further columns are ignored.

    Columns: the id, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` as the contract has them, and ``n_lines`` (with a word),
    ``n_capitals``, ``n_distinct_words`` for the rules; all long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("__t"))
    words = F.array_remove(F.split("__t", common.SPACE_CLASS + "+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split("__t", "\n"), lambda line: F.length(F.btrim(line, F.lit(common.SPACE_CHARS))) > 0)

    def of_words(h: Column) -> Column:
        return F.struct(F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct"), _repeat_words(h).alias("repeat"))

    def of_lines(a: Column) -> Column:
        return F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))

    measured = base.select(
        id_col,
        _let(hashes, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(_without(F.col("__t"), common.SPACE_CHARS)).alias("chars"),
        (F.octet_length("__t") - F.octet_length(_without(F.col("__t"), SYMBOLS))).alias("symbols"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).alias("capitals"),
    )
    picked = {"n_words": "w.n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeat", "n_lines": "l.n", "n_capitals": "capitals", "n_distinct_words": "w.distinct"}
    return measured.select(id_col, *[F.col(v).cast("long").alias(k) for k, v in picked.items()])


def keep_good_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **learning) -> DataFrame:
    """The rows of ``docs`` that the base check and the learned rules keep, with all their columns.

    Every row is judged as it passes, so no row meets its verdict in a join.
    """
    rules = learn_rules(labelled_rows(docs, labels, id_col, text_col, label_col, sample_rows), **learning)
    stats = text_statistics(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("__text")), "row", "__text")
    # A filter is not moved below a column that isn't deterministic; moved, it would compute the statistics once for each use.
    stats = stats.withColumn("place", F.monotonically_increasing_id())
    return stats.where(~base_failed(stats) & verdict(rules) & (F.col("place") >= 0)).select("row.*")


def base_failed(stats: DataFrame) -> Column:
    """Too few words, or too large a share of them in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _matches(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(table)
    return hit


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, steps: int, longest: int) -> Rule:
    """Add the condition of the best information gain until only bad rows are left."""
    rule: Rule = ()
    hit = np.ones(len(bad), bool)
    while len(rule) < longest and hit.any() and not bad[hit].all():
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, x in table.items():
            for cut in np.unique(np.quantile(x[hit], np.linspace(0, 1, steps))):
                low = x <= cut
                for above, inside in ((True, hit & ~low), (False, hit & low)):
                    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (float(gain), Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        hit &= best[1].holds(table)
    return rule


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Smoothed precision and coverage of bad rows."""
    hit = _matches(rule, table, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p + 1) / (p + n + 2), p


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, precision: float) -> Rule:
    """The shortest beginning that still reaches the precision on held-out rows, else the most precise one."""
    tried = [(rule[:k], *_worth(rule[:k], table, bad)) for k in range(1, len(rule) + 1)]
    fit = [t for t in tried if t[1] >= precision]
    return max(fit, key=lambda t: (t[2], -len(t[0])))[0] if fit else max(tried, key=lambda t: t[1])[0]


def learn_rules(rows: list[tuple[bool, dict[str, float]]], precision: float = 0.9, least_cover: int = 3, most_rules: int = 24, longest: int = 4, steps: int = 48) -> list[Rule]:
    """Sequential covering of the bad rows. ``rows`` holds (is bad, features); every third row is kept for pruning."""
    if not rows:
        return []
    bad = np.array([b for b, _ in rows], bool)
    table = {k: np.array([float(f[k]) for _, f in rows]) for k in FEATURES}
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (bad & left & ~held).sum() >= least_cover:
        grow, check = left & ~held, left & held
        at = lambda m: {k: x[m] for k, x in table.items()}
        rule = _grow(at(grow), bad[grow], steps, longest)
        if not rule:
            break
        rule = _prune(rule, at(check), bad[check], precision)
        hit = _matches(rule, table, len(bad)) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < least_cover or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule fires: an ordered CASE over the statistics."""
    if not rules:
        return F.lit(True)
    case = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
    return case.otherwise(F.lit(True))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> list[tuple[bool, dict[str, float]]]:
    """Features of the labelled sample; its size is bounded, so it may be broadcast and collected."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    keyed = picked.select(F.struct("__id", "__label").alias("key"), "__text")
    stats = text_statistics(keyed, "key", "__text")
    # The base check is a column, not a filter: pushed below the statistics it would compute them twice.
    measured = stats.select("key.__id", (F.col("key.__label") == 0).alias("bad"), base_failed(stats).alias("failed"), *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()])
    out = [r for r in measured.collect() if not r["failed"]]
    out.sort(key=lambda r: tuple(r[k] for k in FEATURES))
    return [(r["bad"], {k: r[k] for k in FEATURES}) for r in out]


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **learning) -> DataFrame:
    """Statistics of every document with the base check and the learned verdict.

    Labels of 0 mark bad documents; of several labels of a document the smallest
    counts, null labels and labels without a document count for nothing. Without
    labels only the base check rejects. See ``text_statistics`` for nulls, empty
    texts and repeated rows.

    Columns: the id, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``, ``base_failed``, ``kept``, then the further statistics.
    """
    rules = learn_rules(labelled_rows(docs, labels, id_col, text_col, label_col, sample_rows), **learning)
    stats = text_statistics(docs, id_col, text_col)
    failed = base_failed(stats)
    return stats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
        "n_lines", "n_capitals", "n_distinct_words",
    )
