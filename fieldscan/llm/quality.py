"""Quality rules with risk-controlled thresholds.

Base rules have fixed limits. Four further rules have a cutoff per stratum (language), chosen from
labelled documents: a cutoff may be used only if the exact (Clopper-Pearson) upper bound on the
share of good documents it rejects stays below a limit. The error probability is divided among all
cutoffs, rules and strata examined (Bonferroni), so all bounds hold together and the choice among
certified cutoffs is free: the one that separates best, the most lenient among equals.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_batches, stored

#: Rules with a cutoff: a document is rejected when its value is above it.
RULES = ("symbol_share", "upper_share", "echo_share", "line_share")
#: Cutoffs examined for every rule.
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
#: Largest share of good documents that one rule may reject in a stratum, at this joint confidence.
RISK, CONFIDENCE = 0.02, 0.95
#: A good document rejected costs so many bad ones passed.
COST = 10.0

STATS = ("doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, symbol_share double, upper_share double, echo_share double, line_share double")
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SPACES = re.compile(r"[\x20\x09-\x0D]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the text.

    Hashes of windows are sorted first; only a text with an equal pair is counted window by window.
    """
    if len(words) < 6:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = h[:-4].copy()
    for k in range(1, 5):
        mixed = mixed * MIX + (h[k:len(h) - 4 + k] ^ (mixed >> np.uint64(29)))
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    found = Counter(windows)
    hit = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(5):
        covered[k:k + len(hit)] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the values of RULES) of one text."""
    if not text:
        return (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - len(SPACES.findall(text))
    symbols = len(SYMBOLS.findall(text))
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    return (n, chars, symbols, repeated, repeat_words(words), symbols / max(n, 1), len(UPPER.findall(text)) / max(chars, 1),
            echoes / max(n, 1), repeated / max(lines, 1))


def stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base statistics and rule values of every whole text; the columns of ``STATS``."""
    def batch(rows: Columns) -> Columns:
        found = list(zip(*map(text_stats, rows["text"]), strict=True))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES)
        return {"doc_id": rows["doc_id"], "stratum": rows["stratum"], **dict(zip(names, found, strict=True))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                                   F.col("text").cast("string").alias("text")), STATS, batch)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def upper_bound(failures: int, trials: int, error: float) -> float:
    """Exact binomial upper bound: the largest rate at which so few failures still have probability ``error``."""
    if failures >= trials:
        return 1.0
    ways = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) for i in range(failures + 1)]
    low, high = failures / trials, 1.0
    for _ in range(60):
        rate = (low + high) / 2
        if rate <= 0 or rate >= 1:
            break
        below = sum(math.exp(w + i * math.log(rate) + (trials - i) * math.log1p(-rate)) for i, w in enumerate(ways))
        low, high = (rate, high) if below > error else (low, rate)
    return high


def certified(good: list[int], bad: list[int], tests: int, risk: float = RISK, confidence: float = CONFIDENCE) -> float | None:
    """The cutoff for one rule and stratum, or None if none is certified.

    ``good[b]``, ``bad[b]``: documents above exactly the first ``b`` cutoffs of the grid.
    """
    trials, best, chosen = sum(good), 0.0, None
    for b in range(len(GRID), 0, -1):
        lost, caught = sum(good[b:]), sum(bad[b:])
        if trials and lost <= risk * trials and upper_bound(lost, trials, (1 - confidence) / tests) <= risk:
            gain = caught - COST * lost
            if gain > best:
                best, chosen = gain, GRID[b - 1]
    return chosen


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, a cutoff per rule or null) from labelled documents that pass the base rules.

    Counts per (stratum, rule, grid cell) combine before the shuffle; only they, never documents,
    meet in a task. A document labelled more than once counts once, as good if any label says so.
    """
    truth = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.max("quality").alias("quality"))
    known = found.filter(~base_failed()).join(truth, "doc_id")
    cell = {r: sum([(F.col(r) > g).cast("int") for g in GRID[1:]], (F.col(r) > GRID[0]).cast("int")) for r in RULES}
    cells = known.select("stratum", "quality", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), cell[r].alias("cell")) for r in RULES])).alias("c"))
    counted = cells.groupBy("stratum", "c.rule", "c.cell").agg(
        F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    counted = stored(counted, "quality-counts")
    tests = max(1, counted.select("stratum").distinct().count()) * len(RULES) * len(GRID)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"stratum": [group["stratum"].iloc[0]]}
        for rule in RULES:
            good, bad = [0] * (len(GRID) + 1), [0] * (len(GRID) + 1)
            for c, g, b in group.loc[group["rule"] == rule, ["cell", "good", "bad"]].itertuples(index=False):
                good[c], bad[c] = int(g), int(b)
            row[f"cut_{rule}"] = [certified(good, bad, tests, risk, confidence)]
        return pd.DataFrame(row).astype({f"cut_{r}": "float64" for r in RULES})

    schema = "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)
    return counted.groupBy("stratum").applyInPandas(choose, schema)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK,
          confidence: float = CONFIDENCE) -> DataFrame:
    """Statistics and verdict of every document.

    One row per input row. Null and empty texts have zero counts and fail the base rules. A stratum
    without enough labels, or a null stratum without labels, has no cutoff and rejects nothing
    beyond the base rules. Repeated rows are judged alike; an empty table gives no rows.
    """
    found = stored(stats(docs, stratum), "quality-stats")
    limits = stored(cutoffs(found, labels, risk, confidence), "quality-cutoffs").withColumnRenamed("stratum", "of_stratum")
    few = F.broadcast(limits) if limits.count() < 100_000 else limits
    joined = found.join(few, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    above = F.lit(False)
    for rule in RULES:
        cut = F.col(f"cut_{rule}")
        above = above | (cut.isNotNull() & ~F.isnan(cut) & (F.col(rule) > cut))
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & ~above).alias("kept"), *RULES)
