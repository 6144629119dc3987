"""Quality rules with risk-controlled thresholds.

Base counts of every text come from one pass. Each further rule rejects a document if one of its statistics exceeds a
cutoff; what follows is about documents that pass the base rules, which are given. Labelled rows are dealt to two halves by a hash of their id. In each stratum (language) one half proposes: for each of ``LEVELS``
growing budgets of false rejections every rule takes its lowest cutoff within its share of the budget, if that rejects more of the bad documents
than of the good ones. The other half, the holdout, certifies: going from the smallest budget up, a level holds while the exact binomial
(Clopper-Pearson) upper bound of the good documents that any of its rules rejects stays within ``ALPHA``. Levels are nested and tested in a
fixed order, so neither they nor the rules need a correction; over strata the error ``DELTA`` is divided (Bonferroni). Of the certified
levels the one that rejects most bad documents beyond its false rejections is taken; without one, the stratum has no further rules.

Defined cases: null texts count as empty and fail the base rules; a null language is a stratum of its own; labels that are null
or contradict each other are ignored; without labels only the base rules decide; repeated rows give one row each.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import map_batches, query, table
from sightlog.session import materialise

SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
WINDOW = 8
#: Statistics on a scale from 0 to 1; the grid has BINS cutoffs.
RULES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "long_word_share")
BINS = 64
ALPHA, DELTA, LEVELS = 0.03, 0.05, 16
#: A stratum's cutoffs are some 500 bytes: at most 5 MB are sent to the tasks.
BROADCAST_STRATA = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def counts(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the further shares of one text."""
    words = text.encode().split()  # cuts at ASCII white space only
    n = len(words)
    bare = BLANKS.sub("", text)
    n_symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split("\n") if BLANKS.sub("", line)]
    n_dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    upper = sum(map(str.isupper, bare))
    marks = bare.count("!") + bare.count("?")
    long = sum(len(w) > 24 for w in words)
    chars = max(len(bare), 1)
    shares = [n_symbols / chars, repeated / max(n, 1), n_dup / max(len(lines), 1), upper / chars, marks / chars, long / max(n, 1)]
    return n, len(bare), n_symbols, n_dup, repeated, [min(s, 1.0) for s in shares]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, the first occurrence included."""
    total = len(words) - window + 1
    if total < 2:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    grams = [joined[starts[i] : starts[i + window] - 1] for i in range(total)]
    if len(set(grams)) == total:
        return 0
    seen: dict[bytes, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    hits = np.fromiter((i for i, g in enumerate(grams) if seen[g] > 1), dtype=np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def document_counts(documents: DataFrame) -> DataFrame:
    """One row of counts and shares per document."""
    schema = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, shares array<double>"

    def run(ids, langs, texts):
        rows = [counts(t or "") for t in texts]
        return [ids, langs, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 6)]

    # no language can be written like the stratum of those without one
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return map_batches(documents.select(F.col("doc_id").cast("long"), stratum.alias("stratum"), "text"), schema, run)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k) for k below n * p (else 1), summed from k down until the terms vanish."""
    if n <= 0 or k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, j = 0.0, 1.0, k
    while j >= 0 and term > 1e-16 * max(total, 1.0):
        total += term
        term *= j / (n - j + 1) * (1 - p) / p
        j -= 1
    return min(1.0, math.exp(log) * total)


def propose(rule: np.ndarray, bins: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float = ALPHA, n_rules: int = len(RULES), levels: int = LEVELS) -> np.ndarray:
    """Cutoffs (levels x rules) as bins from the histograms of one stratum, BINS + 1 for a rule that is off; a document is rejected if
    its bin is at least the cutoff. They fall from level to level."""
    above = np.zeros((2, n_rules, BINS + 2))
    np.add.at(above[0], (rule, bins), good)
    np.add.at(above[1], (rule, bins), bad)
    above = np.cumsum(above[:, :, ::-1], axis=2)[:, :, ::-1]
    share = above / np.maximum(above[:, :, :1], 1)
    out = np.full((levels, n_rules), BINS + 1)
    for level in range(levels):
        within = share[0, :, 1:] <= alpha * (level + 1) / (levels * n_rules)
        # the shares fall with the cutoff: those within the budget are the last ones
        cut = BINS + 2 - within.sum(1)
        gain = share[1, np.arange(n_rules), cut.clip(max=BINS + 1)] - share[0, np.arange(n_rules), cut.clip(max=BINS + 1)]
        out[level] = np.where(gain > 0, cut, BINS + 1)
    return np.minimum.accumulate(out, axis=0)


def certify(level: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, levels: int = LEVELS) -> int | None:
    """The level to use, from the holdout's documents by the first level that rejects them (``levels``: none does)."""
    by_level = np.zeros((2, levels + 1))
    np.add.at(by_level[0], level, good)
    np.add.at(by_level[1], level, bad)
    rejected, total = np.cumsum(by_level, axis=1), by_level.sum(1)
    best, chosen = 0.0, None
    for at in range(levels):
        if binomial_tail(int(rejected[0, at]), int(total[0]), alpha) > delta:
            break
        gain = rejected[1, at] / max(total[1], 1) - rejected[0, at] / max(total[0], 1)
        if gain > best:
            best, chosen = gain, at
    return chosen


def by_stratum(rows: DataFrame, cuts: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the stored row of their stratum. Up to BROADCAST_STRATA strata go to the rows, so that a stratum that holds most rows stays
    spread; beyond that the join is left to the optimiser."""
    return rows.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts, "stratum", how)


def thresholds(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs array<int>) in the order of RULES, for strata with a certified level.

    What leaves the labelled rows is a histogram of bins for each stratum and rule, and one of levels for each stratum, so no group grows with the data.
    """
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    bins = F.transform("shares", lambda s: F.floor(s * BINS).cast("int"))
    marked = stats.select("doc_id", "stratum", bins.alias("bins")).join(known.where("q = q2").select("doc_id", "q"), "doc_id")
    marked = materialise(marked.select("stratum", "bins", F.col("q").cast("long").alias("q"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("holdout")))
    tally = [F.sum("q").alias("good"), F.sum(1 - F.col("q")).alias("bad")]
    shown = marked.where("NOT holdout").select("stratum", "q", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(*tally)

    def offer(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = propose(*(rows[c].to_numpy() for c in ("rule", "bin", "good", "bad")), alpha)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "levels": [cuts.tolist()]})

    offers = materialise(shown.groupBy("stratum").applyInPandas(offer, "stratum string, levels array<array<int>>"))
    hit = F.transform("levels", lambda cuts: F.exists(F.zip_with("bins", cuts, lambda b, c: b >= c), lambda x: x))
    first = F.coalesce(F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)) - 1, F.lit(LEVELS))
    tested = by_stratum(marked.where("holdout"), offers).select("stratum", "q", first.cast("int").alias("level")).groupBy("stratum", "level").agg(*tally)
    strata = max(offers.count(), 1)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        found = certify(*(rows[c].to_numpy() for c in ("level", "good", "bad")), alpha, delta / strata)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "level": [found]}).dropna()

    chosen = tested.groupBy("stratum").applyInPandas(pick, "stratum string, level int")
    return offers.join(chosen, "stratum").select("stratum", F.get("levels", F.col("level")).alias("cutoffs"))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the names of the rules that reject."""
    stats = materialise(document_counts(documents))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    cuts = materialise(thresholds(stats.where(~base), labels))
    broken = F.filter(
        F.transform(
            F.array(*map(F.lit, RULES)), lambda name, i: F.when(F.floor(F.get("shares", i) * BINS) >= F.get("cutoffs", i), name)
        ),
        lambda name: name.isNotNull(),
    )
    out = by_stratum(stats, cuts, "left").withColumn("failed_rules", F.coalesce(broken, F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )


@query("op10_risk_rules")
def op10_risk_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")
