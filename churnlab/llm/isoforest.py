"""Quality rules: an isolation forest on rule statistics, cut by labelled rows.

Every whole text is measured once: words, code points in words, symbols,
repeated lines, words in repeated 3-word windows. Base rules drop texts of
fewer than 50 words and texts with over half their words in repeated
windows. An isolation forest judges the others: each of ``TREES`` trees
splits a random sample of at most ``SAMPLE`` documents at a random place of
a random feature until every document stands alone; the fewer splits a
document meets on the average, the more anomalous it is. Its features are
rates in coarse steps (``FEATURE_STEPS``), so that neither length nor one
line said twice is an anomaly.

Fitted on bounded samples: trees draw from a pool of at most ``POOL``
documents, the first in the order of a hash of doc_id; documents with equal
statistics (copies) count once, so a large group of copies can't make itself
look usual. Everything else covers all rows: the statistics, the scores,
and the cut, which is calibrated on every labelled document: of the scores
at which it may be put, the one that rejects the largest share of the
low-quality rows less ``GOOD_WEIGHT`` times that of the good ones. Rows of
one statistic share their verdict.

Defined cases: a null or empty text has zeros everywhere and fails the base
rules; where no low-quality or no good row is labelled, or no cut gains
anything, nothing but the base rules drops; several labels of one id all
count, a null label or id does not; repeated rows get a row each; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import BLANKS, TOKEN, checkpointed, ship
from churnlab.llm.tokens import text_chunks

TREES, SAMPLE, POOL = 128, 128, 8192
SEED = 11
#: A share of the good rows lost weighs so many times that share of the low-quality rows kept.
GOOD_WEIGHT = 5.0
#: Scores are cut at multiples of one part in so many.
STEPS = 4096
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Code points, symbols, repeated lines and words in repeated windows a word
#: that make one step of a feature; less than a step is no difference.
FEATURE_STEPS = np.array([3.0, 0.1, 0.05, 0.25])
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_WORD = re.compile(TOKEN)
#: White space to Python's split(), but not to the contract.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS)


# -- statistics -------------------------------------------------------------


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _OTHER_BLANK.search(text) else text.split()


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text, its words in 3-word windows that the text holds twice or more.

    ``ids``: word numbers of all texts one after another; ``owner``: the text
    of each word. Windows are numbered exactly, a word at a time.
    """
    out = np.zeros(texts, np.int64)
    if len(ids) < 3:
        return out
    span = int(ids.max()) + 1
    _, first = np.unique(owner * span + ids, return_inverse=True)
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    _, pair = np.unique(first[at] * span + ids[at + 1], return_inverse=True)
    _, window, times = np.unique(pair * span + ids[at + 2], return_inverse=True, return_counts=True)
    hit = at[times[window] > 1]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[hit + k] = True
    np.add.at(out, owner[covered], 1)
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """The columns of ``STATISTICS``, a row per text."""
    out = np.zeros((len(texts), len(STATISTICS)), np.int64)
    numbers: dict[str, int] = {}
    slots: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = words_of(text)
        slots.extend([numbers.setdefault(w, len(numbers)) for w in words])
        symbols = sum(map(text.count, SYMBOLS))
        out[i, :4] = len(words), len(text) - sum(map(text.count, BLANKS)), symbols, repeated_lines(text)
    owner = np.repeat(np.arange(len(texts)), out[:, 0])
    out[:, 4] = repeated_words(np.array(slots, np.int64), owner, len(texts))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_chunks(batch.column(1)):
            columns = statistics(texts).T
            doc_ids = batch.column(0).slice(first, len(texts))
            yield pa.record_batch({"doc_id": doc_ids} | {c: pa.array(v) for c, v in zip(STATISTICS, columns, strict=True)})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _STATS_SCHEMA)


def base_failed() -> Column:
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    return (F.col("n_words") < MIN_WORDS) | repeats


def features(stats: np.ndarray) -> np.ndarray:
    """Rates of ``STATISTICS`` rows a word, in whole steps."""
    words = np.maximum(stats[:, :1], 1)
    return np.floor(stats[:, 1:] / words / FEATURE_STEPS)


# -- forest -----------------------------------------------------------------


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 2.0 * sum(1.0 / k for k in range(1, n)) - 2.0 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path) of one tree; a leaf has feature -1."""
    height = max(1, math.ceil(math.log2(max(2, len(points)))))
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(np.arange(len(points)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            node = list(nodes[parent])
            node[2 + side] = here
            nodes[parent] = tuple(node)
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        spread = np.flatnonzero(low < high)
        if depth == height or not len(spread):
            nodes.append((-1, 0.0, here, here, depth + usual_path(len(rows))))
            continue
        f = int(spread[rng.integers(len(spread))])
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append((f, cut, -1, -1, 0.0))
        right = points[rows, f] > cut
        todo += [(rows[~right], depth + 1, here, 0), (rows[right], depth + 1, here, 1)]
    return nodes


class Forest:
    """All trees as one table of nodes, and the sample size they were grown on."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], size: int):
        self.size, self.starts = size, np.cumsum([0] + [len(t) for t in trees])[:-1].astype(np.int32)
        rows = [(f, cut, left + s, right + s, path) for t, s in zip(trees, self.starts.tolist(), strict=True) for f, cut, left, right, path in t]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        self.feature, self.left, self.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
        self.cut, self.path = (np.array(columns[i], np.float64) for i in (1, 4))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): towards 1 the more anomalous."""
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for start in self.starts:
            at = np.full(len(points), start, np.int32)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = points[rows, np.maximum(f, 0)] > self.cut[at]
                at = np.where(right, self.right[at], self.left[at])
            total += self.path[at]
        usual = usual_path(self.size)
        if not len(self.starts) or usual <= 0:
            return np.zeros(len(points))
        return 2.0 ** -(total / len(self.starts) / usual)


def _grow_tree(rows: pd.DataFrame) -> pd.DataFrame:
    tree = int(rows["tree"].iloc[0])
    rows = rows.sort_values(STATISTICS)
    nodes = grow(features(rows[STATISTICS].to_numpy(np.int64)), np.random.default_rng([SEED, tree]))
    f, cut, left, right, path = zip(*nodes, strict=True)
    return pd.DataFrame({"tree": tree, "node": range(len(nodes)), "rows": len(rows), "f": f, "cut": cut, "l": left, "r": right, "path": path})


def fit(stats: DataFrame) -> Forest:
    """The forest of the rows that pass the base rules, a tree per task group."""
    ship(stats.sparkSession)
    usual = stats.filter(~base_failed() & F.col("doc_id").isNotNull())
    # copies have equal statistics and count once
    kinds = checkpointed(usual.groupBy(*STATISTICS).agg(F.min("doc_id").alias("doc_id")).withColumn("h", F.xxhash64("doc_id", *STATISTICS)))
    total = kinds.count()

    def first_by_hash(df: DataFrame, n: int, of: int, h: str, by: list[str]) -> DataFrame:
        # a hash below this share leaves some more than n rows; the window sees no others
        share = min(1.0, 1.5 * n / max(1, of) + 64 / max(1, of))
        some = df.filter(F.col(h) / float(1 << 64) + 0.5 <= share)
        order = Window.partitionBy(*by).orderBy(h, *STATISTICS)
        return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")

    pool = checkpointed(first_by_hash(kinds.withColumn("one", F.lit(1)), POOL, total, "h", ["one"]))
    trees = pool.select(*STATISTICS, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "doc_id")
    trees = trees.withColumn("g", F.xxhash64(F.lit(SEED), "tree", "doc_id", *STATISTICS))
    chosen = first_by_hash(trees, SAMPLE, min(POOL, total), "g", ["tree"])
    grown = chosen.groupBy("tree").applyInPandas(_grow_tree, "tree int, node int, rows int, f int, cut double, l int, r int, path double")
    # bounded by TREES * 2 * SAMPLE rows
    nodes = grown.orderBy("tree", "node").toPandas()
    found = [list(t[["f", "cut", "l", "r", "path"]].itertuples(index=False, name=None)) for _, t in nodes.groupby("tree")]
    return Forest(found, int(nodes["rows"].max()) if len(nodes) else 0)


# -- verdict ----------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))], axis=1)
        yield pa.record_batch({n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"score": pa.array(forest.scores(features(stats)))})


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with the anomaly score of every row."""
    ship(stats.sparkSession)
    return stats.select("doc_id", *STATISTICS).mapInArrow(partial(_score, forest=forest), f"{_STATS_SCHEMA}, score double")


def best_cut(counts: list[tuple[int, int, int]], weight: float = GOOD_WEIGHT) -> int | None:
    """The lowest step to reject, from (step, good rows, low rows); None: reject nothing."""
    good, low = sum(c[1] for c in counts), sum(c[2] for c in counts)
    best, gain = None, 0.0
    lost = caught = 0
    for step, g, b in sorted(counts, reverse=True):
        lost, caught = lost + g, caught + b
        if good and low and caught / low - weight * lost / good > gain:
            best, gain = step, caught / low - weight * lost / good
    return best


def calibrate(scores: DataFrame, labels: DataFrame) -> int | None:
    """The cut, from all labelled documents that pass the base rules."""
    votes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    votes = votes.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    votes = votes.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("low"))
    steps = scores.filter(~base_failed()).select("doc_id", _step().alias("step")).join(votes, "doc_id")
    # at most STEPS + 1 rows
    return best_cut([tuple(r) for r in steps.groupBy("step").agg(F.sum("good"), F.sum("low")).collect()])


def _step() -> Column:
    return F.floor(F.col("score") * STEPS).cast("int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, score and kept of every row."""
    stats = checkpointed(measured(docs))
    scores = checkpointed(scored(stats, fit(stats)))
    cut = calibrate(scores, labels)
    usual = F.lit(True) if cut is None else _step() < cut
    return scores.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), (~base_failed() & usual).alias("kept"), "score")
