"""Quality rules: statistics of each text, a base rule, and an isolation forest with a threshold from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.functions.quantiles import order_statistics
from fitgrain.llm.common import raw, shipped, texts
from fitgrain.session import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Percent of a text's words that repeated windows may cover.
REPEATED = 30
#: Labelled rows that are fitted on the driver, at most; more are fitted where they lie, none is left out.
LABELLED_ROWS = 6000
#: Ids of labels that are sent to the documents; of more, both sides are shuffled.
SENT_IDS = 1_000_000
TREES = 100
SUBSAMPLE = 256
#: Share of good labelled rows that the threshold keeps.
KEPT_SHARE = 0.998
#: Good rows to each bad one among those that grow the forest.
GOOD_TO_BAD = 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the forest splits on. The base rule has lengths and repeats already, which clean texts vary in widely.
RULES = ("word_length", "symbols", "bars", "distinct_words")

_CONTINUES = slice(0x80, 0xC0)
_WHITE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_MULTIPLIERS = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 8 that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = hashes[:n] * _MULTIPLIERS[0]
    for k in range(1, WINDOW):
        windows = (windows ^ windows >> np.uint64(29)) * _MULTIPLIERS[k] + hashes[k : k + n]
    ordered = np.sort(windows)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.unique(starts), 1)
    np.add.at(edges, np.unique(starts) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the rule statistics of one UTF-8 text."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    points = len(text) - int(counts[_CONTINUES].sum())
    chars = points - int(counts[_WHITE].sum())
    symbols = int(counts[np.frombuffer(SYMBOLS, np.uint8)].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    n = max(len(words), 1)
    rules = [chars / n, symbols / n, int(counts[ord("|")]) / n, len(set(words)) / n]
    return [len(words), chars, symbols, dup_lines, repeated], rules


def base_failed(base: list[int]) -> bool:
    n_words, n_repeat = base[0], base[4]
    return n_words < MIN_WORDS or 100 * n_repeat > REPEATED * n_words


def usual_path(n: int) -> float:
    """Mean path length of a search tree of ``n`` rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Random splits as arrays: trees × nodes, the children of node k at 2k + 1 and 2k + 2."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    size: int
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: short paths are near 1."""
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), np.int64)
            while True:
                own = feature[node]
                inner = own >= 0
                if not inner.any():
                    break
                right = rows[at, np.maximum(own, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(usual_path(self.size), 1e-9))


def grow(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    random = np.random.default_rng(seed)
    size = min(subsample, len(rows))
    depth = max(int(np.ceil(np.log2(max(size, 2)))), 1)
    nodes = (1 << depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    split = np.zeros((trees, nodes))
    path = np.zeros((trees, nodes))
    for tree in range(trees):
        waiting = [(0, 0, rows[random.choice(len(rows), size, replace=False)])]
        while waiting:
            node, level, own = waiting.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(open_):
                path[tree, node] = level + usual_path(len(own))
                continue
            f = int(random.choice(open_))
            at = float(random.uniform(low[f], high[f]))
            at = at if at > low[f] else float(high[f])
            feature[tree, node], split[tree, node] = f, at
            side = own[:, f] >= at
            waiting += [(2 * node + 1, level + 1, own[~side]), (2 * node + 2, level + 1, own[side])]
    return Forest(feature, split, path, size, 1.0)


def fit(rules: np.ndarray, good: np.ndarray) -> Forest | None:
    """A forest of half the rows, few of them bad so that they stay odd; the other half's good rows set its threshold."""
    own, other = rules[good], rules[~good]
    if len(own) < 2:
        return None
    forest = grow(np.concatenate([own[::2], other[::2][: len(own) // (2 * GOOD_TO_BAD)]]))
    scores = np.sort(forest.scores(own[1::2]))
    return Forest(forest.feature, forest.split, forest.path, forest.size, float(scores[min(int(np.ceil(len(scores) * KEPT_SHARE)), len(scores) - 1)]))


_FIELDS = [("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("rules", pa.list_(pa.float64()))]


def rule_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts and the list of rule statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in raw(batch.column(1))]
            columns = [batch.column(0).cast(pa.int64()), *(pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(BASE))), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in _FIELDS])

    return texts(documents, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", rules array<double>")


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Forest | None:
    """Fit on all labelled documents; None if too few are good.

    Up to ``rows`` of them are fitted on the driver, more where they lie. Of
    several labels of an id the lowest holds; of several rows of an id one
    is taken, the least by its statistics. So neither repeated ids nor
    conflicting labels change what is learned or how much.
    """
    shipped(documents.sparkSession)
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = written(named, "quality-labels")
    sent = (lambda df: F.broadcast(df)) if held.count() <= SENT_IDS else (lambda df: df)
    own = documents.select("doc_id", "text").join(sent(held.select("doc_id")), "doc_id", "left_semi")
    one = rule_statistics(own).groupBy("doc_id").agg(F.min(F.struct(*BASE, "rules")).alias("s")).join(sent(held), "doc_id")
    failed = (F.col("s.n_words") < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > REPEATED * F.col("s.n_words"))
    passed = written(one.where(~failed).select("doc_id", "s.rules", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good")), "quality-rows")
    n = passed.count()
    if not n:
        return None
    if n > rows:
        return _fit_spread(passed)
    found = sorted(passed.collect(), key=lambda r: r["doc_id"])
    return fit(np.array([r["rules"] for r in found], float), np.array([r["good"] for r in found]))


def _fit_spread(passed: DataFrame) -> Forest | None:
    """The forest of ``(doc_id, rules, good)`` of any size: its threshold is the exact place among all good rows of one half.

    The trees take ``TREES * SUBSAMPLE`` rows between them, so no more than
    that many, by a hash of the ids of the other half, come to the driver.
    """
    mixed = F.xxhash64(F.lit("quality"), "doc_id")
    half = passed.withColumn("place", mixed).withColumn("second", F.pmod(mixed, F.lit(2)) == 1)
    n_good = half.where("good").count()
    if n_good < 2:
        return None
    good = TREES * SUBSAMPLE
    first = lambda df, most: df.where("not second").orderBy("place", "doc_id").limit(most).select("rules").collect()
    usual = first(half.where("good"), good)
    odd = first(half.where("not good"), min(good, n_good // 2) // GOOD_TO_BAD)
    forest = grow(np.array([r["rules"] for r in [*usual, *odd]], float))
    sent = passed.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.scores(np.array(batch.column(0).to_pylist(), float)))], ["score"])

    scores = written(half.where("good and second").select("rules").mapInArrow(run, "score double"), "quality-scores")
    n = scores.count()
    rank = min(int(np.ceil(n * KEPT_SHARE)), n - 1)
    return replace(forest, threshold=order_statistics(scores, {"score": F.col("score")}, {"score": [rank]}, {"score": n})["score"][rank])


def quality(documents: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``anomaly`` and ``kept`` of each row.

    A row that fails the base rule is dropped; another is kept if its anomaly
    is no higher than the forest's threshold, or if there is no forest. Null
    and empty texts have no words and fail. Rows are judged one by one:
    repeated rows are equal, null ids pass through, an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        for batch in batches:
            found = [statistics(t) for t in raw(batch.column(1))]
            failed = [base_failed(f[0]) for f in found]
            anomaly = forest.scores(np.array([f[1] for f in found])) if forest and found else np.zeros(len(found))
            kept = [not bad and (forest is None or a <= forest.threshold) for bad, a in zip(failed, anomaly)]
            columns = [batch.column(0).cast(pa.int64()), *(pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(BASE))), pa.array(failed, pa.bool_()), pa.array(anomaly, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return texts(documents, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, anomaly double, kept boolean")
