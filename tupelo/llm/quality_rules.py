"""Quality rules: statistics of whole texts, base rules, and an isolation forest over the statistics.

Trees of seeded random splits count all documents labelled good in their leaves; documents that few
splits tell apart from the rest have short paths and so a high anomaly score, 2^(-path / c). The
score beyond which a document is rejected is calibrated on all labelled documents: of the cuts that reject
at most `false_share` of the good ones, the one that best separates good from bad.

The statistics are one-sided: 0 where a text shows nothing odd, growing with what is odd, so that
plain texts, short, long or in any language, look alike to the forest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import own_columns, saved, scratch, ship
from .textvec import HEAD, SPACE, Texts, mix, owner, pieces

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in SYMBOLS]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
LETTER = UPPER.copy()
LETTER[ord("a") : ord("z") + 1] = True
MARK = np.array([32 < i < 127 and not chr(i).isalnum() for i in range(256)])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_marks", "n_echoes")
NUMBERS = (*COUNTS, *MORE)
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "echo_share")
#: Scores are told apart by so many steps from 0 to 1 where a cut is sought.
STEPS = 1 << 16


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of items with equal keys: of n such items, n - 1 neighbouring pairs."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return order[:-1][same], order[1:][same]


def _exact(raw: bytes) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, by its words and lines themselves."""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
    windows = [*zip(words, words[1:], words[2:], strict=False)]
    seen = Counter(windows)
    hit = np.zeros(len(words), bool)
    for k, x in enumerate(windows):
        if seen[x] > 1:
            hit[k : k + 3] = True
    return len(lines) - len(set(lines)), int(hit.sum())


def rule_stats(t: Texts) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text. n_lines: lines with a word; n_echoes: words like the one before.

    Equal lines and windows are found by hash and compared byte by byte; a text where equal hashes
    were of different bytes is counted anew without hashes.
    """
    start, end, before = t.words()
    inside = ~SPACE[t.data]
    prefix = t.prefix()
    out = {"n_words": np.diff(before), "word_chars": t.per_text(inside & HEAD[t.data]), "n_symbols": t.per_text(SYMBOL[t.data])}
    out |= {"n_upper": t.per_text(UPPER[t.data]), "n_letters": t.per_text(LETTER[t.data]), "n_marks": t.per_text(MARK[t.data])}
    tag = mix(np.arange(len(t), dtype=np.uint64) + np.uint64(1))

    first, last, lines = t.lines()
    filled = np.concatenate([[0], np.cumsum(inside)])
    filled = filled[last] > filled[first]
    first, last, line_of = first[filled], last[filled], owner(lines)[filled]
    i, j = _repeats(mix(t.spans(prefix, first, last) + tag[line_of]))
    odd = [x for bad in [(line_of[i] != line_of[j]) | t.unequal(first[i], last[i], first[j], last[j])] for x in (line_of[i][bad], line_of[j][bad])]
    out["n_lines"] = np.bincount(line_of, minlength=len(t))
    out["n_dup_lines"] = np.bincount(line_of[j], minlength=len(t))

    words, of = t.spans(prefix, start, end), owner(before)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    k = np.flatnonzero(echo)
    echo[k[t.unequal(start[k - 1], end[k - 1], start[k], end[k])]] = False
    twice = np.zeros(len(words) + 2, bool)  # of the window from word k, at k + 2
    if len(words) > 2:
        at = np.flatnonzero(of[2:] == of[:-2])
        i, j = _repeats(mix(words[at] * np.uint64(3) + mix(words[at + 1] * np.uint64(5) + mix(words[at + 2])) + tag[of[at]]))
        i, j = at[i], at[j]
        twice[i + 2] = twice[j + 2] = True
        # Windows overlap: each pair of words is compared once.
        both = np.unique(np.concatenate([(i + k) * len(words) + j + k for k in range(3)]))
        a, b = both // len(words), both % len(words)
        bad = (of[a] != of[b]) | t.unequal(start[a], end[a], start[b], end[b])
        odd += [of[a][bad], of[b][bad]]
    covered = twice[2:] | twice[1:-1] | twice[:-2]
    sums = np.concatenate([[0], np.cumsum(covered)]), np.concatenate([[0], np.cumsum(echo)])
    out["n_repeat_words"], out["n_echoes"] = (s[before[1:]] - s[before[:-1]] for s in sums)
    for text in np.unique(np.concatenate(odd)):
        out["n_dup_lines"][text], out["n_repeat_words"][text] = _exact(t.data[t.at[text] : t.at[text + 1]].tobytes())
    return out


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(s: pd.DataFrame | dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view of the statistics, each 0 .. 1."""
    n = np.maximum(_float(s["n_words"]), 1)
    share = lambda a, b: np.clip(_float(s[a]) / np.maximum(b, 1), 0, 1)
    return np.stack(
        [
            share("n_symbols", n),
            share("n_dup_lines", _float(s["n_lines"])),
            share("n_repeat_words", n),
            np.clip(share("n_upper", _float(s["n_letters"])) - 0.15, 0, 1),
            np.clip(share("n_marks", _float(s["word_chars"])) - 0.05, 0, 1),
            share("n_echoes", n),
        ],
        axis=1,
    )


def _float(x) -> np.ndarray:
    return np.asarray(x, np.float64)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays [tree, node]: feature (-1: leaf), cut, left child (right: + 1), path length if a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    height: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 .. 1, more is odder."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.height):
                f = feature[node]
                node = np.where(f < 0, node, left[node] + (x[rows, np.maximum(f, 0)] > cut[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _unsuccessful(n: float) -> float:
    """The mean path of an unsuccessful search in a binary search tree of n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Draft:
    """Trees before any row is seen, each split down to the same height, as arrays [tree, node]: the children of
    node k are 2k + 1 and 2k + 2, and the leaves come last, without a place in the arrays.

    Cuts are uniform over a node's box, not over the rows in it: most of the statistics are 0 for
    all ordinary rows, and only a box can be cut there. What lies in an empty part is then
    isolated early, and the mass of ordinary rows late. So the splits need no rows, only the leaves' counts do.
    """

    feature: np.ndarray
    cut: np.ndarray
    height: int

    def leaf(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The number of each row's leaf, from 0."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.height):
            node = 2 * node + 1 + (x[rows, self.feature[tree][node]] > self.cut[tree][node])
        return node - self.feature.shape[1]


def draft(features: int, trees: int = 200, height: int = 12, seed: int = 7) -> Draft:
    rng = np.random.default_rng(seed)
    shape = (trees, (1 << height) - 1)
    feature, cut = rng.integers(features, size=shape), rng.uniform(size=shape)
    lo, hi = np.zeros((trees, 1, features)), np.ones((trees, 1, features))
    for depth in range(height):
        own = slice((1 << depth) - 1, (2 << depth) - 1)
        f = feature[:, own, None]
        low, high = (np.take_along_axis(side, f, 2) for side in (lo, hi))
        at = low + (high - low) * cut[:, own, None]
        cut[:, own] = at[..., 0]
        lo, hi = np.repeat(lo, 2, axis=1), np.repeat(hi, 2, axis=1)
        np.put_along_axis(hi[:, ::2], f, at, 2)
        np.put_along_axis(lo[:, 1::2], f, at, 2)
    return Draft(feature.astype(np.int16), cut, height)


def settle(d: Draft, counts: np.ndarray) -> Forest:
    """The forest of a draft whose leaves hold counts [tree, leaf] rows: a node with fewer than two is a leaf.
    No rows give trees of one leaf, for which all are alike."""
    held = [counts]
    while held[0].shape[1] > 1:
        held.insert(0, held[0].reshape(len(counts), -1, 2).sum(axis=2))
    held = np.concatenate(held, axis=1)
    grown = []
    for feature, cut, n in zip(d.feature, d.cut, held, strict=True):
        nodes: list[list[float]] = [[-1, 0, 0, 0]]
        todo = [(0, 0, 0)]
        while todo:
            node, at, depth = todo.pop()
            if n[at] < 2 or depth == d.height:
                nodes[node][3] = depth + _unsuccessful(n[at])
                continue
            nodes[node][:3] = feature[at], cut[at], len(nodes)
            todo += [(len(nodes), 2 * at + 1, depth + 1), (len(nodes) + 1, 2 * at + 2, depth + 1)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        grown.append(np.array(nodes))
    width = max(map(len, grown))
    both = np.stack([np.pad(g, ((0, width - len(g)), (0, 0))) for g in grown])
    norm = max(_unsuccessful(int(held[0, 0])), 1.0)
    return Forest(both[..., 0].astype(np.int64), both[..., 1], both[..., 2].astype(np.int64), both[..., 3], norm, d.height)


def grow(x: np.ndarray, trees: int = 200, sample: int | None = None, height: int = 12, seed: int = 7) -> Forest:
    """An isolation forest on the rows of x, on all of them in each tree or on as many as `sample` says."""
    d, rng = draft(x.shape[1], trees, height, seed), np.random.default_rng(seed + 1)
    own = lambda: x if sample is None or sample >= len(x) else x[rng.choice(len(x), sample, replace=False)]
    return settle(d, np.stack([np.bincount(d.leaf(t, own()), minlength=1 << height) for t in range(trees)]))


def calibrate(score: np.ndarray, good: np.ndarray, false_share: float, times: np.ndarray | None = None) -> float:
    """The cut with the best difference of rejected shares, bad less good, that rejects at most
    false_share of the good; infinity if no label of either kind or no such cut helps. times: how many
    rows each entry stands for."""
    if not good.any() or good.all():
        return float("inf")
    cuts, at = np.unique(score, return_inverse=True)
    times = np.ones(len(score)) if times is None else times
    over = lambda own: 1 - np.cumsum(np.bincount(at[own], times[own], len(cuts))) / times[own].sum()
    bad_over, good_over = over(~good), over(good)
    gain = np.where(good_over <= false_share, bad_over - good_over, -1)
    best = int(gain.argmax())
    # Halfway to the next score seen, so that rows a hair off the labelled ones fall as they do.
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2) if gain[best] > 0 else float("inf")


def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns, without the text, and NUMBERS (long). Null texts have no words."""
    at = docs.columns.index(text)
    schema = type(docs.schema)([f for f in docs.schema.fields if f.name != text])
    for c in NUMBERS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i in range(batch.num_columns) if i != at]
            for a, b, t in pieces(batch.column(at)):
                found = rule_stats(t)
                columns = [*[batch.column(i).slice(a, b - a) for i in rest], *[pa.array(found[c].astype(np.int64)) for c in NUMBERS]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in NUMBERS}


def judged(stats: DataFrame, judges: tuple[Forest, float]) -> DataFrame:
    """stats, which has NUMBERS, with base_failed, anomaly (double) and kept."""
    schema = type(stats.schema)([*stats.schema.fields]).add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean")
    sent = stats.sparkSession.sparkContext.broadcast(judges)  # of a fixed size: trees x nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cut = sent.value
        for batch in batches:
            s = _numbers(batch)
            failed, odd = _base_failed(s), forest.score(features(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(odd), pa.array(~failed & (odd <= cut))], names=schema.names)

    return stats.mapInArrow(run, schema)


def _tally(rows: DataFrame, size: int, keys: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often each of the numbers from 0 to size - 1 occurs in keys(batch), over all rows: counted by
    each task, added up by number, so that at most `size` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(keys(batch), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["key", "n"])

    sums = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[sums["key"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", false_share: float = 0.005, trees: int = 200, height: int = 12, seed: int = 7) -> tuple[Forest, float]:
    """Forest and cut from all labelled documents of stats, which has doc_id, text_hash and NUMBERS.

    A document's grade is good if its greatest label is over 0; of an id with several texts one counts,
    the one with the smallest hash. Labels without a document, null labels and documents that fail
    the base rules don't take part. All others are counted, in the leaves of the trees (the good ones) and by
    grade and step of the score (all): the driver gets these counts, whose number doesn't grow with the labels.
    """
    graded = own_columns(labels, doc_id, quality).toDF("_doc", "quality").dropna().groupBy("_doc").agg((F.max("quality") > 0).alias("good"))
    # One row per document, however often its id is repeated: partial minima come before the shuffle.
    one = stats.where(~base_failed() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("text_hash", *NUMBERS)).alias("x"))
    d, leaves = draft(len(FEATURES), trees, height, seed), 1 << height
    with scratch(stats.sparkSession):
        rows = saved(one.join(graded, F.col("doc_id") == F.col("_doc")).select("good", *[f"x.{c}" for c in NUMBERS]), "graded")
        sent = stats.sparkSession.sparkContext.broadcast(d)  # of a fixed size: trees x nodes

        def leaf(batch: pa.RecordBatch) -> np.ndarray:
            x = features(_numbers(batch))
            return np.concatenate([t * leaves + sent.value.leaf(t, x) for t in range(trees)])

        forest = settle(d, _tally(rows.where("good"), trees * leaves, leaf).reshape(trees, leaves))
        grown = stats.sparkSession.sparkContext.broadcast(forest)

        def step(batch: pa.RecordBatch) -> np.ndarray:
            good = batch.column(batch.schema.get_field_index("good")).to_numpy(zero_copy_only=False)
            return 2 * np.ceil(grown.value.score(features(_numbers(batch))) * STEPS).astype(np.int64) + good

        seen = _tally(rows, 2 * (STEPS + 1), step)
    at = np.flatnonzero(seen)
    # A step's middle stands for its scores, so a cut halfway between two steps has each of them whole on one side.
    return forest, calibrate((at // 2 - 0.5) / STEPS, at % 2 == 1, false_share, seen[at])


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return own_columns(docs, doc_id, text).toDF("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def assess(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, COUNTS, MORE, base_failed, anomaly and kept. The texts
    are read once; their statistics are written, fitted on and judged.

    Null and empty texts have no words and fail the base rules; a null doc_id is judged like any
    other; repeated rows are judged alike, and so are equal texts (ties). Without labels of both kinds
    nothing but the base rules rejects. An empty table gives an empty table. Other columns, whatever
    their names, stay out.
    """
    ship(docs.sparkSession)
    stats = saved(statistics(_hashed(docs, doc_id, text)), "rules", keep=True)
    return judged(stats, fit(stats, labels.withColumnRenamed(doc_id, "doc_id"), **fitting))


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """docs without the rows that assess() rejects, all columns kept, whatever their names; null and
    empty texts go, null ids and repeated rows are judged like others, an empty table stays empty.
    A column name that stands twice in docs raises ValueError. The texts are read twice, to fit and to
    judge, as their rows would have to be shuffled to meet verdicts that were written.
    """
    names = docs.columns
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("docs has a column twice")
    spark, at = docs.sparkSession, names.index(text)
    ship(spark)
    judges = fit(statistics(_hashed(docs, doc_id, text)), labels.withColumnRenamed(doc_id, "doc_id"), **fitting)
    sent = spark.sparkContext.broadcast(judges)  # of a fixed size: trees x nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cut = sent.value
        for batch in batches:
            for a, b, t in pieces(batch.column(at)):
                s = rule_stats(t)
                good = ~_base_failed(s) & (forest.score(features(s)) <= cut)
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
