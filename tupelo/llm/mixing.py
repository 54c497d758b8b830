"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources, in code point order with null last, have the weights 5, 2, 1, repeating, and share
`ratio` times all tokens; a target stops at `most` times its source's tokens, and the excess goes
to the others by weight. The tokens to take are a number of blocks of `block` tokens, and go to
the sources by highest quotients target / (2 k + 1). A source is dealt into shards of about
`shard_tokens` by a hash of its documents, and its blocks go to its shards by the same rule, which
gives an integer quota for each shard; a source of many shards hands them first to runs of `fan`
shards, and each run to its own, so that no task sees all shards of a source. A shard's documents, in seeded order, are one run of tokens
cut into blocks; a quota of q over n blocks takes all of them q // n times and then q % n of them,
from a seeded block on, around the end. So nearly all documents are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, id_keys, numbered_repeats, own_columns, paired, saved, scratch, ship, text_keys
from .textvec import pieces

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], ratio: float, most: float) -> list[float]:
    """Shares of ratio * sum(sizes) by weight, none over most * its size."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), ratio * sum(sizes)
    while free:
        unit = rest / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i]
        if not over:
            break
        rest -= sum(out[i] for i in over)
        free -= over
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), never more than caps; ties go to the first.

    A divisor is found first, by bisection, that hands out nearly all seats at once; the last few
    go one by one.
    """
    votes, caps = votes.astype(np.float64), np.where(votes > 0, caps, 0).astype(np.int64)
    seats = min(int(seats), int(caps.sum()))
    won = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = 1e-12, max(2.0, 4.0 * votes.max(initial=0.0))
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (low, mid) if won(mid).sum() <= seats else (mid, high)
    out = won(high)
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < caps, votes / (2 * out + 1), -1.0)
        first = np.argsort(-quotient, kind="stable")[:left]
        # Those within a hair of the best are ties; taking more at once could pass a better second quotient.
        out[first[quotient[first] >= quotient[first[0]] * (1 - 1e-9)]] += 1
    return out


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, most: int = 2, block: int = 32, shard_tokens: int = 1 << 20, seed: int = 17, most_sources: int = 100_000, fan: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, g1, g2, nth, source, size, source_size, target, taken, whole, and
    spans: the [start, end) of the words taken once more than `whole` times.

    Null and empty texts have size 0 and are taken 0 times; null is a source of its own; rows of
    one id and text are interchangeable, and nth counts them within their source. An empty table gives an empty table. The table of sources
    is made on the driver; over most_sources of them raise ValueError. Reruns agree.
    """
    spark = docs.sparkSession
    ship(spark)
    base = own_columns(docs, doc_id, text, source).toDF("doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    alike = dict(zip(("_id", "_none", "_from", "_nowhere"), (*id_keys(F.col("doc_id")), *id_keys(F.col("source"))), strict=True)) | text_keys(F.col("text"))
    rows = numbered_repeats(base.select("doc_id", "source", size.alias("size"), *[c.alias(k) for k, c in alike.items()]), [*alike], "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], ratio, most)
    blocks = sainte_lague(np.array(goal), round(sum(goal) / block), np.array([most * -(-s // block) for s in sizes], np.int64))
    table = [(r["source"], i, s, float(g), int(q), max(1, -(-s // shard_tokens))) for i, (r, s, g, q) in enumerate(zip(found, sizes, goal, blocks, strict=True))]
    sources = spark.createDataFrame(table, "source string, s int, source_size long, target double, quota long, shards long")
    if own_columns(docs, source).schema.fields[0].dataType.simpleString() != "string":
        sources = sources.withColumn("source", F.col("source").cast(rows.schema["source"].dataType))
    sources = F.broadcast(sources)  # at most most_sources rows

    shard = F.pmod(F.xxhash64("doc_id", "g1", "nth", F.lit(seed)), F.col("shards"))
    dealt = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", shard)

    def quotas(cells: pd.DataFrame, of: str) -> pd.DataFrame:
        cells = cells.sort_values(of, ignore_index=True)
        q = sainte_lague(cells["tokens"].to_numpy(), cells["quota"].iloc[0], most * cells["n"].to_numpy())
        return cells.assign(q=q)[["s", of, "n", "q"]]

    sums = [F.sum("tokens").alias("tokens"), F.sum("n").alias("n")]
    blocks_of = F.ceil(F.col("tokens") / block).cast("long")
    with scratch(spark):
        cells = dealt.groupBy("s", "shard", "quota").agg(F.sum("size").alias("tokens")).withColumns({"n": blocks_of, "run": F.floor(F.col("shard") / fan)})
        cells = saved(cells, "cells")
        runs = cells.groupBy("s", "run", "quota").agg(*sums).groupBy("s").applyInPandas(lambda x: quotas(x, "run"), "s int, run long, n long, q long")
        cells = cells.drop("quota").join(runs.select("s", "run", F.col("q").alias("quota")), ["s", "run"])
        cells = saved(cells.groupBy("s", "run").applyInPandas(lambda x: quotas(x, "shard"), "s int, shard long, n long, q long"), "quotas", keep=True)
    order = Window.partitionBy("s", "shard").orderBy(F.xxhash64("g1", "doc_id", "nth", F.lit(seed + 1)), "doc_id", "g1", "g2", "nth")
    run = dealt.join(cells, ["s", "shard"]).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start, left = F.col("end") - F.col("size"), F.col("q") % F.greatest("n", F.lit(1))
    first = F.pmod(F.xxhash64("s", "shard", F.lit(seed + 2)), F.greatest("n", F.lit(1)))
    # The words [from, to) of the document that lie in [a, b) of the shard's run.
    cut = lambda a, b: F.struct((F.greatest(start, a) - start).alias("start"), (F.greatest(F.least("end", b), F.greatest(start, a)) - start).alias("end"))
    around = F.greatest(first + left - F.col("n"), F.lit(0))
    spans = F.array(cut(F.lit(0).cast("long"), F.least(around * block, F.col("end"))), cut(first * block, (first + left) * block))
    spans = F.filter(spans, lambda x: x["end"] > x["start"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("q") / F.greatest("n", F.lit(1)))).otherwise(0).cast("long")
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    out = run.withColumns({"spans": spans, "whole": whole}).withColumn("taken", F.col("whole") * F.col("size") + extra)
    return out.select("doc_id", "g1", "g2", "nth", "source", "size", "source_size", "target", "taken", "whole", "spans")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **mix) -> DataFrame:
    """docs as the mix takes them, with docs' columns: a row for each time that a document is taken
    whole, and one for each span of words taken besides, whose text is that part of the document."""
    ship(docs.sparkSession)
    found = plan(docs, doc_id, text, source, **mix)
    names = {c: free_name(docs, f"_{c}") for c in ("whole", "spans")}
    own = paired(docs, found, doc_id, text, names)
    takes = free_name(own, "_take")
    part = F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    each = F.concat(F.array_repeat(part, F.col(names["whole"]).cast("int")), F.col(names["spans"]))
    own = own.withColumn(takes, F.explode(each)).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(takes)["start"].alias(names["whole"]), F.col(takes)["end"].alias(names["spans"]))
    at, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            start, end = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            if (end >= 0).any():
                parts = []
                for a, b, t in pieces(column):
                    first, last, before = t.words()
                    for i in range(a, b):
                        if end[i] < 0:
                            parts.append(column[i].as_py())
                            continue
                        words = before[i - a] + start[i], before[i - a] + end[i] - 1
                        parts.append(t.data[first[words[0]] : last[words[1]]].tobytes().decode("utf-8", "replace"))
                column = pa.array(parts, column.type)
            columns = [column if i == at else c for i, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])

    return own.mapInArrow(run, docs.schema)
