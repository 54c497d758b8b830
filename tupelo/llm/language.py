"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text's letters are lower-cased (A-Z only; other scripts speak for themselves), and everything
else becomes one space between words. Every run of 1 .. `order` characters is hashed into one of
`buckets`. Training counts n-grams per language; a prediction sums the log-probability rows of the
text's n-grams, read from one matrix, buckets x languages, that is broadcast.

Training takes at most about `per_lang` documents of each language, those with the smallest seeded
hashes: a documented bound, as a model of this size gains nothing from more. Which language has
how many is counted over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import own_columns, ship
from .textvec import HEAD, LOWER, U64, Texts, mix, ngram_sums, pieces

UNKNOWN = "und"
#: ASCII that isn't a letter counts as space.
PLAIN = LOWER.copy()
PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def ngrams(t: Texts, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket of every n-gram of characters, and how many come before each text."""
    data = PLAIN[t.data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[t.at[:-1][t.at[:-1] < len(data)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])[t.at]
    data = data[keep]
    head = np.flatnonzero(HEAD[data])
    chars = np.searchsorted(head, before)
    # A character's code, from its up to four bytes; an n-gram's hash is rolled from the codes.
    code = data[head].astype(U64)
    for k in (1, 2, 3):
        at = np.minimum(head + k, len(data) - 1)
        more = (head + k < len(data)) & ~HEAD[data[at]]
        for j in range(2, k + 1):
            more &= ~HEAD[data[np.minimum(head + j - 1, len(data) - 1)]]
        code = np.where(more, (code << U64(8)) | data[at], code)
    left = chars[1:][np.searchsorted(chars[1:], np.arange(len(code)), "right")] - np.arange(len(code)) if len(code) else code.astype(np.int64)
    h = np.zeros(len(code), U64)
    for n in range(1, order + 1):
        h = h[: len(code) - n + 1] * U64(0x9E3779B97F4A7C15) + code[n - 1 :] + U64(n) if len(code) >= n else h[:0]
        whole = left[: len(h)] >= n
        count = np.concatenate([[0], np.cumsum(whole)])
        yield (mix(h[whole]) & U64(buckets - 1)).astype(np.int64), count[np.minimum(chars, len(h))]


@dataclass(frozen=True)
class Model:
    """languages, and the log-probability of each bucket in each (float32); prior: log shares."""

    languages: tuple[str, ...]
    rows: np.ndarray
    prior: np.ndarray
    order: int

    def predict(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The index of the likeliest language of each text and its posterior probability."""
        total = np.tile(self.prior, (len(t), 1))
        for bucket, before in ngrams(t, self.order, len(self.rows)):
            total += ngram_sums(self.rows[bucket], before)
        best = total.argmax(1)
        odds = np.exp(total - total[np.arange(len(t)), best][:, None])
        return best, 1 / odds.sum(1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, order: int = 3, buckets: int = 1 << 16, most_languages: int = 1000, seed: int = 11) -> Model:
    """A model of docs' languages. Null texts and languages don't take part; no rows: a model without languages.

    More than most_languages different values of lang raise ValueError, as the matrix would no longer be small.
    """
    ship(docs.sparkSession)
    rows = own_columns(docs, text, lang, key).toDF("text", "lang", "key").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(sizes)
    if not names:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0), order)
    # Each language's rows are thinned to about per_lang by their hash, which needs no shuffle.
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_lang / sizes[n]))])
    dice = (F.xxhash64("key", "text", F.lit(seed)).cast("double") / F.lit(2.0**64)) + 0.5
    picked = rows.where(dice <= share[F.col("lang")]).select("text", "lang")
    index = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The cells seen and their counts, in order: no more than there are cells, and merged as often as they double.
        cells, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, where = np.unique(np.concatenate([cells, *[c for c, _ in held]]), return_inverse=True)
            return found, np.bincount(where, np.concatenate([counts, *[n for _, n in held]]), len(found)).astype(np.int64)

        for batch in batches:
            own = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, t in pieces(batch.column(0)):
                for bucket, before in ngrams(t, order, buckets):
                    held.append(np.unique(np.repeat(own[a:b], np.diff(before)) * buckets + bucket, return_counts=True))
                    size += len(held[-1][0])
                    if size > len(cells) + (1 << 16):
                        cells, counts = merged()
                        held, size = [], 0
        cells, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(cells // buckets), pa.array(cells % buckets), pa.array(counts)], names=["i", "j", "n"])

    # The sums are at most languages x buckets rows.
    sums = picked.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((buckets, len(names)), 0.5)
    i, j, n = (sums.column(c).to_numpy() for c in ("i", "j", "n"))
    total[j, i] += n
    shares = np.array([sizes[n] for n in names]) / sum(sizes.values())
    return Model(tuple(names), np.log(total / total.sum(0)).astype(np.float32), np.log(shares), order)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs' other columns, without the text, and the likeliest language and its posterior (0 .. 1).

    Texts that are null or have no letter get `und` and score 0; so does every text if the model
    has no languages. Repeated rows are judged alike; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    mark = "_lettered"
    while mark in docs.columns:
        mark = f"_{mark}"
    asked = docs.withColumn(mark, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    at, rest = docs.columns.index(text), [i for i in range(len(docs.columns)) if i != docs.columns.index(text)]
    schema = type(docs.schema)([docs.schema.fields[i] for i in rest]).add(lang_name, "string").add(score_name, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            lettered = batch.column(len(rest) + 1).to_numpy(zero_copy_only=False)
            for a, b, t in pieces(batch.column(at), 1 << 19):
                best, score = m.predict(t) if m.languages else (np.zeros(b - a, np.int64), np.zeros(b - a))
                known = lettered[a:b] & bool(m.languages)
                lang = pa.array(names[np.where(known, best, len(m.languages))], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in rest], lang, pa.array(np.where(known, score, 0.0))], names=schema.names)

    return asked.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> F.Column:
    """Whether crc32 of the id as text leaves that remainder; an id that is null doesn't."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds == fold, F.lit(False))
