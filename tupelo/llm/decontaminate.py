"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and their marks in any script, with case folded as Unicode does
(so `STRASSE` is `straße`); all else parts them, invisible format characters are left out. In scripts
that are written without spaces each character is a token. A mask
names token positions that count; the others are ignored, so a substitution there doesn't
hide a match. The hashes of all masks at all places of the test items are joined with those of the
documents, and around each hit the overlap is verified on its diagonal: a document leaks an item
if, somewhere, at least `share` of `window` tokens in a row (of all tokens of a shorter item) are
those of the item. The default masks hit every such overlap, whichever tokens are substituted. Items
too short for that are matched where asked for (`short`), as exact runs of all their tokens.

The test set is small beside the corpus, but that isn't taken for granted: it is dealt into blocks
of about `block_bytes`, each of which is broadcast by itself. Documents are read and tokenized once,
in parts of about `part_bytes`, each of which meets one block after another; a task holds one block
at a time. Documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import own_columns, ship
from .textvec import HEAD, U64, Texts, bytes_of, mix, pieces

#: Positions that count in each mask. With 8 to 20 tokens of which a fifth is substituted, one fits.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 4, 6, 7))
_STEP = U64(0x9E3779B97F4A7C15)
_CHARACTERS = 0x110000
#: Scripts without spaces: Thai and Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Han.
_UNSPACED = np.zeros(_CHARACTERS, bool)
for _a, _b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)):
    _UNSPACED[_a : _b + 1] = True


@cache
def _folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: its case-folded form's length (0: left out), first character (0: not of a
    token) and, below 0x10000, other characters. Unassigned and private ones may be letters."""
    size, first = np.ones(_CHARACTERS, np.uint8), np.arange(_CHARACTERS, dtype=np.uint32)
    rest = np.zeros((0x10000, 2), np.uint32)
    for code in [*range(0x40000), *range(0xE0000, 0xE0200)]:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" and code != 0x200B:
            size[code] = 0
        elif not (c.isalnum() or kind[0] == "M" or kind in ("Cn", "Co")):
            first[code] = 0
        elif (folded := c.casefold()) != c:
            size[code], first[code] = len(folded), ord(folded[0])
            for k, x in enumerate(folded[1:]):
                rest[code, k] = ord(x)
    return size, first, rest


def folded(t: Texts) -> Texts:
    """The texts' case-folded characters, as numbers; 0 where no token is."""
    head = np.flatnonzero(HEAD[t.data])
    length = np.minimum(np.diff(np.append(head, len(t.data))), 4)
    code = t.data[head].astype(np.int64) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[length]
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        code[more] = (code[more] << 6) | (t.data[head[more] + k] & 0x3F)
    size, first, rest = _folding()
    code = np.minimum(code, _CHARACTERS - 1)
    sizes = size[code]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.repeat(first[code], sizes)
    for k in (1, 2):
        longer = np.flatnonzero(sizes > k)
        out[ends[longer] + k] = rest[code[longer], k - 1]
    return Texts(out, ends[np.searchsorted(head, t.at)])


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and the number of tokens before each text (and of all)."""
    own = folded(t)
    inside = own.data > 0
    alone = np.flatnonzero(_UNSPACED[own.data] & inside)
    if len(alone):
        # A gap before and after each such character, which changes no hash of a span without gaps.
        width = np.ones(len(own.data), np.int64)
        width[alone] = 3
        ends = np.concatenate([[0], np.cumsum(width)])
        data = np.zeros(ends[-1], own.data.dtype)
        at = ends[:-1].copy()
        at[alone] += 1
        data[at] = own.data
        own = Texts(data, ends[own.at])
    start, end, before = own.words(own.data > 0)
    return own.spans(own.prefix(), start, end), before


def seeds(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The mask's hash at each place where it fits, whatever texts the tokens are from."""
    n = max(0, len(hashes) - mask[-1])
    out = np.full(n, salt + 1, U64)
    for k in mask:
        out = out * _STEP + hashes[k : k + n]
    return mix(out)


@dataclass(frozen=True)
class Index:
    """A block of test items. hashes: ascending seeds; at: the place of each; item: of each place."""

    ids: pa.Array
    tokens: np.ndarray
    before: np.ndarray
    item: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    sieve: np.ndarray
    window: int
    share: float
    #: Lengths of the items that are matched exactly.
    short: tuple[int, ...] = ()

    def leaks(self, own: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """text, item, matched tokens, window and the window's first token in text and item, for each
        text and item that overlap: of several overlaps the first of those with most matches. own and
        before: the texts' tokens."""
        found = [(self._exact if exact else self._verified)(own, before, p, q, mask) for exact, mask, p, q in self._hits(own)]
        text, item, matched, size, p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 6))
        order = np.lexsort((q, p, -matched, item, text))
        text, item, matched, size, p, q = (x[order] for x in (text, item, matched, size, p, q))
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return tuple(x[new] for x in (text, item, matched, size, p - before[text], q - self.before[item]))

    def _hits(self, own: np.ndarray) -> Iterator[tuple[bool, tuple[int, ...], np.ndarray, np.ndarray]]:
        for salt, mask in _masks(self.short):
            h = seeds(own, mask, salt)
            p = np.flatnonzero(self.sieve[h & U64(len(self.sieve) - 1)])
            first = np.searchsorted(self.hashes, h[p], "left")
            count = np.searchsorted(self.hashes, h[p], "right") - first
            p, first, count = p[count > 0], first[count > 0], count[count > 0]
            # A seed that is common in both may have many places: they are taken in turns.
            step = 1 << 12
            ends = np.cumsum(count)
            for k in range(0, int(ends[-1]) if len(ends) else 0, step):
                n = np.arange(k, min(k + step, ends[-1]))
                row = np.searchsorted(ends, n, "right")
                yield salt >= len(MASKS), mask, p[row], self.at[first[row] + n - (ends[row] - count[row])]

    def _exact(self, own: np.ndarray, before: np.ndarray, p: np.ndarray, q: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """The hits where all of a short item's tokens are in the text; the first in each text and item."""
        text = np.searchsorted(before, p, "right") - 1
        good = p + len(mask) <= before[text + 1]
        for k in mask:
            good[good] = own[p[good] + k] == self.tokens[q[good] + k]
        text, p, q = text[good], p[good], q[good]
        first = np.unique(text * (len(self.before) + 1) + self.item[q], return_index=True)[1]
        size = np.full(len(first), len(mask))
        return text[first], self.item[q[first]], size, size, p[first], q[first]

    def _verified(self, own: np.ndarray, before: np.ndarray, p: np.ndarray, q: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, ...]:
        """The hits p (in the texts), q (in the items) around which a window that covers the seed matches."""
        text = np.searchsorted(before, p, "right") - 1
        item = self.item[q]
        size = np.minimum(self.window, np.diff(self.before)[item])
        reach = self.window - 1
        k = np.arange(-reach, reach + 1)
        a, b = p[:, None] + k, q[:, None] + k
        inside = (a >= before[text][:, None]) & (a < before[text + 1][:, None]) & (b >= self.before[item][:, None]) & (b < self.before[item + 1][:, None])
        equal = inside & (own[np.clip(a, 0, len(own) - 1)] == self.tokens[np.clip(b, 0, len(self.tokens) - 1)])
        sums = np.zeros((len(p), len(k) + 1), np.int64)
        np.cumsum(equal, axis=1, out=sums[:, 1:])
        room = np.zeros_like(sums)
        np.cumsum(inside, axis=1, out=room[:, 1:])
        most, where = np.full(len(p), -1), np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        for s in range(-reach, 1):
            i = s + reach
            j = np.clip(i + size, 0, len(k))
            whole = (room[rows, j] - room[:, i] == size) & (s + size > mask[-1])
            matched = np.where(whole, sums[rows, j] - sums[:, i], -1)
            better = matched > most
            most, where = np.where(better, matched, most), np.where(better, s, where)
        good = most >= np.ceil(self.share * size - 1e-9)
        return tuple(x[good] for x in (text, item, most, size, p + where, q + where))


def _masks(short: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Salts and masks: the spaced ones, then all of each short length."""
    yield from enumerate(MASKS)
    for n in short:
        yield len(MASKS) + n, tuple(range(n))


def index(items: pa.Table, window: int, share: float, least: int, short: bool = False) -> Index:
    """items: item_id and text. Those with fewer than `least` tokens are matched exactly if `short`, or stay out."""
    data, at = bytes_of(items.column(1))
    hashes, before = tokens(Texts(data, at))
    count = np.diff(before)
    long = count >= (1 if short else least)
    keep = np.repeat(long, count)
    before = np.concatenate([[0], np.cumsum(count[long])])
    hashes = hashes[keep]
    item = np.repeat(np.arange(long.sum()), count[long])
    size = count[long][item]
    lengths = tuple(np.unique(size[size < least]).tolist())
    all_h, all_at = [], []
    for salt, mask in _masks(lengths):
        h = seeds(hashes, mask, salt)
        fits = size[: len(h)] == len(mask) if salt >= len(MASKS) else size[: len(h)] >= least
        own = np.flatnonzero(fits & (item[: len(h)] == item[mask[-1] :][: len(h)]))
        all_h.append(h[own])
        all_at.append(own)
    h, where = np.concatenate(all_h), np.concatenate(all_at)
    order = np.argsort(h, kind="stable")
    # 64 places a seed, but for a large block no more than 16 MB or 8 places a seed.
    places = max(1 << 16, min(64 * len(h), max(1 << 24, 8 * len(h))))
    sieve = np.zeros(1 << (places - 1).bit_length(), bool)
    sieve[h & U64(len(sieve) - 1)] = True
    return Index(items.column(0).combine_chunks().filter(pa.array(long)), hashes, before, item, h[order], where[order], sieve, window, share, lengths)


def _indexes(benchmark: DataFrame, item_id: str, text: str, window: int, share: float, least: int, block_bytes: int, short: bool) -> Iterator[Index]:
    if least < MASKS[-1][-1] + 1 or window < least:
        raise ValueError("a window must hold the masks")
    rows = own_columns(benchmark, item_id, text).toDF("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield index(rows.where(F.col("block") == k).select("item_id", "text").orderBy("item_id", "text").toArrow(), window, share, least, short)


def _met(batches: Iterator[pa.RecordBatch], at: int, blocks: list[Broadcast], part_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches of about part_bytes of text, with what leaks() finds in their pieces, block by block: the
    first row of the piece, the block's item ids and the leaks."""
    for batch in batches:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = first = 0
        for a, b, t in pieces(batch.column(at), 1 << 17):
            held.append((a - first, *tokens(t)))
            size += len(t.data)
            if size < part_bytes and b < batch.num_rows:
                continue
            found = []
            for sent in blocks:
                block = sent.value
                found += [(row, block.ids, block.leaks(own, before)) for row, own, before in held]
                del block
                if len(blocks) > 1:
                    # The worker would else hold all blocks; what it needs again it reads from its disk.
                    vars(sent).pop("_value", None)
            yield batch.slice(first, b - first), found
            held, size, first = [], 0, b


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 20, share: float = 0.8, least: int = 8, block_bytes: int = 4 << 20, short: bool = False, part_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs and item that overlap: doc_id, item_id, matched, window, doc_token, item_token.

    Null and empty texts on either side overlap nothing; nor do items of fewer than `least`
    tokens, unless `short` asks for their exact copies. Of several overlaps with most matches (ties)
    the first in the document counts. Very long texts are searched whole.
    Null ids are carried along; an item that occurs twice is one item; repeated rows of docs are
    judged each. Other columns, whatever their names, stay out. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    base = own_columns(docs, doc_id, text).toDF("doc_id", "text")
    kind = own_columns(benchmark, item_id).schema.fields[0].dataType.simpleString()
    names = ["doc_id", "item_id", "matched", "window", "doc_token", "item_token"]
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, item_id {kind}, matched long, window long, doc_token long, item_token long"
    blocks = [spark.sparkContext.broadcast(x) for x in _indexes(benchmark, item_id, item_text, window, share, least, block_bytes, short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches, 1, blocks, part_bytes):
            for row, ids, (own, item, *rest) in found:
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + row)), ids.take(pa.array(item)), *map(pa.array, rest)], names=names)

    return base.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 20, share: float = 0.8, least: int = 8, block_bytes: int = 4 << 20, short: bool = False, part_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows that overlap an item, all columns kept. What overlaps() says of nulls,
    empty and long texts and short items holds here."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text)
    blocks = [spark.sparkContext.broadcast(x) for x in _indexes(benchmark, item_id, item_text, window, share, least, block_bytes, short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _met(batches, at, blocks, part_bytes):
            good = np.ones(batch.num_rows, bool)
            for row, _, leaks in found:
                good[leaks[0] + row] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
