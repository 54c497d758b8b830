"""Token ids in ORC files, in ascending document order.

Each document is encoded whole by a tokenizer of the tokenizers library, and an end id is appended.
A file has one row per document: doc_id, part (number of the file), start (ids of the part before
the document), n_tokens and ids. ORC writes the integers run-length encoded, keeps a row index of
every `stride` rows with least and greatest values, and Bloom filters on doc_id, so that readers
take stripes in parallel and skip what can't hold an id. Where a part starts among all ids comes
from one number per part, read back from the files.

If the tokenizer drops white space and splits words by a pattern before anything else, a word's ids
don't depend on its text. Then plain Latin texts are split by that pattern, and each different word
is handed to the tokenizer's model once and remembered; this is checked on the tokenizer's own
definition. Any other tokenizer or text is encoded whole. The memory is emptied when it has
`most_known` words, which bounds it.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, own_columns, saved, scratch, ship
from .textvec import bytes_of

STRIDE = 10_000
ORC = {"orc.compress": "ZSTD", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": str(STRIDE), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true"}


#: Texts of white space and these characters alone are split into words here; all others go through the whole tokenizer.
LETTERS, DIGITS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", "0-9"
PLAIN = "\\t-\\r -~" + LETTERS.removeprefix("A-Za-z")
NOT_PLAIN = re.compile(rf"[^{PLAIN}\u2028]|<\|")
#: Stands between texts: white space that no plain text has.
CUT = "\u2028"


class _Known(dict):
    """The number of each key; new keys are numbered and put down as new."""

    def __init__(self, keys=()) -> None:
        super().__init__((k, i) for i, k in enumerate(keys))
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


def _lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return size, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))


def _take(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices of flat from start, of these sizes, one after another."""
    ends = np.cumsum(size)
    place = np.repeat(start - (ends - size), size)
    place += np.arange(len(place))
    return flat[place]


class Encoder:
    """Encodes texts; its memory lasts as long as the Python worker."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, most_known: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_known = most_known
        made = json.loads(self.tokenizer.to_str())
        self.pattern = None
        if drops_space(made):
            first, *rest = made["pre_tokenizer"].get("pretokenizers", [made["pre_tokenizer"]])
            pattern = first["pattern"]["Regex"]
            if "\\p" not in re.sub(r"\[[^\]]*\]", "", pattern):
                self.pattern = re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", DIGITS) + f"|{CUT}")
            normal = made.get("normalizer") or {}
            self.lower = any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal]) if x)
            # How the model spells a character: its bytes, if the tokenizer works on bytes.
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str if rest else None
            self.spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0xC0, 0x180)) if spell and c.isalpha()}
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.words = _Known([CUT])
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if new:
            tokenize, spelling = self.tokenizer.model.tokenize, self.spelling
            size, flat = _lists([[t.id for t in tokenize(w if w.isascii() else w.translate(spelling))] for w in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of plain texts."""
        if len(self.words) > self.most_known:
            self._forget()
        joined = CUT.join([*texts, ""])
        pieces = self.pattern.findall(joined.lower() if self.lower else joined)
        number = np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        size = self.size[number]
        return np.diff(np.cumsum(size)[number == 0], prepend=0), _take(self.start[number], size, self.flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) and where each text's start, and the end."""
        odd = np.array([self.pattern is None or NOT_PLAIN.search(t) is not None or CUT in t for t in texts], bool)
        size, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[~odd], plain = self._plain([*itertools.compress(texts, ~odd)]) if not odd.all() else _lists([])
        if not odd.any():
            return plain, np.concatenate([[0], np.cumsum(size)])
        size[odd], whole = _lists([x.ids for x in self.tokenizer.encode_batch_fast([*itertools.compress(texts, odd)], add_special_tokens=False)])
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        start[order] = np.cumsum(size[order]) - size[order]
        return _take(start, size, np.concatenate([plain, whole])), np.concatenate([[0], np.cumsum(size)])


def drops_space(made: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its runs without ASCII white space, joined.

    So it is if the only steps before its words are NFC, lower-casing and the joining of white
    space, words are found by a pattern without white space, all else being removed, and no step
    adds or cuts ids.
    """
    steps = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x] if x else []
    normal = steps(made.get("normalizer"), "normalizers")
    words = steps(made.get("pre_tokenizer"), "pretokenizers")
    plain = lambda x: x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    if made.get("truncation") or made.get("padding") or not words or not all(map(plain, normal)):
        return False
    first, *rest = words
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or not all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest):
        return False
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in made.get("added_tokens", [])):
        return False
    # Alternatives made of letters, numbers and marks only, each without look-around or white space.
    part = r"(?:'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s(?:\\p\{[LN]\})+\]\+)"
    return bool(re.fullmatch(rf"{part}(?:\|{part})*", first["pattern"].get("Regex", "")))


def input_bytes(df: DataFrame) -> int | None:
    """The size of df's files as Catalyst knows it; None if it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def ordered(base: DataFrame, parts: int) -> DataFrame:
    """base (doc_id, text) by ranges of doc_id, sorted within. Where rows of one id, or of none, are
    more than two parts of all, their texts and then their places part them too."""
    counts = base.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (counts["most"] or 0) * parts <= 2 * (counts["all"] or 0) or counts["most"] == 1:
        return base.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    # Written first, as a row's place must stay what it is.
    placed = saved(base.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()}), "placed")
    return placed.repartitionByRange(parts, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").drop("h", "at")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", piece: int = 2 << 20, part_bytes: int = 128 << 20) -> None:
    """Writes docs' token ids to `path`. Null texts are empty: they have the end id alone.

    Rows are range-partitioned by doc_id, so the files follow one another in its order (null first);
    repeated ids stay together, in no particular order unless their texts differ. There are as many
    files as the session has shuffle partitions, or more, so that none has much over part_bytes of
    the input.
    """
    spark = docs.sparkSession
    ship(spark)
    base = own_columns(docs, doc_id, text).toDF("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, start = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).fill_null("")
            at, row = bytes_of(texts)[1], 0
            while row < len(at) - 1:
                end = max(row + 1, int(np.searchsorted(at, at[row] + piece, "right")) - 1)
                ids, before = encoder.encode(texts.slice(row, end - row).to_pylist())
                # The end id goes after each text: one more place for each text before it.
                n = end - row
                out = np.full(len(ids) + n, end_id, np.int32)
                keep = np.ones(len(out), bool)
                offsets = before + np.arange(n + 1)
                keep[offsets[1:] - 1] = False
                out[keep] = ids
                sizes = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.full(n, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes), lists], names=["doc_id", "part", "start", "n_tokens", "ids"])
                start += int(offsets[-1])
                row = end

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(input_bytes(base) or 0) // part_bytes))
    with scratch(spark):
        ordered(base, parts).mapInArrow(run, f"doc_id {kind}, part int, start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files at `path`, with start counted over all parts."""
    rows = spark.read.orc(path)
    parts = rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect()  # a number per file
    first, total = {}, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        first[r["part"]] = total
        total += r["n"]
    if not first:
        return rows
    base = F.broadcast(spark.createDataFrame([*first.items()], "part int, base long"))
    return rows.join(base, "part").withColumn("start", F.col("start") + F.col("base")).select("doc_id", "part", "start", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""
    own = rows.select("doc_id", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
            found = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **writing) -> DataFrame:
    """Writes docs to a new folder of the shared one and returns checksums() of what is read back.

    An empty table gives an empty table; extra columns stay out.
    """
    path = fresh_path(docs.sparkSession, "tokens", keep=True)
    write(docs, path, tokenizer, **writing)
    return checksums(read(docs.sparkSession, path))
