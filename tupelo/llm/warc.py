"""WARC archives: a writer, and a normaliser of files that are one gzip stream.

A WARC file that has been compressed as a whole can't be read from the middle. The normaliser
inflates such a stream once, in bounded pieces, writes every record again as a gzip member of its
own, and puts down in an index beside the file where each member starts and ends, so that readers
take records, or any run of them, in parallel.

The writer makes `response` records, and for a payload that an earlier one has, `revisit` records
without a payload that name it by WARC-Refers-To. Which one that is, is found over all rows, from
digests alone.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, own_columns, saved, scratch, ship
from .store import reading, remove, writing

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
#: Fixed, so that reruns give the same bytes.
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID(int=0)


def record_id(key: str, digest: str, *place: object) -> str:
    """Of the record with this page key and payload; place: its file and number, if others have both, too."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, ' '.join(map(str, (quote(key), digest, *place))))}>"


def record(kind: str, key: str | None, uri: str | None, payload: bytes, length: int, digest: str, refers_to: str | None = None, alone: bool = True, place: tuple = ()) -> bytes:
    """One record; payload: its block (empty for a revisit), length and digest: of the full payload;
    alone: whether the response that a revisit refers to is the only one with its key and payload;
    place: see record_id. Keys are percent-encoded; a null one has no field."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key or "", digest, *place)), ("WARC-Date", DATE)]
    if key is not None:
        head.append(("WARC-Page-Key", quote(key)))
    if uri is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in uri)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length))]
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to, digest))] * alone + [("WARC-Refers-To-Page-Key", quote(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def key_of(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name]) if name in fields else None


class Inflater:
    """Reads a gzip stream of one or more members, piece by piece."""

    def __init__(self, source: io.RawIOBase):
        self.source, self.z, self.raw, self.ready = source, zlib.decompressobj(31), b"", bytearray()
        self.ended = False

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                if self.started():
                    raise EOFError("the gzip stream is cut off")
                return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.ready += self.z.decompress(self.raw, 4 * CHUNK)
        self.raw = self.z.unconsumed_tail or self.z.unused_data
        self.ended = self.z.eof
        return True

    def started(self) -> bool:
        return not self.ended and self.source.tell() > 0

    def line(self) -> bytes:
        """Up to and with the next \\n; empty at the end."""
        seen = 0
        while (at := self.ready.find(b"\n", seen)) < 0:
            seen = len(self.ready)
            if not self._more():
                at = len(self.ready) - 1
                break
        out = bytes(self.ready[: at + 1])
        del self.ready[: at + 1]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self._more():
                raise EOFError("a record is cut off")
            out = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(out)
            if out:
                yield out


def records(source: Inflater) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """(fields by lower-case name, the header's bytes, the block in pieces) of each record in turn.

    The block must be taken before the next record is asked for.
    """
    while True:
        first = source.line()
        while first in (b"\r\n", b"\n"):
            first = source.line()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head, fields = [first], {}
        while (line := source.line()) not in (b"\r\n", b"\n"):
            if not line:
                raise EOFError("a header is cut off")
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, b"".join([*head, line]), source.exactly(int(fields["content-length"]))


def normalise_file(source: str, target: str, level: int = 1) -> Iterator[dict]:
    """Rewrites one file, and yields a row of the index for each record: number, offset, length and
    what the header says. Memory is bounded by a piece, however long a record is."""
    with reading(source) as f, writing(target) as out:
        at = 0
        for number, (fields, head, block) in enumerate(records(Inflater(f))):
            z, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for part in _parts(head, block):
                if made := z.compress(part):
                    n += out.write(made)
            n += out.write(z.flush())
            yield {"number": number, "offset": at, "length": n, "record_type": fields.get("warc-type"), "page_key": key_of(fields, "warc-page-key")}
            at += n


def _parts(head: bytes, block: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from block
    yield b"\r\n\r\n"


def verdicts(rows: DataFrame, least: int = 100) -> DataFrame:
    """Of rows (key, digest, length) each key and digest that has more to say than `response`:
    refers_to, the smallest key of its digest, if that is another and payloads are of at least `least`
    bytes; alone, whether one row only has that key and digest; twice, whether several have its own.

    A digest that many rows share is summed up before the shuffle. The sums are written, so that the
    join has a shuffle of its own on either side: adaptive execution splits a digest's rows only then.
    """
    with scratch(rows.sparkSession):
        same = saved(rows.where("key IS NOT NULL").groupBy("key", "digest").agg(F.max("length").alias("length"), F.count("*").alias("n")), "keys")
        first = same.where(F.col("length") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.min_by("n", "key").alias("times"), F.count("*").alias("keys"))
        first = saved(first.where("keys > 1").select("digest", "first", (F.col("times") == 1).alias("alone")), "originals")
        refers = F.when((F.col("length") >= least) & (F.col("first") < F.col("key")), F.col("first"))
        told = same.join(first, "digest", "left").select("key", "digest", refers.alias("refers_to"), "alone", (F.col("n") > 1).alias("twice"))
        return saved(told.where("refers_to IS NOT NULL OR twice"), "verdicts", keep=True)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, level: int = 1) -> DataFrame:
    """Writes pages as WARC files, one gzip stream each, and returns the table of files (name).

    Of records with equal payloads of at least `least` bytes the one with the smallest key is the
    response, all others revisit it. Null payloads are empty, null addresses left out. Of rows that
    share key and payload one is the response, and the others are too, as they can't refer to
    themselves; so is a row without a key. Rows of an empty table make no file. Other columns,
    whatever their names, stay out.

    No two records share an id: it is made of key and payload, and for rows that share both, or have
    no key, of their place too. A revisit names its response by id where that is made of key and
    payload alone, and by the key in any case.
    """
    spark = pages.sparkSession
    ship(spark)
    base = own_columns(pages, key, url, payload).toDF("key", "url", "payload")
    body = F.coalesce("payload", F.lit("")).cast("binary")
    known = {"digest": F.sha2(body, 256), "length": F.octet_length(body).cast("long")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        name, number = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        with writing(f"{folder}/{name}") as out:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for batch in itertools.chain([first], batches):
                _write_batch(batch, z, out, name, number)
                number += batch.num_rows
            out.write(z.flush())
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    files = fresh_path(spark, "archives", keep=True)
    with scratch(spark, whole=True):
        # The page joins its verdict on its key, of which there are as many as pages, not on the digest.
        more = verdicts(base.withColumns(known).drop("url", "payload"), least).withColumnsRenamed({"key": "_key", "digest": "_digest"})
        told = base.withColumns(known).join(more, (F.col("key") == F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
        sent = [F.col("key").cast("string").alias("key"), F.col("url"), F.when(F.col("refers_to").isNull(), F.coalesce("payload", F.lit(""))).alias("payload"), F.col("digest"), F.col("length")]
        sent += [F.col("refers_to").cast("string").alias("refers_to"), F.coalesce("alone", F.lit(True)).alias("alone"), (F.col("key").isNull() | F.coalesce("twice", F.lit(False))).alias("twice")]
        return saved(told.select(*sent).mapInArrow(run, "name string"), "archives", files)


def _write_batch(batch: pa.RecordBatch, z, out, name: str, number: int) -> None:
    for i in range(batch.num_rows):
        key, url, payload, digest, length, refers, alone, twice = (c[i].as_py() for c in batch.columns)
        kind, place = "response" if refers is None else "revisit", (name, number + i) if twice else ()
        if made := z.compress(record(kind, key, url, (payload or "").encode(), length, digest, refers, alone, place)):
            out.write(made)


def normalise(spark: SparkSession, files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites the files (name) of folder source into folder target, a file a task, each with its index
    beside it (<name>.idx.parquet), and returns the indexes as one table: name, number, offset, length,
    record_type and page_key of every record.

    Records without a type or page key have null there; a name that stands twice is one file. No
    files give an empty table. A file that isn't made of WARC records raises ValueError, one that
    is cut off EOFError.
    """
    ship(spark)
    schema = "name string, number long, offset long, length long, record_type string, page_key string"
    kinds = pa.schema([("name", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_key", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                made = ({"name": name, **row} for row in normalise_file(f"{source}/{name}", f"{target}/{name}"))
                with writing(f"{target}/{name}.idx.parquet") as out, pq.ParquetWriter(out, kinds) as index:
                    while rows := list(itertools.islice(made, 10_000)):
                        index.write_batch(pa.RecordBatch.from_pylist(rows, kinds))
            yield batch

    names = files.select("name").where("name IS NOT NULL").distinct()
    if not (count := names.count()):
        return spark.createDataFrame([], schema)
    with scratch(spark):
        # By ranges of names, so that each task has one.
        saved(names.repartitionByRange(count, "name").mapInArrow(run, "name string"), "normalised")
    return spark.read.schema(schema).parquet(f"{target}/*.idx.parquet")


def read(index: DataFrame, folder: str, run_bytes: int = 8 << 20, payloads: bool = True, most_tasks: int = 100_000) -> DataFrame:
    """The records that index names: page_key, record_type, payload_bytes, payload_digest, refers_key
    and payload (binary; null for a revisit, or where payloads aren't asked for).

    Neighbouring members are read in runs of about run_bytes, each by one request at its offset, in
    as many tasks as there are such runs in all bytes (beyond most_tasks, with several runs each). A
    response's digest and length are computed from its payload, a revisit's are those it states. A
    record without a page key has a null one; an empty index gives an empty table.
    """
    ship(index.sparkSession)
    runs = index.withColumn("run", F.floor(F.col("offset") / run_bytes)).groupBy("name", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    runs = runs.repartition(max(1, min(most_tasks, -(-total // run_bytes))), "name", "run")
    schema = "page_key string, record_type string, payload_bytes long, payload_digest string, refers_key string, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with reading(f"{folder}/{name}") as f:
                    f.seek(start)
                    raw = io.BytesIO(f.read(end - start))
                rows: list[list] = [[], [], [], [], [], []]
                held = 0
                for fields, _, block in records(Inflater(raw)):
                    kind, body = fields.get("warc-type"), b"".join(block)
                    whole = kind != "revisit"
                    digest = hashlib.sha256(body).hexdigest() if whole else fields["warc-payload-digest"].removeprefix("sha256:")
                    if whole and fields.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                        raise ValueError(f"{name}: a payload doesn't have its digest")
                    values = (key_of(fields, "warc-page-key"), kind, len(body) if whole else int(fields["warc-payload-length"]), digest, key_of(fields, "warc-refers-to-page-key"), body if whole and payloads else None)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    held += len(body) if payloads else 500
                    if held > run_bytes:
                        yield _batch(rows)
                        rows, held = [[], [], [], [], [], []], 0
                yield _batch(rows)

    return runs.select("name", "start", "end").mapInArrow(work, schema)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["page_key", "record_type", "payload_bytes", "payload_digest", "refers_key", "payload"])


def round_trip(pages: DataFrame, key: str = "page_id", **writing_options) -> DataFrame:
    """Writes pages, normalises the archives, drops the whole-file streams and reads the rest back:
    page_id, payload_bytes, payload_digest, record_type and refers_to, the ids as pages has them."""
    spark = pages.sparkSession
    whole, members = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc", keep=True)
    with scratch(spark, whole=True):
        index = normalise(spark, write(pages, whole, key, **writing_options), whole, members)
    remove(whole)
    kind = own_columns(pages, key).schema.fields[0].dataType
    got = read(index, members, payloads=False)
    return got.select(F.col("page_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to"))
