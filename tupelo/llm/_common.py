"""What every operator here shares: the cluster's shared folder, saved tables, rows told apart."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGE = __name__.split(".")[0]
ROOT = Path(__file__).resolve().parents[2]
_SHIPPED = f"spark.{PACKAGE}.shipped"
#: Open scratches, the innermost last: whether each ends what is kept, too, and the paths it deletes.
_scratches: list[tuple[bool, list[str]]] = []


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the one
    given to setCheckpointDir().

    Only on one machine, where the session has none (tests), a temporary folder is made and set; on
    a cluster that is an error, as its machines share no such folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get(f"spark.{PACKAGE}.dir", None)
    if not found:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")).as_uri()
        spark.conf.set(f"spark.{PACKAGE}.dir", found)
    # A path without a scheme means the cluster's default file system, as it does to Spark.
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def fresh_path(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A new path in the shared folder, for the innermost scratch() to delete, or if it is kept, for
    the innermost one that ends kept tables too."""
    path = f"{shared_dir(spark)}/{PACKAGE}-{what}-{uuid.uuid4().hex}"
    own = next((paths for whole, paths in reversed(_scratches) if whole or not keep), None)
    if own is not None:
        own.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession, whole: bool = False) -> Iterator[None]:
    """Deletes, at the end, what is written within, but for what is kept because a result that
    leaves here still reads it. whole: nothing that leaves does."""
    _scratches.append((whole, []))
    try:
        yield
    finally:
        for path in _scratches.pop()[1]:
            discard(spark, path)


def saved(df: DataFrame, what: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Cuts lineage: the rows written as Parquet in the shared folder, and read again.

    Lost executors cost only the tasks that they ran: what is written stays.
    """
    path = path or fresh_path(df.sparkSession, what, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors. On one machine the environment may do so already."""
    there = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if one_machine(spark) and str(ROOT) in there or spark.conf.get(_SHIPPED, None):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted((ROOT / PACKAGE).rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{PACKAGE}-{uuid.uuid4().hex}.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target.toString())
    spark.conf.set(_SHIPPED, "1")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Others, whatever their names, don't reach an operator's inner joins."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, stem: str, *more: str) -> str:
    """A column name that neither df nor more has (names are compared as Spark does, ignoring case)."""
    taken, name = {c.lower() for c in (*df.columns, *more)}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_keys(text: F.Column) -> dict[str, F.Column]:
    """Two independent 64-bit hashes that stand for a text where it needn't travel (null: a text of its own)."""
    return {"g1": F.xxhash64(text), "g2": F.xxhash64(F.lit(1), text, F.octet_length(text))}


def id_keys(c: F.Column) -> tuple[F.Column, F.Column]:
    """An id, which may be null, as two columns that never are. A null-safe comparison would do for a
    join, but hides from the planner that its rows already lie together by id."""
    return F.coalesce(c.cast("string"), F.lit("")), c.isNull()


def salted(rows: DataFrame, ranks: int = 4096) -> DataFrame:
    """rows with `salt`, which tells rows that are alike apart by where they lie. It must be saved
    before it is read twice."""
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(ranks)).cast("int"))


#: Rows alike in their keys that may wait for each other in one place; more are dealt out by salt.
ALIKE = 1024


def _repeats(rows: DataFrame, keys: list[str], keep: bool) -> tuple[int, DataFrame | None]:
    """How often the most frequent key occurs, and the keys that occur more than ALIKE times, saved, if any do."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    return most, saved(counts.where(F.col("_n") > ALIKE).select(*keys), "repeats", keep=keep) if most > ALIKE else None


def _numbered(rows: DataFrame, keys: list[str], often: DataFrame | None) -> DataFrame:
    columns = [*[c for c in rows.columns if c != "salt"], "nth"]
    place = lambda *by: (F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))) - 1).cast("long")
    if often is None:
        return rows.withColumn("nth", place(*keys)).select(*columns)
    many, few = rows.join(often, keys, "left_semi"), rows.join(often, keys, "left_anti")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = many.groupBy(*keys, "salt").agg(F.count("*").alias("_n")).select(*keys, "salt", F.coalesce(before, F.lit(0)).alias("_start"))
    many = many.withColumn("nth", place(*keys, "salt")).join(starts, [*keys, "salt"]).withColumn("nth", F.col("_start") + F.col("nth"))
    return few.withColumn("nth", place(*keys)).select(*columns).union(many.select(*columns))


def numbered_repeats(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows, saved, with `nth` (long): the number of the row among those alike in keys, from 0, in no
    particular order.

    Rows of a key are counted by partial sums; where they are many, they are numbered within each
    salt, however many they are.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, what, keep=True)
    rows = saved(salted(rows), what, path)
    with scratch(spark):
        most, often = _repeats(rows, keys, keep=False)
        if most <= 1:
            return rows.withColumn("nth", F.lit(0).cast("long")).drop("salt")
        out = saved(_numbered(rows, keys, often), what, keep=True)
    discard(spark, path)
    return out


def paired(docs: DataFrame, found: DataFrame, doc_id: str, text: str, values: dict[str, str]) -> DataFrame:
    """docs with columns of found, which has doc_id, g1 and g2 (see text_keys) and a row for each row of docs.

    values: new column names (ones that docs doesn't have) by found's. Rows of one id and text are
    interchangeable and get found's rows in some order. The texts are shuffled once, for the join;
    the numbering of such rows needs no other partitioning. Where an id and text occur more than
    ALIKE times, those rows are written, numbered on either side and joined on their numbers too, so
    that none of them waits for the others in one place.
    """
    keys = [free_name(docs, f"_pair{k}", *values.values()) for k in ("i", "n", "g1", "g2")]
    held, at = free_name(docs, "_pairheld", *values.values()), free_name(docs, "_pairat", *values.values())
    plan = found.select(*[c.alias(k) for c, k in zip((*id_keys(F.col("doc_id")), F.col("g1"), F.col("g2")), keys, strict=True)], F.struct(*values).alias(held))
    plan = saved(salted(plan), "plan", keep=True)
    own = (*id_keys(F.col(f"`{doc_id}`")), *text_keys(F.col(f"`{text}`")).values())
    own = docs.withColumns(dict(zip(keys, own, strict=True)))
    back = [F.col(f"`{c}`") for c in docs.columns]
    more = lambda c: [c[k].alias(v) for k, v in values.items()]
    most, often = _repeats(plan, keys, keep=True)
    few = own if often is None else own.join(often, keys, "left_anti")
    if most <= 1:
        return few.join(plan.drop("salt"), keys).select(*back, *more(F.col(held)))
    lists = (plan if often is None else plan.join(often, keys, "left_anti")).groupBy(*keys).agg(F.collect_list(held).alias(held))  # ALIKE at most in each
    few = few.join(lists, keys).withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    few = few.select(*back, *more(F.element_at(F.col(held), F.col(at))))
    if often is None:
        return few
    # Under names of their own, so that the documents' columns can't be taken for the salt or the number.
    plain = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    many = own.join(often, keys, "left_semi").select(*keys, *[F.col(f"`{c}`").alias(k) for c, k in plain.items()])
    many = _numbered(saved(salted(many), "repeated", keep=True), keys, often)
    told = plan.join(often, keys, "left_semi")
    many = many.join(_numbered(told, keys, often), [*keys, "nth"])
    return few.union(many.select(*[F.col(k).alias(c) for c, k in plain.items()], *more(F.col(held))))
