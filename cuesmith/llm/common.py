"""What the operators share: the word rule, scratch tables and column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters, which
#: are also the ones that ``bytes.split()`` cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:  # with its store, so that executors resolve it as Spark does
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if getattr(scratch, "own", None) is None:
        scratch.own = "file://" + tempfile.mkdtemp(prefix="spark-")
    return scratch.own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, lost: DataFrame, *keys: Column) -> DataFrame:
    """``docs``, all columns as they are, less the rows whose ``keys`` are a row of
    ``lost``. A null key is a key like any other."""
    names = [fresh(docs, f"lost{k}") for k in range(len(keys))]
    same = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        same = same & key.eqNullSafe(F.col(name))
    return docs.join(lost.toDF(*names).distinct(), same, "left_anti")


def single_rows(docs: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """``docs``, all columns as they are, with one row for each value of ``key`` that
    ``repeated``, a written table, lists; all other rows stay where they are."""
    if repeated.isEmpty():
        return docs
    name = fresh(docs, "repeated")
    repeated = repeated.toDF(name).distinct()
    held = docs.withColumn(name, key).join(repeated, name, "left_semi").dropDuplicates([name])
    return without(docs, repeated, key).unionByName(held.select(*docs.columns))


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Later steps read the files, so a lost executor repeats tasks of this table's
    readers and not the work that made it.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    WRITTEN.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


#: Paths of the tables that ``stored`` wrote and nobody discarded.
WRITTEN: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make``'s result written as a table; the tables that ``make`` wrote on the way are deleted."""
    before = set(WRITTEN)
    table = stored(make(), label)
    for path in [p for p in WRITTEN if p not in before and p != table.scratch_path]:
        _delete(spark, path)
    return table


def words_in(text: Column) -> Column:
    """Number of words of a text as LONG; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
