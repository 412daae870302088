"""Token tables dealt into buckets by chunk, so that jobs over them shuffle no tokens.

A table keeps every state of a chunk as rows of a version; readers take the newest,
which lie in the same bucket as the older ones. So chunk files that come, change or
go are appended by a job that moves only them, and readers move nothing. ``tidied``
writes the newest states as one file a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuesmith.sources import files

CHUNK = ("media_id", "chunk_index")
ORDER = [*CHUNK, "version", "pos"]
#: Bytes of token files that a bucket gets, about, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 50_000


@dataclass(frozen=True)
class TokenTable:
    """A table of the catalog and the number of its buckets, which readers pass on as ``parts``."""

    spark: SparkSession
    name: str
    buckets: int

    def states(self) -> DataFrame:
        return self.spark.table(self.name)

    def tokens(self) -> DataFrame:
        """(media_id, chunk_index, pos, text, start, end) of the newest state of each chunk.
        The window asks for a chunk's rows in one task, which the buckets answer."""
        whole = Window.partitionBy(*CHUNK).orderBy("version", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self.states().drop("stamp").withColumn("_newest", F.max("version").over(whole))
        return rows.where("version = _newest and pos is not null").select(*CHUNK, "pos", "text", "start", "end")

    def stamps(self) -> DataFrame:
        """(media_id, chunk_index, stamp) of the newest states; those of chunks that are gone have none."""
        last = self.states().groupBy(*CHUNK).agg(F.max_by("stamp", "version").alias("stamp"))
        return last.where("stamp is not null")

    def append(self, rows: DataFrame, mode: str = "append", path: str | None = None) -> None:
        to = rows.repartition(self.buckets, *CHUNK).write.format("parquet").mode(mode).bucketBy(self.buckets, *CHUNK).sortBy(*ORDER)
        (to.option("path", path) if path else to).saveAsTable(self.name)


def opened(spark: SparkSession, name: str) -> TokenTable:
    """A table that is there already."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return TokenTable(spark, name, int(told["Num Buckets"]))


def _version(spark: SparkSession) -> Column:
    return F.lit(spark.sql("SELECT unix_micros(now())").first()[0]).cast("long")


def _states(tokens: DataFrame, stamp: Column, version: Column) -> DataFrame:
    return tokens.select(*CHUNK, F.col("pos").cast("long").alias("pos"), "text", "start", "end", stamp.cast("string").alias("stamp"), version.alias("version"))


def write_tokens(tokens: DataFrame, name: str, buckets: int, path: str | None = None) -> TokenTable:
    """A new table ``name`` of these tokens, below ``path`` or in the warehouse. An old one of the name is replaced."""
    table = TokenTable(tokens.sparkSession, name, buckets)
    table.append(_states(tokens, F.lit(""), _version(tokens.sparkSession)), "overwrite", path)
    return table


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(media_id, chunk_index, stamp, size) of the chunks with token files below ``root``;
    the stamp tells their sizes and times. Only names, sizes and times are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tokens.json").load(root)
    rows = files.artifacts(rows.select("path", "length", "modificationTime"), "modificationTime").where("kind = 'tokens' and chunk_index is not null")
    told = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "size", F.unix_micros("modificationTime")))), ",")
    return rows.groupBy(*CHUNK).agg(told.alias("stamp"), F.sum("size").alias("size"))


def compact(spark: SparkSession, root: str, name: str, buckets: int | None = None, path: str | None = None) -> TokenTable:
    """Bring table ``name`` up to date with the token files below ``root``, and make it where it is not there.

    New and changed chunks are appended, chunks whose file has gone are marked. An invalid file,
    and one without tokens, gives its chunk no tokens, not those of before. Where nothing
    has changed nothing is written. Many small files are read by one task, as Spark
    packs them; without ``buckets`` a new table has as many as their bytes ask for.
    """
    now = listed(spark, root).persist()
    try:
        if spark.catalog.tableExists(name):
            table, mode = opened(spark, name), "append"
            old = table.stamps()
            fresh = now.join(old, [*CHUNK, "stamp"], "left_anti")
            gone = old.join(now, list(CHUNK), "left_anti")
            if fresh.isEmpty() and gone.isEmpty():
                return table
        else:
            size = now.agg(F.sum("size")).first()[0] or 0
            table, mode = TokenTable(spark, name, buckets or max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))), "overwrite"
            fresh, gone = now, now.where(F.lit(False))
        fresh = fresh.select(*CHUNK, "stamp")
        parsed = files.parse_token_json(files.whole_files(spark, root, "*.tokens.json").where("chunk_index is not null")).join(fresh, list(CHUNK))
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        # a row without token stands for each state, so that a state without tokens hides the one before
        marks = fresh.unionByName(gone.select(*CHUNK, F.lit(None).cast("string").alias("stamp"))).select(*CHUNK, none("pos", "long"), none("text", "string"), none("start", "double"), none("end", "double"), "stamp")
        found = parsed.where("items is not null").select(*CHUNK, "stamp", F.posexplode("items").alias("pos", "t")).select(*CHUNK, F.col("pos").cast("long").alias("pos"), "t.text", "t.start", "t.end", "stamp")
        rows = marks.unionByName(found)
        table.append(_states(rows, F.col("stamp"), _version(spark)), mode, path if mode == "overwrite" else None)
        return table
    finally:
        now.unpersist()


def tidied(table: TokenTable, name: str, path: str | None = None) -> TokenTable:
    """A new table ``name`` of the newest states only, one file a bucket, as many buckets. The
    old one stays, so that jobs that read it go on."""
    whole = Window.partitionBy(*CHUNK).orderBy("version", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = table.states().withColumn("_newest", F.max("version").over(whole)).where("version = _newest and stamp is not null").drop("_newest")
    new = TokenTable(table.spark, name, table.buckets)
    new.append(rows, "overwrite", path)
    return new
