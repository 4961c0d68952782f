"""What the operators share: lineage cuts, seeded hashes and ranks without a hot partition."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: `[\x20\x09-\x0D]`.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one cell of a salted rank holds on average.
CELL_ROWS = 8_192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Only a session on one machine may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Writes `df` once to the shared folder and returns the written table: later jobs never rerun its lineage.
    `batch_rows` bounds the rows that Python workers get at once, for rows that are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        if batch_rows:
            spark.conf.set(setting, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *replaced: str) -> Column:
    """All columns of `df` (but those that an output replaces) as the struct `__row`, where no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in replaced]).alias("__row")


def with_fields(df: DataFrame, names: Sequence[str], ddl: str) -> T.StructType:
    """The schema of these columns of `df` and then of the DDL's."""
    return T.StructType([df.schema[c] for c in names] + T.StructType.fromDDL(ddl).fields)


def seeded(seed: int, *cols: Column | str) -> Column:
    """A 64-bit hash of the columns that stands for a draw; equal on every run and partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def drawn(seed: int, *cols: Column | str) -> Column:
    """A draw of 60 bits (the upper ones of a long) from the MD5 of the seed and the columns, null ones left out, as text
    between bars: any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.shiftleft(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), 4)


def salt_bits(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Bits of hash so that `rows` rows of one key fall into cells of about `cell_rows`."""
    return max(0, math.ceil(math.log2(max(1, rows) / cell_rows))) if rows > cell_rows else 0


def salted_rank(df: DataFrame, keys: Sequence[str], draw: str, ties: Sequence[str], rank: str, total: str, bits: int, extra: DataFrame | None = None) -> DataFrame:
    """Adds the 0-based `rank` by (`draw`, `ties`) within `keys` and the key's `total` rows.

    A key's rows are dealt over 2**`bits` cells by the high bits of their draw, so a key with a third of all
    rows is no single task's; a cell's first rank is the sum of the (pre-aggregated) counts of lower cells.
    The keys must not be null.
    """
    # the unsigned order of the draw, as a cell number and as a signed order within it
    cell = F.shiftrightunsigned(F.col(draw), 64 - bits) if bits else F.lit(0).cast("long")
    low = F.shiftleft(F.col(draw), bits) if bits else F.col(draw)
    df = df.withColumn("__cell", cell).withColumn("__low", F.shiftrightunsigned(low, 1))
    counts = df.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    if extra is not None:
        offsets = offsets.join(extra, list(keys))
    within = Window.partitionBy(*keys, "__cell").orderBy("__low", *ties)
    return df.withColumn("__in", F.row_number().over(within)).join(offsets, [*keys, "__cell"]).withColumn(rank, F.col("__before") + F.col("__in") - 1).drop("__cell", "__low", "__n", "__before", "__in")


#: Keys with more than one in so many rows are hot; there are at most so many of them.
HOT_SHARE = 200


def hot_keys(left: DataFrame, key: str) -> list:
    """The keys of more than one in HOT_SHARE rows: fewer than HOT_SHARE by their definition."""
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.orderBy(F.desc("__n")).limit(HOT_SHARE).collect()
    if not top or top[0]["__n"] < 2:
        return []
    least = left.count() / HOT_SHARE
    return [r[key] for r in top if r["__n"] > least]


def unskewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """`left` joined with the one row that `right` has for a key. Hot keys of `left` meet their rows of `right` by
    broadcast, where their own rows lie; the others are dealt by key."""
    hot = hot_keys(left, key) if hot is None else hot
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = left.filter(F.col(key).isNotNull() & ~is_hot).join(right, key, how)
    if hot:
        out = out.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))
    if how == "left":  # null keys meet nothing and would be dealt to one task
        out = out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    return out
