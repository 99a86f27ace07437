"""Helpers that keep ordered and per-key work spread over the cluster.

A scan (or file, or fingerprint) may hold a third of all rows, so nothing here puts one key's rows
into one task: ordered work runs on range blocks that are stitched by a small table of block
totals, and top-n runs in a salted stage before the final one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: number of salts used to split a key before its final stage
SALTS = 32
#: a frame is broadcast only when its measured row count is at most this
BROADCAST_ROWS = 100_000
#: default size of a file split
SPLIT_BYTES = 128 << 20
#: planned bytes of an input of costly per-row work that go to one task
SPREAD_BYTES = 4 << 20
#: counted rows of costly per-row work that go to one task
SPREAD_ROWS = 25_000
#: a key is heavy from this many rows on
HEAVY_ROWS = 1_000_000
#: counted rows, distinct by their keys, that a task may hold in a hash table for a join
HASH_ROWS = 500_000
_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's ``spark.checkpoint.dir``.

    The context's own checkpoint folder serves where the setting is missing. Only a local master
    without either falls back to a temporary folder, which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], ignore_errors=True)
    return _LOCAL_ROOT[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage, survives executors)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], label: str, aligned: bool = False) -> tuple[str, DataFrame]:
    """Write ``df`` once in hash buckets of ``keys``; its folder and a frame that joins on ``keys`` without a shuffle.

    There are as many buckets as shuffle partitions, so the other side of a join comes in the same split. ``aligned`` says
    that ``df`` is split by ``keys`` already, as an aggregate by them is.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = f"bucketed_{uuid.uuid4().hex}"
    split = df if aligned else df.repartition(n, *keys)
    split.write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name, format="parquet")
    table = spark.table(name)
    # the frame knows its files and buckets; the catalog entry is not needed any more and goes without the files
    spark.sql(f"DROP TABLE {name}")
    return path, table


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores for costly per-row work on an input that is small but comes in few splits.

    Above one default split per core the input is left as it is: it has enough partitions already,
    and moving it would cost more than it brings. Below it tasks grow with the input (``SPREAD_BYTES``), so a task's memory does not.
    Counted ``rows`` that grow to many (a text to its lines) go to a task
    by ``SPREAD_ROWS``, so that what a task folds doesn't grow with the input.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(cores, -(-size // SPREAD_BYTES) if rows is None else -(-rows // SPREAD_ROWS))
    return df.repartition(tasks) if size < cores * SPLIT_BYTES else df


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the measured ``rows`` is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sorted_side(df: DataFrame) -> DataFrame:
    """Ask for a sort-merge join with ``df``, whose size the planner can't know.

    Rows that come out of exploded or written texts are guessed by the bytes of the files they are made from, so the
    largest tables look small enough to be collected in the driver and broadcast.
    """
    return df.hint("merge")


def hashed_side(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a hash join that holds ``df`` if a task gets few of its counted ``rows``, so the other side is not sorted.

    Rows must be distinct by the join's keys, which makes the tasks' shares even.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if rows <= n * HASH_ROWS else df


def salt_of(*cols: Column | str, buckets: int = SALTS) -> Column:
    """Deterministic salt: a recomputed task assigns the same rows to the same salts."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt: Sequence[str],
    rank_col: str = "rank",
) -> DataFrame:
    """First ``n`` rows per key with their 1-based rank; the last task sees at most SALTS*n rows."""
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", salt_of(*salt))
        .withColumn("__rn", F.row_number().over(first))
        .where(F.col("__rn") <= n)
        .drop("__rn", "__salt")
        .withColumn(rank_col, F.row_number().over(last))
        .where(F.col(rank_col) <= n)
        .withColumn(rank_col, F.col(rank_col).cast("bigint"))
    )


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    label: str = "fold",
) -> DataFrame:
    """Running sums per key in ``order``, for keys of any size.

    Rows are range-partitioned by (keys, order) and each partition becomes a block. Sums run inside
    blocks, and every block adds the total of the same key's earlier blocks, which is a table of at
    most one row per (key, block). ``order`` must end in a unique column.
    """
    value_cols = {f"__v{i}": expr for i, expr in enumerate(sums.values())}
    ranged = (
        df.withColumns(value_cols)
        .repartitionByRange(*keys, *order)
        .withColumn("__block", F.spark_partition_id())
    )
    # The block number must be the same for both uses below, so it is written once.
    table = materialise(ranged, label)

    block_key = [*keys, "__block"]
    totals = table.groupBy(*block_key).agg(*[F.sum(v).alias(f"__t{v}") for v in value_cols])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in block_key],
        *[F.coalesce(F.sum(f"__t{v}").over(before), F.lit(0)).alias(f"__o{v}") for v in value_cols],
    )
    inside = (
        Window.partitionBy(*block_key)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = table.withColumns({f"__r{v}": F.sum(v).over(inside) for v in value_cols})
    on = [running[k].eqNullSafe(offsets[f"__k_{k}"]) for k in block_key]
    joined = running.join(offsets, on, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.col(f"__r{v}") + F.coalesce(F.col(f"__o{v}"), F.lit(0))).alias(name)
            for name, v in zip(sums, value_cols)
        ],
    )


def ordered_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based position of every row within its key, without a per-key task."""
    return ordered_fold(df, keys, order, {name: F.lit(1).cast("bigint")}, label="position")


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One whole row per key: the one with the smallest ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in set(keys)]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salt: Sequence[str],
    how: str = "left",
    buckets: int = SALTS,
) -> DataFrame:
    """Equi-join with a ``right`` of few or small rows, spreading every left key over salts.

    The right rows are copied once per salt, so a key that holds a third of ``left`` is joined by
    ``buckets`` tasks. For a large ``right`` use :func:`skewed_lookup`. Rows keep their multiplicity.
    """
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return (
        left.withColumn("__salt", salt_of(*salt, buckets=buckets))
        .join(spread, [*keys, "__salt"], how)
        .drop("__salt")
    )


def heavy_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Keys with at least ``rows`` rows (written once; there are at most total/rows of them)."""
    limit = HEAVY_ROWS if rows is None else rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return materialise(counts.where(F.col("__n") >= limit).select(*keys), "heavy")


def skewed_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salt: Sequence[str],
    how: str = "left",
    heavy: DataFrame | None = None,
    unsized: bool = False,
) -> DataFrame:
    """Equi-join with a large ``right``: only keys that are heavy in ``left`` are salted.

    Heavy keys are counted first (after map-side folding) unless given. Without any the join is a
    plain one; otherwise the right rows of heavy keys alone are copied per salt. ``unsized`` says that
    the planner can't know the size of ``right`` (see :func:`sorted_side`).
    """
    keys = list(keys)
    hot = heavy_keys(left, keys) if heavy is None else heavy
    n = hot.count()
    if n == 0:
        return left.join(sorted_side(right) if unsized else right, keys, how)
    flags = broadcast_if_small(hot.withColumn("__hot", F.lit(True)), n)
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(flags, keys, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return (
        left.join(flags, keys, "left")
        .withColumn("__salt", F.when(F.col("__hot"), salt_of(*salt)).otherwise(F.lit(0)))
        .drop("__hot")
        .join(sorted_side(copies) if unsized else copies, [*keys, "__salt"], how)
        .drop("__salt")
    )
