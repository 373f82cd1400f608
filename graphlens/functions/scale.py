"""Building blocks that keep operators safe on skewed, very large inputs.

Rules followed everywhere in the package:

* "first wins" / "last wins" is an aggregate with a map-side combine
  (:func:`first_by`, :func:`last_by`), never a window over a hot group;
* positions inside a group that may be huge come from :func:`numbered`, which
  splits a hot group over range partitions;
* range joins go through :func:`overlap_join`, which spreads one hot key over
  many bins and never compares all pairs of a key;
* loops cut their lineage by writing a table to the shared folder
  (:func:`materialize`), so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows in memory are up to some 70 times as large as in a file of sorted names, where dictionaries hold them.
FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
LEAST_FILE_FACTOR = 32.0
#: Spark 4.1 takes a union of tables that are spread alike for one that is spread so too, then joins its partitions end to end.
UNION_SPREAD = "spark.sql.unionOutputPartitioning"
#: Shuffle files go when the step that wrote them is done, not when the driver's memory happens to be collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a side of a tile in :func:`tiled_join`.
TILE_SIDE = 4_000


def sized(spark: SparkSession) -> SparkSession:
    """The session, told that files unfold in memory, that a union is spread anew and that finished steps leave no shuffle files.

    Without the first a table of millions of rows in a file of a few MB is broadcast, without the second a join of a union may
    end with "Can't zip RDDs with unequal numbers of partitions".
    """
    if float(spark.conf.get(FILE_FACTOR)) < LEAST_FILE_FACTOR:
        spark.conf.set(FILE_FACTOR, str(LEAST_FILE_FACTOR))
    spark.conf.set(UNION_SPREAD, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by the session.

    Only a local session may fall back to a temporary folder: on a cluster the
    other machines could not read it.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = sized(df.sparkSession)
    path = f"{shared_dir(spark)}/graphlens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple."""
    return _pick(df, keys, order, cols, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the row with the largest ``order`` tuple."""
    return _pick(df, keys, order, cols, F.max_by)


def _pick(df, keys, order, cols, chooser):
    cols = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    if not cols:
        return df.select(*keys).distinct()
    return (
        df.groupBy(*keys)
        .agg(chooser(F.struct(*cols), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, start: int = 0) -> DataFrame:
    """Exact consecutive BIGINT numbers inside each group, also for a hot group and for NULL keys.

    The rows are range-partitioned on (keys, order), so a group of any size lies
    in consecutive slices; each slice is numbered alone and shifted by the sizes
    of the slices before it. Only one row per group and slice is shuffled again.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_key_{c}") for c in keys], F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)).cast("long")
    placed = ranged.withColumn("_rank", rank)
    same = F.col("_slice") == F.col("_of")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    joined = placed.join(offsets, same)
    return joined.withColumn(out, F.col("_rank") + F.col("_before") + F.lit(start - 1)).select(*df.columns, out)


def with_next(df: DataFrame, keys: Sequence[str], position: str, cols: dict[str, str]) -> DataFrame:
    """Add columns of the row at ``position + 1`` of the same group (NULL at the end).

    A join on (keys, position) instead of ``lead``: the join key is unique per
    row, so a group of any size is spread over all tasks.
    """
    following = df.select(
        *keys, (F.col(position) - 1).alias(position), *[F.col(c).alias(new) for c, new in cols.items()]
    )
    return df.join(following, [*keys, position], "left")


def tiled_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, side: int = TILE_SIDE) -> DataFrame:
    """Inner join on ``keys`` for an answer that holds every pair of a key: neither a hot key nor the pairs pass one task or a shuffle.

    The pairs of a key are cut into tiles of about ``side`` rows a side, by hashes of ``left_id`` and ``right_id``. Rows are
    repeated once per tile they meet, pairs only appear in the result; the tasks grow in number with the pairs. Both tables
    are read twice, so they should be stored ones.
    """
    keys = list(keys)
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_left")).join(right.groupBy(*keys).agg(F.count("*").alias("_right")), keys)
    pairs = sizes.agg(F.sum(F.col("_left").cast("double") * F.col("_right"))).first()[0] or 0
    tiles = sizes.select(*keys, F.ceil(F.col("_left") / side).alias("_rows"), F.ceil(F.col("_right") / side).alias("_columns"))

    def placed(df, name, own, other, across):
        rows = df.join(tiles, keys).withColumn(own, F.pmod(F.xxhash64(name), F.col(f"{own}s")))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1))).select(*df.columns, "_row", "_column")

    many = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(pairs / (2 * side * side)))
    down = placed(left, left_id, "_row", "_column", "_columns").repartition(many, *keys, "_row", "_column")
    return down.join(placed(right, right_id, "_column", "_row", "_rows"), [*keys, "_row", "_column"]).drop("_row", "_column")


def _bins(level: Column, start: str, end: str, width: int) -> Column:
    size = F.lit(width) * F.pow(F.lit(2), level)
    return F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: int = 16,
) -> DataFrame:
    """Pairs with equal ``keys`` whose closed integer ranges overlap, each once.

    A range of length n lives at the bin level whose bins are at least n wide,
    so it touches two bins at most. The shorter range of a pair is looked up at
    the level of the longer one. The join key is (keys, level, bin), hence a hot
    key spreads over its bins and rows that are far apart never meet.
    """
    (ls, le), (rs, re_) = left_range, right_range

    def levelled(df, start, end):
        length = F.greatest(F.col(end) - F.col(start) + 1, F.lit(1))
        level = F.greatest(F.ceil(F.log2(length / F.lit(float(width)))), F.lit(0)).cast("int")
        return df.filter(F.col(end) >= F.col(start)).withColumn("_level", level)

    left, right = levelled(left, ls, le), levelled(right, rs, re_)
    left_top = left.agg(F.max("_level")).first()[0]
    right_top = right.agg(F.max("_level")).first()[0]

    def own(df, start, end):
        return df.withColumn("_bin", F.explode(_bins(F.col("_level"), start, end, width)))

    def above(df, start, end, first: Column, top):
        top = F.lit(-1 if top is None else top)
        levels = F.when(first <= top, F.sequence(first, top)).otherwise(F.array().cast("array<int>"))
        return df.withColumn("_level", F.explode(levels)).withColumn(
            "_bin", F.explode(_bins(F.col("_level"), start, end, width))
        )

    on = [*keys, "_level", "_bin"]
    size = F.lit(width) * F.pow(F.lit(2), F.col("_level"))
    overlap = (
        (F.col(ls) <= F.col(re_))
        & (F.col(le) >= F.col(rs))
        & (F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / size))
    )
    short_left = above(left, ls, le, F.col("_level"), right_top).join(own(right, rs, re_), on)
    short_right = own(left, ls, le).join(above(right, rs, re_, F.col("_level") + 1, left_top), on)
    pairs = short_left.filter(overlap).unionByName(short_right.filter(overlap))
    return pairs.drop("_level", "_bin")
