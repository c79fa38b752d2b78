"""File sources: paired CSVs, sweep directories, dataset catalog.

All readers declare their schema (no inference pass over the data) and keep
the file name through ``_metadata`` so rows stay attributable without a
driver-side file loop.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns

# The four measurement columns of a sweep file, in file order.
SWEEP_COLUMNS = ("Frequency(Hz)", "Return Loss(dB)", "Phase(deg)", "Xs")
SWEEP_POINTS = 10001

MEASURES = ("freq_hz", "return_loss_db", "phase_deg", "xs")


def read_pairs(spark: SparkSession, x_path: str, y_path: str, key: str = "row_id",
               x_schema: T.StructType | None = None, y_schema: T.StructType | None = None,
               target: str = "target") -> DataFrame:
    """Predictors CSV + targets CSV joined on an explicit row key.

    When a file carries no key, each row gets its 0-based position in the order
    (file path, byte offset of the block, line in the block); the skew-safe
    :func:`ranked` makes the positions consecutive, so folders of several files
    pair by file order whatever the files' sizes.  With a key column the join is
    a plain equi-join.
    """
    def read(path, schema):
        r = spark.read.option("header", "true").option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
        return r.csv(path)

    x, y = read(x_path, x_schema), read(y_path, y_schema)
    if key not in x.columns:
        x = _with_position(x, key)
    if key not in y.columns:
        y = _with_position(y, key)
    y_cols = [c for c in y.columns if c != key]
    y = y.select(key, F.expr(f"try_cast(`{y_cols[0]}` AS DOUBLE)").alias(target))
    return align(numeric_columns(x, keep=[key]), y, key)


_PLACE = ("__path", "__block", "__line")


def _with_place(df: DataFrame) -> DataFrame:
    """File path, block offset and line order inside the block of every scanned row."""
    return df.select("*", F.col("_metadata.file_path").alias("__path"),
                     F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__line"))


def _with_position(df: DataFrame, key: str) -> DataFrame:
    from ..operators.ranking import ranked
    r = ranked(_with_place(df), list(_PLACE), name="__pos")
    return r.withColumn(key, F.col("__pos") - 1).drop(*_PLACE, "__pos")


def align(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictor rows paired with their target by key (inner join)."""
    return x.join(y, on=key, how="inner")


def alignment_report(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    """J1 check: matched keys and keys present on one side only (full outer)."""
    xk = x.select(F.col(key).alias("__xk"))
    yk = y.select(F.col(key).alias("__yk"))
    j = xk.join(yk, xk["__xk"] == yk["__yk"], "full_outer")
    return j.agg(
        F.count_if(F.col("__xk").isNotNull() & F.col("__yk").isNotNull()).cast("bigint").alias("n_matched"),
        F.count_if(F.col("__yk").isNull()).cast("bigint").alias("n_x_only"),
        F.count_if(F.col("__xk").isNull()).cast("bigint").alias("n_y_only"))


def stack(*dfs: DataFrame) -> DataFrame:
    """Stack batches of rows by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# --------------------------------------------------------------- sweep files

def parse_sweep_lines(lines: DataFrame) -> DataFrame:
    """Sweep lines (``value`` and its place) to measurements, bound by each file's own header names.

    The first line of a file names its columns; they may stand in any order and
    among others.  A column that the header lacks is NULL everywhere; text in a
    numeric column becomes NULL (``try_cast``); ``bad_line`` marks lines with
    another number of fields than the header.  Adds ``raw_<measure>`` texts and
    ``point_idx``, the 0-based number of the line inside its file: its place among
    the lines of its block, after those of the file's earlier blocks.
    """
    filled = F.trim("value") != ""
    blocks = lines.groupBy("__path", "__block").agg(
        F.min_by("value", "__line").alias("__top"), F.min("__line").alias("__least"), F.count_if(filled).alias("__n"))
    of_file = Window.partitionBy("__path").orderBy("__block")   # one row for each block of a file
    head = F.first("__top").over(of_file)
    blocks = blocks.select(F.col("__path").alias("__p"), F.col("__block").alias("__b"), head.alias("__head"), F.when(
        F.row_number().over(of_file) == 1, F.col("__least")).otherwise(-1).alias("__first"), F.when(
            F.row_number().over(of_file) > 1, F.sum("__n").over(of_file) - F.col("__n") - F.when(F.trim(head) != "", 1).otherwise(0))
        .otherwise(0).alias("__before"))
    # the window below needs the lines by the same keys; stored lines may be sized too low for what they hold in memory
    rows = lines.join(blocks.hint("merge"), (F.col("__path") == F.col("__p")) & (F.col("__block") == F.col("__b"))).where(
        (F.col("__line") > F.col("__first")) & filled)
    # a block is what one task reads of a file, so its lines are bounded however large the file is
    in_block = Window.partitionBy("__path", "__block").orderBy("__line")
    rows = rows.withColumn("point_idx", (F.col("__before") + F.row_number().over(in_block) - 1).cast("int"))
    clean = lambda x: F.trim(F.regexp_replace(x, "[\"\ufeff]", ""))
    rows = rows.withColumn("__names", F.transform(F.split("__head", ","), clean)) \
        .withColumn("__fields", F.transform(F.split("value", ","), clean))
    for c, n in zip(SWEEP_COLUMNS, MEASURES):
        at = F.array_position("__names", c).cast("int")
        text = F.when(at > 0, F.get("__fields", at - 1))
        rows = rows.withColumn(f"raw_{n}", F.when(text != "", text)) \
            .withColumn(n, F.col(f"raw_{n}").try_cast("double"))
    return rows.withColumn("bad_line", F.size("__fields") != F.size("__names")) \
        .drop("value", "__head", "__first", "__before", "__p", "__b", "__names", "__fields")


# Many small files share a task: Spark's usual cost of opening one (4 MB) leaves a task four to 32 of them.
OPEN_COST = 64 << 10
_OPEN_COST = "spark.sql.files.openCostInBytes"


@contextmanager
def _small_files(spark: SparkSession):
    """Scans planned inside deal files to tasks by ``OPEN_COST`` each."""
    before = spark.conf.get(_OPEN_COST)
    if str(before).isdigit() and int(before) <= OPEN_COST:
        yield
        return
    spark.conf.set(_OPEN_COST, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(_OPEN_COST, before)


def read_sweeps(spark: SparkSession, dirs: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """Every sweep CSV under ``dirs`` matching ``pattern`` as typed long rows.

    Output: ``part_id`` (index of the directory), ``file``, ``path``,
    ``point_idx`` (line order within the file), the four measurements as DOUBLE
    bound by header name, and ``bad_line``.
    """
    from ..session import write_table
    frames = []
    for i, d in enumerate(dirs):
        text = spark.read.option("pathGlobFilter", pattern).text(d)
        frames.append(_with_place(text).withColumn("file", F.element_at(F.split("__path", "/"), -1))
                      .withColumn("part_id", F.lit(i)))
    # many small files cost by the opening: they are opened once, later steps read the stored lines
    with _small_files(spark):
        lines = write_table(stack(*frames))
    # a path that stands under two directories of the list is two files
    rows = parse_sweep_lines(lines.withColumn("__path", F.concat_ws("\n", "part_id", "__path")))
    return rows.withColumn("__path", F.substring_index("__path", "\n", -1)).withColumnRenamed("__path", "path") \
        .drop("__block", "__line", *[f"raw_{n}" for n in MEASURES])


FOLDERS = 256


def write_sweeps(texts: DataFrame, root: str) -> str:
    """One file for each row of ``sweep`` (a unique name), ``text`` below ``root``; returns the pattern of the files' names.

    ``sweep=<name>`` is part of each path.  Files are dealt to folders, which the reader lists in parallel.  In a
    mounted folder (``file:``) tasks write each file aside and rename it, so an attempt that fails leaves none half written;
    Hadoop's local file system would start several processes for the permissions of each file.  Elsewhere
    Spark's writer makes one folder with one file for each.
    """
    dealt = texts.select(F.pmod(F.xxhash64("sweep"), F.lit(FOLDERS)).cast("int").alias("folder"), "sweep", "text")
    mounted = re.fullmatch(r"file:(?://)?(/.*)", root)
    if not mounted:
        (dealt.sortWithinPartitions("folder", "sweep").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("folder", "sweep").text(root))
        return "part-*"
    base = mounted[1].rstrip("/")

    def run(batches):
        made = set()
        for batch in batches:
            for folder, sweep, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{base}/folder={folder}"
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                aside = f"{at}/.{uuid.uuid4().hex}"
                with open(aside, "w", encoding="utf-8", newline="") as out:
                    out.write(text + "\n")
                os.replace(aside, f"{at}/sweep={sweep}.csv")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(base, exist_ok=True)
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return "*.csv"


def pair_parts(sweeps: DataFrame, readings: DataFrame) -> DataFrame:
    """I-th sweep directory pairs with the i-th target file, row by row.

    ``sweeps`` carries ``(part_id, seq, …)`` (one row per sweep, ``seq`` =
    the sweep's order inside its directory); ``readings`` carries
    ``(part_id, seq, target)``.  Equi-join on both keys.
    """
    return sweeps.join(readings, on=["part_id", "seq"], how="inner")


def dataset_status(spark: SparkSession, catalog: DataFrame, root: str) -> DataFrame:
    """S3: per dataset, are all target files present and is any predictor dir non-empty?

    ``catalog``: (dataset, role ∈ {'target','predictors'}, path).  The file
    listing comes from the binaryFile source with only ``path`` and
    ``length`` selected, so file contents are never read.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(root).select("path", "length"))
    listing = listing.withColumn("path", F.regexp_replace("path", "^file:", ""))
    listing = listing.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    c = catalog.withColumn("path", F.regexp_replace("path", "/+$", ""))
    # targets are files (match the path), predictors are directories (match the parent)
    by_file = listing.groupBy(F.col("path").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    by_dir = listing.groupBy(F.col("dir").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    keyed = by_file.withColumn("role", F.lit("target")).unionByName(
        by_dir.withColumn("role", F.lit("predictors")))
    hit = c.join(keyed, (c["path"] == keyed["key"]) & (c["role"] == keyed["role"]), "left") \
        .select(c["dataset"], c["role"], c["path"], keyed["n"])
    per_entry = hit.groupBy("dataset", "role", "path").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))
    return per_entry.groupBy("dataset").agg(
        F.bool_and(F.when(F.col("role") == "target", F.col("n_files") > 0)).alias("targets_ok"),
        F.bool_or(F.when(F.col("role") == "predictors", F.col("n_files") > 0)).alias("predictors_ok"),
    ).withColumn("valid", F.coalesce(F.col("targets_ok"), F.lit(False))
                 & F.coalesce(F.col("predictors_ok"), F.lit(False)))
