"""Repeatable pseudo-random numbers from keys, and small helpers on key lists."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_unit(*cols: Column | str, salt: str = "") -> Column:
    """A number in [0, 1) that depends only on the key, the same in every run and partitioning."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter table (domains, rates, levers) whose size is fixed by the caller's arguments."""
    return spark.createDataFrame(rows, schema)


def keyed_lookup(mapping: dict, col: Column | str) -> Column:
    """Value of ``col`` in a small fixed dictionary, null when absent."""
    col = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr if expr is not None else F.lit(None)


def exact_sum(value: Column, times: Column | None = None) -> Column:
    """Sum of numbers below 1e22, each to six decimals, without rounding in between: the same in every order of the rows.

    ``times`` is how often a row counts, a whole number.
    """
    value = value.cast("decimal(28,6)")
    return F.sum(value if times is None else value * times).cast("double")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="rollcall-checkpoint-")
    sc.setCheckpointDir(configured)


def shared_path(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder of the cluster, which the driver and all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/rollcall-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table that is read more than once as Parquet to the shared folder; its lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpivot_structs(df: DataFrame, keys: list[str], rows: list[Column], names: list[str]) -> DataFrame:
    """One output row per struct in ``rows``, without a shuffle."""
    item = F.explode(F.array(*rows)).alias("_item")
    return df.select(*keys, item).select(*keys, *[F.col(f"_item.{n}").alias(n) for n in names])


def parameter_structs(rows: list[tuple], schema: str) -> list[Column]:
    """Parameter rows as constants of the plan."""
    fields = [part.strip().split(" ") for part in schema.split(",")]
    return [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows]


def with_parameters(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Repeat every row for each parameter row (scenarios, packages, levels), inside the task.

    The parameter rows are a constant of the plan, so this is a projection: no join and no shuffle.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return (df.select("*", F.explode(F.array(*parameter_structs(rows, schema))).alias("_p"))
            .select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in names]))


def with_small_table(df: DataFrame, small: DataFrame) -> DataFrame:
    """Repeat every row for each row of a table whose size is bounded by its key domain (ages, grades).

    The small table travels as one array value; no join on a constant key, which would meet in one task.
    """
    names = small.columns
    packed = small.agg(F.collect_list(F.struct(*names))).scalar()
    return (df.withColumn("_rows", packed).select(*df.columns, F.explode("_rows").alias("_r"))
            .select(*df.columns, *[F.col(f"_r.{n}").alias(n) for n in names]))


BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a cohort, rate or code table once; broadcast it if its counted size allows, else join it by key."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= max_rows else df


DISTINCT_ROWS = 100_000


def per_distinct(df: DataFrame, cols: list[str], work, max_rows: int = DISTINCT_ROWS) -> DataFrame:
    """The columns that ``work`` adds to ``cols``, for all rows: each distinct value is worked on once and joined back.

    ``work`` gets the distinct values and returns one row for each, with ``cols`` unchanged. The values are written first,
    or the optimizer would push filters of ``work`` below the distinct, onto all rows. The result is written and counted;
    it is broadcast up to ``max_rows``, and joined by key beyond that. Nulls are a value like any other.
    """
    done = written(work(written(df.select(*cols).distinct())))
    new = [c for c in done.columns if c not in df.columns]
    done = done.select(*[F.col(c).alias(f"_k_{c}") for c in cols], *new)
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cols]
    return df.join(F.broadcast(done) if done.count() <= max_rows else done, on, "left").drop(*[f"_k_{c}" for c in cols])


def side_by_side(spark: SparkSession, *work) -> list:
    """Results of calls that do not wait for each other; their jobs share the executors. The first error is raised once all have ended."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]
