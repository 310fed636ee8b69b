"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from noticeflow.storage import discard, materialise, release_shuffles, shared_dir, tasks_for, work_dir  # noqa: F401 - operators take them from here

#: Rows of a result in one task, where its columns are few and short.
RESULT_ROWS = 100_000
#: Documents with crc32(doc_id as text) mod FOLDS = HELD_OUT are kept back from training.
FOLDS = 5
HELD_OUT = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows of the held-out fold; a null id belongs to no fold and counts as held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], rows: int = 512, chars: int = 1 << 24) -> DataFrame:
    """Apply a function of column lists, batch by batch, in Arrow.

    ``make`` runs once per task and returns the function, so expensive set-up isn't repeated. A batch is split into slices of at most ``rows`` rows
    (and of about ``chars`` bytes each), which bounds what is held as Python objects.
    """
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            step = max(1, min(rows, int(rows * chars / max(1, batch.nbytes)))) if batch.nbytes > chars else rows
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                result = apply({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(result[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def keep_arrow(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[bool]]], rows: int = 256) -> DataFrame:
    """The rows, with all their columns, for which a function of the texts says so; as map_arrow(), without a join back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(keep(part.column(part.schema.get_field_index(text)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def salt_count(rows: int, per_salt: int = 1_000_000, least: int = 64) -> int:
    """How many salts to spread a group of up to ``rows`` rows over, so that none has much over ``per_salt``."""
    return max(least, -(-rows // per_salt))


def running_total(df: DataFrame, group: list[str], order: list[str], name: str, salts: int, amount: str | None = None, first: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``amount`` (1 if not given) over the earlier rows of every group, without ever sorting a whole group in one task.

    Rows go to ``salts`` salts by a hash of the ``order`` columns, within the values of the columns ``first``, which come in their order. A window adds up the
    rows of each salt, and the sums of the earlier salts, one small row for each, are added. ``order`` should identify a row; rows equal in it come in any order.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    keys, each = [*group, *first, "__salt"], F.lit(1).cast("long") if amount is None else F.col(amount)
    before = Window.partitionBy(*group).orderBy(*first, "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*keys).agg(F.sum(each).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1 if amount is None else F.coalesce(F.sum(each).over(within), F.lit(0))
    return salted.withColumn("__own", own).join(starts, keys).withColumn(name, F.col("__start") + F.col("__own")).drop("__salt", "__own", "__start")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, salts: int) -> DataFrame:
    """Number the rows of every group from 0 without gaps, as running_total() does; rows equal in ``order`` get distinct numbers in any order."""
    return running_total(df, group, order, name, salts)
