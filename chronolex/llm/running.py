"""Running sums over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.llm.common import cut


def running_sums(df: DataFrame, ranges: list[Column], order: list[Column], sums: list[str], keep: list[str | Column]) -> DataFrame:
    """The rows' ``keep`` columns with ``up_to_x`` for each x of sums: its sum over all rows up to this one, in the order given.

    Rows are dealt out by range of ``ranges``, which must not contradict ``order``, and sorted by
    order; a task adds up its own range, and a row per range, as many as there are partitions, tells what came
    before. The summed columns must not be null or negative. Ties go either way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*order).select(*keep, *sums)
    schema = T.StructType([*dealt.schema.fields, T.StructField("_range", T.IntegerType()), *[T.StructField(f"up_to_{s}", T.LongType()) for s in sums]])
    arrow, names = to_arrow_schema(schema), list(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for b in batches:
            if not b.num_rows:
                continue
            more = {f"up_to_{s}": so_far[s] + np.cumsum(b.column(s).to_numpy(zero_copy_only=False), dtype=np.int64) for s in names}
            so_far = {s: int(more[f"up_to_{s}"][-1]) for s in names}
            more = {"_range": np.full(b.num_rows, part, np.int32)} | more
            yield pa.RecordBatch.from_arrays([pa.array(more[f.name]) if f.name in more else b.column(f.name) for f in arrow], schema=arrow)

    local = cut(dealt.mapInArrow(add, schema))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("_range").agg(*[F.max(f"up_to_{s}").alias(f"_{s}") for s in sums])
    before = ends.select("_range", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums])
    out = local.join(F.broadcast(before), "_range")  # a row per partition
    return out.withColumns({f"up_to_{s}": F.col(f"up_to_{s}") + F.col(f"_{s}") for s in sums}).drop("_range", *[f"_{s}" for s in sums])
