"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows are handed to a function in groups of about this many bytes, so that a
#: batch of very long texts is not turned into Python objects all at once.
GROUP_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame,
    inputs: list[str],
    added: str,
    work: Callable[[], Callable[[list[tuple]], list[tuple]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (by default all) and new ones from row-wise Python.

    ``work()`` runs once per task and returns a function from a list of tuples
    of ``inputs`` to as many tuples of the ``added`` columns. Kept columns pass
    through as Arrow data, untouched. No row moves between tasks, and a lost
    task is simply run again. An added column replaces one of the same name.
    """
    new = StructType.fromDDL(added)
    keep = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    needed = list(dict.fromkeys([*keep, *inputs]))
    schema = StructType([*[df.schema[c] for c in keep], *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            for part in _slices(batch):
                rows = do(list(zip(*[part.column(needed.index(c)).to_pylist() for c in inputs],
                                   strict=True)))
                made = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow,
                                                            strict=True)]
                kept = [part.column(i) for i in range(len(keep))]
                fields = [*[part.schema.field(i) for i in range(len(keep))], *arrow]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=pa.schema(fields))

    return df.select(*needed).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    each = max(1, int(batch.num_rows * GROUP_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)
