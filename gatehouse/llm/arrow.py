"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.session import ship_package


ROWS_AT_ONCE = 1024


def with_columns(df: DataFrame, text: str, new: dict[str, T.DataType], make: Callable[[list], list],
                 keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns computed from one text column, batch by batch, in one narrow pass.

    ``make`` gets the texts of a batch (``None`` for null) and returns one array per new column, in order.  A new
    column replaces one of the same name.  With ``keep``, only those of the columns of ``df`` go along.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new.items()]
    source = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A part of a batch at a time: texts are held as Python strings only for so many rows.
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            arrays = batch.columns[:-1] + [a if isinstance(a, pa.Array) else pa.array(a) for a in make(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return map_in_arrow(source, run, T.StructType(fields))


def map_in_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, with this package at hand on the workers.  ``run`` finds columns by place: they are renamed on the way
    in, since names with dots cannot be passed."""
    ship_package(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; the fold rule of the classifiers.  A null key has the remainder of ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by the hash of the key: the same rows on every run.

    The rate of a label is ``per_label`` over its row count, so the expected size is bounded whatever the input.
    The counts come to the driver: one row per label.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < min(1.0, per_label / n)))
    return df.where(chosen)
