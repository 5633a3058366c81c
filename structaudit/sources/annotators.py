"""Readings from pluggable annotators: whatever one does for an item, a failure is a row and not the end of the job.

An annotator is any object with a ``name`` and ``read(item)``, which returns readings as (raw, inchikey,
confidence). It may fail by raising, or by returning nothing and leaving a text in ``last_error``; returning
nothing without an error means that there was nothing to find.

:func:`annotate` runs annotators over the rows of a table. The ``readings`` data source is for annotators that
hold their items themselves, for instance a service: they also have ``slices()`` and ``items(slice)``, and each
slice of each annotator is read by its own task.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READING = "item_id bigint, read_no int, engine string, raw string, inchikey string, confidence double, error string"
_KINDS = pa.schema([
    ("item_id", pa.int64()), ("read_no", pa.int32()), ("engine", pa.string()), ("raw", pa.string()), ("inchikey", pa.string()),
    ("confidence", pa.float64()), ("error", pa.string()),
])


class Annotator(Protocol):
    name: str

    def read(self, item: Any) -> list[tuple[str, str | None, float | None]]: ...


def readings_of(annotator: Annotator, item_id: int, item: Any) -> Iterator[tuple]:
    """Rows of one item, numbered within the annotator; one row with an error if it failed, none if it found nothing."""
    found, error = [], None
    try:
        found = list(annotator.read(item))
    except Exception as failure:  # noqa: BLE001 - one annotator that fails must not take the others along
        error = f"{type(failure).__name__}: {failure}"
    if not found and error is None:
        error = getattr(annotator, "last_error", None)
    if error is not None:
        found = []
        yield item_id, 0, annotator.name, None, None, None, error
    for number, (raw, key, confidence) in enumerate(found):
        # NaN is how some annotators say that they have no confidence.
        yield item_id, number, annotator.name, raw, key, None if confidence is None or confidence != confidence else float(confidence), None


def annotate(items: DataFrame, make: Mapping[str, Callable[[], Annotator]], columns: list[str]) -> DataFrame:
    """Readings of every annotator for every row of ``items``; ``columns`` of a row are handed over as a dict.

    Annotators are made once per task and see rows in Arrow batches. ``read_no`` numbers an item's readings
    in the order of ``make``, so it must come from one row for each item.
    """
    makers = list(make.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annotators = [m() for m in makers]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.select(range(1, batch.num_columns)).to_pylist()
            out = []
            for item_id, row in zip(ids, rows, strict=True):
                number = 0
                for annotator in annotators:
                    for _, _, *rest in readings_of(annotator, item_id, row):
                        out.append((item_id, number, *rest))
                        number += 1
            columns_out = list(zip(*out, strict=True)) if out else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_out, _KINDS, strict=True)], schema=_KINDS)

    return items.select(F.col("item_id").cast("bigint"), *columns).mapInArrow(run, READING)


class _Slice(InputPartition):
    def __init__(self, maker: str, part: Any):
        self.maker, self.part = maker, part


def _made(path: str) -> Any:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


class _Reader(DataSourceReader):
    def __init__(self, makers: list[str]):
        self.makers = makers

    def partitions(self) -> list[InputPartition]:
        return [_Slice(maker, part) for maker in self.makers for part in _made(maker).slices()]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        annotator = _made(partition.maker)
        for item_id in annotator.items(partition.part):
            yield from readings_of(annotator, item_id, item_id)


class ReadingsSource(DataSource):
    """``spark.read.format("readings").option("annotators", "module:Name,module:Other")``."""

    @classmethod
    def name(cls) -> str:
        return "readings"

    def schema(self) -> str:
        return READING

    def reader(self, schema) -> _Reader:
        makers = [m.strip() for m in self.options.get("annotators", "").split(",") if m.strip()]
        if not makers:
            raise ValueError("name at least one annotator as module:Name")
        return _Reader(makers)


def register_readings(spark: SparkSession) -> None:
    spark.dataSource.register(ReadingsSource)
