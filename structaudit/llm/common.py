"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structaudit.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, whichever executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of ``docs``; extra ones cannot clash with anything later.

    ``doc_id`` becomes a long and ``text`` a string, null stays null.
    """
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    return docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns or ("doc_id", "text")])


def slices(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to about ``most``; an index is never cut."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)
