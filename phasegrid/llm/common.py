"""What the operators of this subpackage share: input columns, Arrow batches, shared folders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.session import scratch_path

#: white space between words in all contracts of this subpackage
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of every row; other columns go, whatever their names; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str,
             arrow: pa.Schema, max_bytes: int = 8 << 20) -> DataFrame:
    """Apply ``make()``, made once per task, to column lists of whole rows.

    Arrow batches are cut so that a call sees about ``max_bytes`` of data, at
    least one row; whatever the batch size of the session, a task's memory is
    bounded by that and by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


#: paths written inside each open ``scratch`` block, the innermost last
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def store(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared folder and read back: later steps do not repeat the work, and lineage ends here.

    Inside a ``scratch`` block the table lives as long as the block.
    """
    path = scratch_path(df.sparkSession, re.sub(r"\W", "_", name))
    for paths in _OPEN.get()[-1:]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose stored tables are removed at its end.

    The block's value stores a table outside of it, in the block around it if
    there is one: what is to outlast the block. Frames that still read a table of
    the block fail afterwards.
    """
    before = _OPEN.get()
    own: list[str] = []
    mark = _OPEN.set((*before, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _OPEN.set(before)
        try:
            return store(df, name)
        finally:
            _OPEN.reset(inside)

    try:
        yield keep
    finally:
        _OPEN.reset(mark)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
