"""What the operators of this package share: tables, batches, cut lineage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treegauge.session import cut_lineage

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1 << 20
#: Bytes of rows that go to a Python worker at once, unless the session says otherwise.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet("%s/%s.parquet" % (sf_dir.rstrip("/"), name))


def settle(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder."""
    return cut_lineage(df)


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps shared files."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return "%s/%s-%s" % (shared.rstrip("/"), name, uuid.uuid4().hex)


def batches(df: DataFrame, work: Callable[[dict], dict], schema: str,
            start: Callable | None = None, text: str | None = None) -> DataFrame:
    """`mapInArrow` over bounded slices of rows.

    `work(columns)` gets a dict of Arrow columns and returns a dict of columns
    (lists, numpy or Arrow arrays) in the order of `schema`; with `start`, it
    gets `start()` (made once per task) as a second argument, whose `rest()`,
    if it has one, ends the task.  `text` names the column whose bytes bound a
    slice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (start(),) if start else ()
        for part in parts:
            for piece in slices(part, text):
                columns = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
                made = work(columns, *more)
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, f.type)
                     for v, f in zip(made.values(), out, strict=True)], schema=out)
        for own in more:
            getattr(own, "rest", lambda: None)()
        hand_back()

    _bound(df.sparkSession)
    return df.mapInArrow(run, schema)


def _bound(spark: SparkSession) -> None:
    """Batches of whole texts by bytes: ten thousand rows of them would lie in memory twice."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def hand_back() -> None:
    """At the end of a task: freed memory goes back, for the worker stays and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(part: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of `text`; a longer row is a piece of its own."""
    if text is None or part.num_rows == 0:
        yield part
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(part.column(part.schema.names.index(text))), 0)
    begin = held = 0
    for i, n in enumerate(sizes.to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield part.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield part.slice(begin)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty string."""
    return [t if t is not None else "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without decoding, null as empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]
