"""Opening the files a scope selected.

Tasks open the files of their own rows, so bytes never cross a shuffle; only
the narrow catalogue rows were partitioned.  Output is cut into batches by
bytes, which keeps a task's memory flat whatever the files weigh.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.content import MAX_BYTES
from ..functions.paths import basename, dirname
from ..schemas import FILE

BATCH_BYTES = 16 << 20
BLOCK = 1 << 20


def read_bytes(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`path, size, mtime_ns, bytes`; NULL bytes above the cap or unreadable.

    The cap is decided on the catalogue's size, before anything is opened.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, weight = [], 0
        for batch in batches:
            for path, size, mtime in zip(batch["path"], batch["size"], batch["mtime_ns"]):
                raw = None
                if size <= max_bytes:
                    try:
                        with open(path, "rb") as handle:
                            raw = handle.read()
                    except OSError:
                        raw = None
                rows.append((path, size, mtime, raw))
                weight += len(raw or b"")
                if weight >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "size", "mtime_ns", "bytes"])
                    rows, weight = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "size", "mtime_ns", "bytes"])

    return files.select("path", "size", "mtime_ns").mapInPandas(
        run, "path string, size bigint, mtime_ns bigint, bytes binary")


def stored_bytes(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES,
                 glob: str | None = None) -> DataFrame:
    """The same rows from object storage, where tasks cannot open paths.

    The size limit reaches the source, so larger objects are listed and not
    fetched; they are not part of the answer.  Hidden names are skipped by the
    source, times are whole microseconds, and links are followed: for trees on
    a file system use the catalogue and `read_bytes`.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).filter(F.col("length") <= max_bytes).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.col("content").alias("bytes"))


def hash_files(files: DataFrame) -> DataFrame:
    """`path, digest`: sha256 in blocks, NULL when the file cannot be read."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            digests = []
            for path in batch["path"]:
                state = hashlib.sha256()
                try:
                    with open(path, "rb") as handle:
                        while block := handle.read(BLOCK):
                            state.update(block)
                    digests.append(state.hexdigest())
                except OSError:
                    digests.append(None)
            yield pd.DataFrame({"path": batch["path"], "digest": digests})

    return files.select("path").mapInPandas(run, "path string, digest string")


def ignore_files(files: DataFrame) -> DataFrame:
    """`base, text` of every ignore file the catalogue knows outside `.git`.

    Unreadable ones say nothing; broken UTF-8 is replaced, not refused.
    """
    known = files.filter((F.col("kind") == FILE) & (basename("path") == ".gitignore")
                         & ~F.contains("path", F.lit("/.git/")))
    raw = read_bytes(known, max_bytes=1 << 40)
    return raw.select(dirname("path").alias("base"), F.coalesce(
        F.make_valid_utf8(F.col("bytes").cast("string")), F.lit("")).alias("text"))
