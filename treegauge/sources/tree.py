"""A directory tree as a batch source: metadata only, nothing is opened.

Registered as format `filetree`.  Every executor must see the tree at the same
path.  Planning lists folders level by level until there are enough of them to
share out; each task then walks its own folders and streams Arrow batches.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import DIR, FILE, FILES, LINK, OTHER

# Marker rows that are counted and never stored as entries.
UNREADABLE_DIR, PRUNED = "unreadable", "pruned"
BATCH_ROWS = 10_000


class Folders(InputPartition):
    """Folders one task lists; `deep` ones are walked to the bottom."""

    def __init__(self, folders: list[str], deep: bool):
        super().__init__(0)
        self.folders, self.deep = folders, deep


class TreeReader(DataSourceReader):
    def __init__(self, options):
        root = os.path.expanduser(options.get("path") or "")
        if not root:
            raise ValueError("filetree needs a path")
        self.root = root.rstrip("/") or "/"
        deny = options.get("deny", "")
        self.deny = tuple(os.path.expanduser(d).rstrip("/")
                          for d in deny.split("\n") if d)
        self.tasks = int(options.get("tasks", "64"))
        if self._denied(self.root):
            raise ValueError("the root to scan is denied: %s" % self.root)

    def _denied(self, path: str) -> bool:
        return any(path == d or path.startswith(d + "/") for d in self.deny)

    def _listed(self, folder: str):
        """Rows of one folder, links as themselves, vanished entries skipped."""
        try:
            with os.scandir(folder) as entries:
                found = list(entries)
        except OSError:
            yield folder, UNREADABLE_DIR, 0, 0, 0, 0
            return
        for entry in found:
            if self._denied(entry.path):
                yield entry.path, PRUNED, 0, 0, 0, 0
                continue
            try:
                st = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            mode = st.st_mode
            kind = (LINK if stat.S_ISLNK(mode) else DIR if stat.S_ISDIR(mode)
                    else FILE if stat.S_ISREG(mode) else OTHER)
            yield entry.path, kind, st.st_size, st.st_mtime_ns, st.st_ino, st.st_dev

    def partitions(self):
        flat, level, seen = [], [self.root], set()
        while level and len(level) < self.tasks:
            below = []
            for folder in level:
                for path, kind, _s, _m, inode, dev in self._listed(folder):
                    if kind == DIR and (dev, inode) not in seen:
                        seen.add((dev, inode))
                        below.append(path)
            flat += level
            level = below
        shares = [Folders(level[i::self.tasks], True)
                  for i in range(min(self.tasks, len(level)))]
        shares += [Folders(flat[i::self.tasks], False)
                   for i in range(min(self.tasks, len(flat)))]
        return shares or [Folders([], False)]

    def read(self, partition):
        import pyarrow as pa

        names = ("path", "kind", "size", "mtime_ns", "inode", "dev")
        types = (pa.string(), pa.string()) + (pa.int64(),) * 4
        schema = pa.schema(list(zip(names, types)))
        pending, seen, rows = list(partition.folders), set(), []
        while pending:
            for row in self._listed(pending.pop()):
                rows.append(row)
                if partition.deep and row[1] == DIR and (row[5], row[4]) not in seen:
                    seen.add((row[5], row[4]))
                    pending.append(row[0])
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return TreeReader(self.options)


def walk(spark: SparkSession, root: str, deny: list[str] | None = None,
         tasks: int | None = None) -> DataFrame:
    """Every entry below `root` plus marker rows; the root itself has none."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree").option("deny", "\n".join(deny or []))
    return reader.option("tasks", str(
        tasks or spark.sparkContext.defaultParallelism * 4)).load(root)


def entries(walked: DataFrame) -> DataFrame:
    return walked.filter(F.col("kind").isin(FILE, DIR, LINK, OTHER))


def walk_counts(walked: DataFrame) -> DataFrame:
    return walked.agg(
        F.count_if(~F.col("kind").isin(UNREADABLE_DIR, PRUNED)).alias("kept"),
        F.count_if(F.col("kind") == UNREADABLE_DIR).alias("unreadable"),
        F.count_if(F.col("kind") == PRUNED).alias("pruned"))
