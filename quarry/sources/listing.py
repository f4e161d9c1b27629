"""File trees as a Spark data source: format `tree`, folders under the roots dealt over the tasks.

Unlike Spark's own file listing it shows names that start with a dot, keeps nanosecond times, never follows
links, and does not enter folders that are pruned by name. A folder that can't be read gives a row with an
error. Register it with `spark.dataSource.register(TreeSource)`; roots must be readable at the same path on
every executor.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.filters import SKIPPED_FOLDERS, SKIPPED_PREFIX, Pruning
from ..schema import LISTING

#: The driver looks into folders, breadth first, until it has so many for the tasks, and deals them to so many partitions at most.
ENOUGH = 256


class Branch(InputPartition):
    """(root, folder, share) for one task: k of n parts of the folder with all below it, or None for its own files only."""

    def __init__(self, folders: list[tuple[str, str, tuple[int, int] | None]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, roots: Sequence[str], pruned: Sequence[str], folders: Sequence[str] = (), scopes: Sequence[str] = ()):
        self.pruning = Pruning(frozenset(pruned), (SKIPPED_PREFIX,) if pruned else (), tuple(folders), tuple(scopes))
        self.roots = [r for r in roots if self.pruning.begins(r)]

    def partitions(self) -> list[Branch]:
        """Folders for the tasks, breadth first until there are enough; the driver holds about twice ENOUGH of them, however the tree is made.

        A folder with more folders than that is not opened up here: ENOUGH tasks take a share each of what is in it, by the names' hash.
        """
        known, todo = [], deque((root, root) for root in self.roots)
        while todo and len(known) + len(todo) < ENOUGH:
            root, folder = todo.popleft()
            below = list(islice((e.path for e in self._entries(folder)[0] if self._enters(root, e)), ENOUGH + 1))
            if len(below) > ENOUGH:
                known += [(root, folder, (k, ENOUGH)) for k in range(ENOUGH)]
            else:
                known.append((root, folder, None))  # its own files; or a root that is a file
                todo += [(root, path) for path in below]
        known += [(root, folder, (0, 1)) for root, folder in todo]
        return [Branch(known[k::ENOUGH]) for k in range(min(ENOUGH, len(known)))] or [Branch([])]

    def _entries(self, folder: str) -> tuple[list[os.DirEntry], str | None]:
        """By lower-case name, links left out; nothing, and the reason, where the folder can't be read."""
        try:
            with os.scandir(folder) as it:
                return sorted((e for e in it if not e.is_symlink()), key=lambda e: e.name.lower()), None
        except (FileNotFoundError, NotADirectoryError):
            return [], None
        except OSError as e:
            return [], f"{type(e).__name__}: {e.strerror}"

    def _enters(self, root: str, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) and self.pruning.enters(root, entry.path)

    def read(self, partition: Branch) -> Iterator[tuple]:
        for root, folder, share in partition.folders:
            yield from self._walk(root, folder, share)

    def _walk(self, root: str, top: str, share: tuple[int, int] | None) -> Iterator[tuple]:
        """share: k of n parts of what is in the top folder, with all below; None: its own files."""
        if os.path.isfile(top):
            s = os.stat(top)
            yield top, root, s.st_size, s.st_mtime_ns, None
            return
        todo = [top]
        while todo:
            folder, below = todo.pop(), []
            entries, error = self._entries(folder)
            if error:
                yield folder, root, None, None, error
            if share and share[1] > 1 and folder == top:
                entries = [e for e in entries if zlib.crc32(os.fsencode(e.name)) % share[1] == share[0]]
            for e in entries:
                if self._enters(root, e):
                    below.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    try:
                        s = e.stat(follow_symlinks=False)
                        yield e.path, root, s.st_size, s.st_mtime_ns, None
                    except OSError:
                        yield e.path, root, None, None, None
            if share:
                todo += reversed(below)


class TreeSource(DataSource):
    """Options, JSON lists: roots, pruned (lower-case folder names), folders and scopes as in `filters.Pruning`."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> StructType:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        given = {k: json.loads(self.options.get(k, "[]")) for k in ("folders", "scopes")}
        return TreeReader(json.loads(self.options["roots"]), json.loads(self.options.get("pruned", json.dumps(sorted(SKIPPED_FOLDERS)))), **given)


def listed(spark: SparkSession, roots: Sequence[str], pruned: Sequence[str] | frozenset[str] = SKIPPED_FOLDERS, folders: Sequence[str] = (), scopes: Sequence[str] = ()) -> DataFrame:
    """path, root, size_bytes, mtime_ns of all files under the roots, and folders that can't be read with their error; a root that is missing gives none.

    pruned, folders, scopes: what is not walked, as in `filters.Pruning`.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("roots", json.dumps(list(roots))).options(pruned=json.dumps(sorted(pruned)), folders=json.dumps(list(folders)), scopes=json.dumps(list(scopes))).load()


def stated(paths: DataFrame) -> DataFrame:
    """The listing of single files, each its own root: paths that are gone give none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [row for path in batch.column("path").to_pylist() for row in TreeReader([path], ())._walk(path, path, None)]
            yield pa.RecordBatch.from_pylist([dict(zip(LISTING.names, r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("root", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("error", pa.string())]))

    return paths.select("path").mapInArrow(run, LISTING)


def gone(paths: DataFrame) -> DataFrame:
    """The paths where there is nothing any more; one that can't be looked at is not among them."""

    def is_gone(path: str) -> bool:
        try:
            os.lstat(path)
        except (FileNotFoundError, NotADirectoryError):
            return True
        except OSError:
            pass
        return False

    def run(batches):
        for batch in batches:
            yield batch.filter([is_gone(p) for p in batch.column("path").to_pylist()])

    return paths.select("path").mapInArrow(run, "path string")


def contents(files: DataFrame) -> DataFrame:
    """path, kind, content and failed of listed files, read in the tasks.

    A file that can't be read has a null content and the reason in failed, one that went meanwhile too.
    """

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("kind", pa.string()), ("content", pa.binary()), ("failed", pa.string())])
        for batch in batches:
            for path, kind in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                data, failed = None, None
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError as e:
                    failed = f"{type(e).__name__}: {e.strerror}"
                yield pa.RecordBatch.from_pydict({"path": [path], "kind": [kind], "content": [data], "failed": [failed]}, schema=kinds)

    return files.select("path", "kind").mapInArrow(run, "path string, kind string, content binary, failed string")
