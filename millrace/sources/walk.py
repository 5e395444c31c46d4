"""A source tree as a data source that prunes before it descends.

Hidden and skipped folders are never listed, links are not followed, and files without a byte count. The driver
lists folders from the root down until there are enough of them to share out; below that, tasks list.
Conditions on a file's length and path are taken over, so what they rule out is not read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from millrace.sources.tree import MAX_BYTES, SKIPPED

#: Folders that are shared out, about, and files of one task that the driver has listed.
TASKS, FILES = 256, 1000


def system_of(root: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return (fs.FileSystem.from_uri(root)) if "://" in root else (fs.LocalFileSystem(), root.rstrip("/") or "/")


def kept(name: str) -> bool:
    """An entry that is neither hidden nor of a name that holds no source."""
    return not name.startswith(".") and name not in SKIPPED


def entries(system, folder: str) -> list[tuple[str, bool, int]]:
    """Names in a folder, whether each is a folder, and its size; links and what can't be listed are left out."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                return [(e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
        except OSError:
            return []
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [(x.base_name, x.type == fs.FileType.Directory, x.size or 0) for x in found]


def listed(system, root: str, below: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Kept folders and files (with their sizes) right below a folder of the tree, by their paths in it."""
    folders, files = [], []
    for name, is_folder, size in sorted(entries(system, f"{root}/{below}" if below else root)):
        if kept(name):
            path = f"{below}/{name}" if below else name
            if is_folder:
                folders.append(path)
            else:
                files.append((path, size))
    return folders, files


class Share(D.InputPartition):
    """Files that are known and folders that are still to be listed."""

    def __init__(self, files: list[tuple[str, int]], folders: list[str]):
        self.files, self.folders = files, folders


class SourceTree(D.DataSource):
    """Format `source_tree`: rows (path, length, content) of the files below `path`, by their paths in it.

    `content` false leaves contents null. The root's own name doesn't matter. A folder that can't be listed has no files.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> D.DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("tasks", TASKS)), self.options.get("content", "true") == "true")


class TreeReader(D.DataSourceReader):
    def __init__(self, root: str, tasks: int, content: bool):
        self.root, self.tasks, self.content = root, tasks, content
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in ("path", "length") and type(f).__name__ in TESTS:
                self.tests.append((column[0], type(f).__name__, f.value))
            else:
                yield f

    def wanted(self, path: str, length: int) -> bool:
        row = {"path": path, "length": length}
        return all(TESTS[test](row[column], value) for column, test, value in self.tests)

    def partitions(self) -> list[D.InputPartition]:
        system, root = system_of(self.root)
        open_, files = [""], []
        while open_ and len(open_) < self.tasks:
            next_ = []
            for k, folder in enumerate(open_):
                inner, own = listed(system, root, folder)
                next_ += inner
                files += [x for x in own if self.wanted(*x)]
                if len(next_) + len(open_) - k - 1 >= self.tasks:
                    next_ += open_[k + 1 :]
                    break
            open_ = next_
        shares = [Share(files[k : k + FILES], []) for k in range(0, len(files), FILES)]
        return [*shares, *[Share([], open_[k :: self.tasks]) for k in range(min(self.tasks, len(open_)))]] or [Share([], [])]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, root = system_of(self.root)

        def rows(files: list[tuple[str, int]]) -> Iterator[tuple]:
            for path, length in files:
                if self.wanted(path, length):
                    content = None
                    if self.content:
                        with system.open_input_file(f"{root}/{path}") as f:
                            content = f.read()
                    yield path, length, content

        yield from rows(partition.files)
        open_ = list(partition.folders)
        while open_:
            inner, own = listed(system, root, open_.pop())
            open_ += inner
            yield from rows(own)


#: Conditions that the reader takes over.
TESTS: dict[str, Callable[[object, object], bool]] = {
    "EqualTo": lambda a, b: a == b,
    "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b,
    "GreaterThan": lambda a, b: a > b,
    "GreaterThanOrEqual": lambda a, b: a >= b,
    "In": lambda a, b: a in b,
    "StringStartsWith": lambda a, b: a.startswith(b),
    "StringEndsWith": lambda a, b: a.endswith(b),
    "StringContains": lambda a, b: b in a,
}


def scan(spark: SparkSession, root: str, content: bool = True, most: int = MAX_BYTES) -> DataFrame:
    """Files of up to `most` bytes below a folder: path, length, content.

    Python sources may take conditions over only where the session says so; this sets it and leaves it set, since
    what is returned is planned later.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    files = spark.read.format("source_tree").option("path", root).option("content", str(content).lower()).load()
    return files.filter(files["length"] <= most)


def planted(files: DataFrame, root: str) -> int:
    """Write rows (path, content) as files below a folder, from the tasks; gives how many. Equal paths overwrite one another."""
    import pyarrow as pa

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = system_of(root)
        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return sum(r["n"] for r in files.select("path", files["content"].cast("binary")).mapInArrow(write, "n bigint").groupBy().sum("n").toDF("n").na.fill(0).collect())
