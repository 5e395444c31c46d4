"""Source trees: which files of a listing count, what they are, and archives of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

# Entries that hold no source, and the size limit of a source file in bytes.
SKIPPED = ("node_modules", ".git", "__pycache__", "__MACOSX", ".venv", "venv", "dist", "build", ".next", "target", ".tox", ".pytest_cache")
MAX_BYTES = 500_000
# Marker files of package managers, the first one present wins.
PACKAGE_MARKERS = (("requirements.txt", "pip"), ("pyproject.toml", "pip/poetry"), ("Pipfile", "pipenv"), ("package.json", "npm/yarn"), ("go.mod", "go modules"), ("Gemfile", "bundler"), ("pom.xml", "maven"), ("build.gradle", "gradle"))
#: Bytes that an archive may unpack to, and its entries.
ARCHIVE_BYTES, ARCHIVE_ENTRIES = 1 << 30, 50_000


def visible(path: Column) -> Column:
    """No segment of the relative path is hidden or names a skipped entry."""
    return ~F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED))


def small_enough(length: Column) -> Column:
    return length <= MAX_BYTES


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path (relative), length, content. The size bound is pushed to the reader.

    Spark's reader leaves out files without a byte.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(small_enough(F.col("length")))
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    relative = F.when(at > 0, F.substring(F.col("path"), at + len(base), F.length("path"))).otherwise(F.col("path"))
    return files.select(relative.alias("path"), "length", "content").filter(visible(F.col("path")))


def package_manager(files: DataFrame) -> DataFrame:
    """Per project: the package manager whose marker comes first in the list."""
    spark = files.sparkSession
    markers = spark.createDataFrame([(k, f, m) for k, (f, m) in enumerate(PACKAGE_MARKERS)], "ord int, name string, manager string")
    return files.join(F.broadcast(markers), files["path"] == markers["name"]).groupBy("project").agg(F.min_by("manager", "ord").alias("manager"))


def common_root(names: DataFrame) -> DataFrame:
    """Per archive: the first segment that all entries share, or null."""
    first = F.substring_index("name", "/", 1)
    return names.groupBy("archive").agg(F.when((F.min(first) == F.max(first)) & F.max(F.col("name").contains("/")), F.min(first)).alias("root"))


def not_junk(name: Column) -> Column:
    """Not an artefact that an operating system puts into archives."""
    return ~F.exists(F.split(name, "/"), lambda p: p.isin("__MACOSX", ".DS_Store", "Thumbs.db") | p.startswith("._"))


def safe(name: Column) -> Column:
    """A relative path that stays below where it is unpacked."""
    return ~name.startswith("/") & ~name.contains("\\") & ~F.exists(F.split(name, "/"), lambda p: p == "..")


def unzip(archives: DataFrame, bytes_: int = ARCHIVE_BYTES, entries: int = ARCHIVE_ENTRIES) -> DataFrame:
    """Rows (archive, content) to one row per file: archive, name, content.

    Names that leave the folder and junk are left out. An archive over the limits fails the query,
    and so does one that can't be read; nothing is unpacked to disk.
    """

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = [x for x in z.infolist() if not x.is_dir()]
                    if len(inside) > entries or sum(x.file_size for x in inside) > bytes_:
                        raise ValueError(f"archive {archive} is over the limits")
                    for x in inside:
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [x.filename], "content": [z.read(x)]})

    found = archives.select("archive", "content").mapInArrow(entries_of, "archive string, name string, content binary")
    return found.filter(safe(F.col("name")) & not_junk(F.col("name")))


def zipped(files: DataFrame, bytes_: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (project, path, content) to one archive for each project: archive, content.

    Entries stand below the project's name, in the order of paths; build output isn't packed. An
    archive is one value, so a project over the limit fails the query.
    """

    def pack(rows: pa.Table) -> pa.Table:
        project, buffer = rows.column("project")[0].as_py(), io.BytesIO()
        if sum(map(len, rows.column("content").to_pylist())) > bytes_:
            raise ValueError(f"project {project} is over the limit")
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.sort_by("path").to_pylist():
                entry = zipfile.ZipInfo(f"{project}/{r['path']}")
                entry.external_attr = 0o644 << 16
                z.writestr(entry, r["content"], zipfile.ZIP_DEFLATED)
        return pa.table({"archive": pa.array([project], pa.string()), "content": pa.array([buffer.getvalue()], pa.binary())})

    kept = files.filter(~F.concat(F.lit("/"), "path").contains("/target/"))
    return kept.select("project", "path", F.col("content").cast("binary").alias("content")).groupBy("project").applyInArrow(pack, "archive string, content binary")


def fingerprint(files: DataFrame) -> DataFrame:
    """Per project: one digest that changes when any path or content does.

    The digests of its files are added up in four parts of 60 bits, so no order and no list is needed,
    and what is moved has the same size for any project.
    """
    one = F.sha2(F.concat_ws(":", "path", F.sha2(F.col("content").cast("binary"), 256)).cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring("_one", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = F.concat_ws(":", F.count("*").cast("string"), *[part(k).cast("string") for k in range(4)])
    return files.select("project", one.alias("_one")).groupBy("project").agg(F.sha2(sums.cast("binary"), 256).alias("fingerprint"), F.count("*").alias("files"))


def extensions(files: DataFrame) -> DataFrame:
    """Files of each extension."""
    return files.groupBy(T.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


#: A small corpus that comes with the package, as JSON lines.
SEED = """{"source_lang": "go", "source_api": ["strings.Split"], "source_code": "strings.Split(s, x)", "target_code": "s.split(x)", "package": "seed", "file": "split.go", "tier": "compile"}
{"source_lang": "python", "source_api": ["os.path"], "source_code": "os.path.join(a, b)", "target_code": "a.join(b)", "package": "seed", "file": "join.py", "tier": "behavior"}"""
