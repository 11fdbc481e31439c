"""A data source that lists a tree of files.

``binaryFile`` leaves out hidden and empty files, both of which count here, so the
tree is walked by a Python source.  The driver opens the upper directories until there
are entries for all tasks, which read what lies below side by side.  Entries that can't be read, aren't regular or
have names that an index can't hold come with an error instead of failing the
scan.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinfold.functions.ship import ship

#: Partitions of a tree.
TASKS = 64
SCHEMA = "path string, size bigint, mod_ns bigint, type string, digest string, error string"


class TreePartition(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TreeSource(DataSource):
    """Options: path (the root), digest (true: hash the files too), tasks (partitions that a large tree is split into)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):  # noqa: ANN001, ANN201
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.digest = str(options.get("digest", "false")).lower() == "true"
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self) -> list[InputPartition]:
        """Directories are opened level by level until there are enough entries for all tasks."""
        names: list[str] = []
        dirs = [""]
        while dirs == [""] or dirs and len(names) + len(dirs) < self.tasks:
            below = []
            for d in dirs:
                try:
                    with os.scandir(os.path.join(self.root, d)) as entries:
                        for e in entries:
                            (below if e.is_dir(follow_symlinks=False) else names).append(f"{d}/{e.name}" if d else e.name)
                except OSError:
                    if not d:
                        raise
                    names.append(d)  # its task tells the error
            dirs = below
        names = sorted(names + dirs)
        return [TreePartition(names[i :: self.tasks]) for i in range(min(self.tasks, len(names)))] or [TreePartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.digest:
            yield from self._listed(partition)
            return
        rows: list[tuple] = []
        for row in self._listed(partition):
            rows.append(row)
            if len(rows) == WAITING:
                yield from self._hashed(rows)
                rows = []
        yield from self._hashed(rows)

    def _listed(self, partition: InputPartition) -> Iterator[tuple]:
        stack = partition.names[::-1]
        while stack:
            name = stack.pop()
            full = os.path.join(self.root, name)
            try:
                info = os.lstat(full)
                if stat.S_ISDIR(info.st_mode):
                    stack += sorted((f"{name}/{x}" for x in os.listdir(full)), reverse=True)
                    continue
            except OSError as e:
                yield _shown(name), None, None, None, None, e.strerror or str(e)
                continue
            if not stat.S_ISREG(info.st_mode):
                yield _shown(name), None, info.st_mtime_ns, "other", None, "not a regular file"
            elif "\n" in name or name.startswith("\t") or name[1:2] == ":" or not _valid(name):
                yield _shown(name), info.st_size, info.st_mtime_ns, "file", None, "unsupported name"
            else:
                yield name, info.st_size, info.st_mtime_ns, "file", None, None

    def _hashed(self, rows: list[tuple]) -> Iterator[tuple]:
        found = digests_of((os.path.join(self.root, r[0]), r[0], r[1], r[2]) for r in rows if r[5] is None)
        for row in rows:
            yield row if row[5] is not None else (*row[:4], *next(found))


#: Bytes read at once, and files whose contents may wait to be hashed together.
READ, WAITING = 1 << 22, 1000


def digests_of(files: Iterable[tuple[str, str, int | None, int | None]]) -> Iterator[tuple[str | None, str | None]]:
    """(digest, error) in the order of files: (place, name, size, time in ns).

    An empty file has the digest of its name.  A file whose size or time isn't the one given (null: any) is an error.  Long
    files are read in pieces; short ones are hashed together."""
    from twinfold.functions.blake3 import Blake3, blake3_many

    def settled() -> Iterator[tuple[str | None, str | None]]:
        found = iter(blake3_many([c for c, _, _ in waiting if c is not None]))
        for content, digest, error in waiting:
            yield (next(found).hex() if content is not None else digest), error

    waiting: list[tuple[bytes | None, str | None, str | None]] = []
    held = 0
    for place, name, size, mod_ns in files:
        content = digest = error = None
        try:
            with open(place, "rb") as f:
                content = f.read(READ)
                n = len(content)
                if n == READ:
                    state = Blake3()
                    state.update(content)
                    content = None
                    while piece := f.read(READ):
                        state.update(piece)
                        n += len(piece)
                    digest = state.digest().hex()
                after = os.fstat(f.fileno())
            if (size is not None and (n != size or after.st_size != size)) or (mod_ns is not None and after.st_mtime_ns != mod_ns):
                content, digest, error = None, None, "file changed while it was read"
            elif content is not None:
                content = content or name.encode()
        except OSError as e:
            content, digest, error = None, None, e.strerror or str(e)
        waiting.append((content, digest, error))
        held += len(content or b"")
        if held > 4 * READ or len(waiting) >= WAITING:
            yield from settled()
            waiting, held = [], 0
    yield from settled()


def _valid(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _shown(name: str) -> str:
    return name.encode("utf-8", "replace").decode()


def walk(spark: SparkSession, root: str, digest: bool = False) -> DataFrame:
    ship(spark).dataSource.register(TreeSource)
    return spark.read.format("tree").option("digest", str(digest).lower()).load(root)


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of a hashed tree."""
    files = found.where("error is null").select("path", "digest", "size", "mod_ns", F.lit(0).alias("flag"))
    return files, found.where("error is not null").select("path", "error")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of a tree without prior state."""
    return split(walk(spark, root, digest=True))


def rehash(root: str):  # noqa: ANN201
    """For rescan: adds digest and error to listed files by reading them under root."""

    def digest(stale: DataFrame) -> DataFrame:
        ship(stale.sparkSession)

        def run(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            for b in batches:
                found = list(digests_of((os.path.join(root, p), p, s, m) for p, s, m in zip(*(b.column(c).to_pylist() for c in ("path", "size", "mod_ns")))))
                columns = [b.column("path"), pa.array([d for d, _ in found], pa.string()), b.column("size"), b.column("mod_ns"), pa.array([e for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "digest", "size", "mod_ns", "error"])

        # Dealt anew, so the files of one directory are read by many tasks.
        return stale.select("path", "size", "mod_ns").repartition(TASKS).mapInArrow(run, "path string, digest string, size bigint, mod_ns bigint, error string")

    return digest


def root_name(path: str) -> str:
    """The clean local name of a root, or nothing if it isn't a folder."""
    return os.path.normpath(path) if os.path.isdir(path) else ""
