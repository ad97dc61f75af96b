"""Tables that change together: one commit for all tables of a run.

The reference writes every table of a run in one database transaction.  Here
each run writes its rows to new folders, ``<root>/<table>/batch=<id>/…``, and
nothing that is live is touched.  A version, ``<root>/_versions/<n>.json``,
lists the live partition folders of every table.  The next version is made
last, by one rename that fails if that version exists by then.  So readers see
all tables of a run or none, whichever write a run dies in, and of two runs
that start from the same version one commits and the other has to be repeated.

A keyed append adds folders; a replace writes the touched partitions anew and
lists the new folders instead of the old ones.  ``compact`` merges the folders
of partitions that many small runs have added to, and ``vacuum`` deletes what
no kept version lists.

A table that grows by key has its key filters beside it (``<table>_keys``, see
``keyindex``), folder by folder under the same names.  A keyed append asks them
first and reads the rows of no folder that cannot hold one of its keys; a
folder without filters is read.

The driver holds the list of live folders (partitions times a bounded number of
folders, as any file listing), never rows.  Files are listed, written and
renamed through Hadoop's file system API, so a root may be any store Spark
reads; the rename must not overwrite, as on HDFS.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.session import staged
from tapeflow.sources.keyindex import FOLDER, key_filters, may_be_stored
from tapeflow.sources.sinks import CONFLICT_MODES, append_unique, check_keys, laid_out, one_per_key

VERSIONS = "_versions"
BATCH = "batch"
KEYS = "_keys"  # after a table's name: its key filters
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Partition columns whose values are written in a folder's name as they are.
PLAIN_TYPES = ("date", "tinyint", "smallint", "int", "bigint")


class ConcurrentCommitError(RuntimeError):
    """Another run committed since this one started; repeat it."""


@dataclass(frozen=True)
class Version:
    """A number and the live partition folders of each table, relative to it."""
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at, hadoop


def _names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    fs, at, _ = _files(spark, path)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at)
                  if s.isDirectory() or not folders)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/{VERSIONS}")
                  if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version ``number`` of the tables under ``root``, or the newest."""
    if number is None:
        known = _numbers(spark, root)
        if not known:
            return Version()
        number = known[-1]
    fs, at, _ = _files(spark, f"{root}/{VERSIONS}/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, json.loads(text)["tables"])


def _publish(spark: SparkSession, root: str, new: Version) -> None:
    """Make ``new`` the newest version, unless that number is taken."""
    folder = f"{root}/{VERSIONS}"
    fs, draft, hadoop = _files(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"tables": new.tables}).encode("utf-8")))
    finally:
        out.close()
    final = hadoop.Path(f"{folder}/{new.number:012d}.json")
    taken = fs.exists(final)
    if not taken:
        context = hadoop.FileContext.getFileContext(
            final.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
        none = spark.sparkContext._gateway.new_array(
            spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except Exception:
            if not fs.exists(final):
                raise
            taken = True
    if taken:
        fs.delete(draft, False)
        raise ConcurrentCommitError(f"version {new.number} of {root} exists already")


def _read(spark: SparkSession, root: str, name: str, folders: Sequence[str],
          schema=None) -> DataFrame:
    reader = spark.read.option("basePath", f"{root}/{name}")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*(f"{root}/{name}/{f}" for f in folders)).drop(BATCH)


def read_table(spark: SparkSession, root: str, name: str, schema=None,
               at: Version | None = None) -> DataFrame | None:
    """A table as of a version (the newest); None if it has no rows yet.
    With ``schema`` (of the stored columns without the partition columns) no
    file is opened to find it, and columns added since are NULL (S6)."""
    folders = (at or version(spark, root)).tables.get(name)
    return _read(spark, root, name, folders, schema) if folders else None


def _leaves(spark: SparkSession, root: str, name: str, batch: str, depth: int) -> list[str]:
    """Partition folders (``depth`` below the batch's) that were written."""
    out = [batch]
    for _ in range(depth):
        out = [f"{f}/{n}" for f in out
               for n in _names(spark, f"{root}/{name}/{f}", folders=True) if "=" in n]
    return out


def _partition(folder: str) -> str:
    """The partition values in a folder's name, without the batch."""
    return folder.partition("/")[2]


def _folder_names(df: DataFrame, partition_by: Sequence[str]) -> list[str] | None:
    """Names of the partition folders that ``df`` has rows of (as many as it
    will write); None if a value's text may be escaped in a folder's name."""
    if not partition_by or not _plain(df, partition_by):
        return None
    rows = df.select(*(F.col(c).cast("string") for c in partition_by)).distinct().collect()
    return [_folder_name(partition_by, r) for r in rows]


def _plain(df: DataFrame, partition_by: Sequence[str]) -> bool:
    types = dict(df.dtypes)
    return all(types[c] in PLAIN_TYPES for c in partition_by)


def _folder_name(partition_by: Sequence[str], values: Sequence[str | None]) -> str:
    return "/".join(f"{c}={NO_VALUE if v is None else v}" for c, v in zip(partition_by, values))


class Transaction:
    """Writes to any tables under ``root`` that become visible together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base = version(spark, root)
        self.batch = f"{BATCH}={uuid.uuid4().hex[:16]}"
        self.tables = {k: list(v) for k, v in self.base.tables.items()}
        self.new: dict[str, list[str]] = {}

    def table(self, name: str, schema=None, partitions: Sequence[str] | None = None
              ) -> DataFrame | None:
        """The table as it was when the transaction began; with ``partitions``
        (``column=value/…``) only the folders of those."""
        folders = self._live(name, partitions)
        return _read(self.spark, self.root, name, folders, schema) if folders else None

    def written(self, name: str, schema=None) -> DataFrame | None:
        """What this transaction has written to the table."""
        folders = self.new.get(name)
        return _read(self.spark, self.root, name, folders, schema) if folders else None

    def clear(self, name: str, partition: str) -> None:
        """Drop the rows of one partition (``column=value/…``) of a table."""
        self.tables[name] = [f for f in self.tables.get(name, []) if _partition(f) != partition]

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (),
              keys: Sequence[str] = (), replace: bool = False) -> None:
        """Add ``df`` to the table; with ``replace`` instead of all rows of
        the partitions it has rows of."""
        if name in self.new:
            raise ValueError(f"{name} is written already in this transaction")
        self._put(name, df, list(partition_by), list(keys), replace)

    def _put(self, name: str, df: DataFrame, partition_by: list[str], keys: list[str],
             replace: bool) -> None:
        path = f"{self.root}/{name}/{self.batch}"
        laid_out(df, partition_by, keys).write.partitionBy(*partition_by).parquet(path)
        new = _leaves(self.spark, self.root, name, self.batch, len(partition_by))
        old = self.tables.get(name, [])
        if replace:
            values = {_partition(f) for f in new}
            old = [f for f in old if _partition(f) not in values]
        self.new[name] = new
        self.tables[name] = old + new

    def write_unique(self, name: str, new: DataFrame, keys: Sequence[str], on_conflict: str,
                     partition_by: Sequence[str] = (), schema=None) -> None:
        """Keyed append (S7–S9): ``error``, ``skip`` or ``replace`` as in
        ``sinks``, against the table as it was when the transaction began.
        Only folders of partitions that the staged batch has rows of are read,
        and, but for a replace, only those that may hold one of its keys."""
        if on_conflict not in CONFLICT_MODES:
            raise ValueError(f"on_conflict must be one of {CONFLICT_MODES}")
        partition_by = list(partition_by)
        on = [*keys, *(c for c in partition_by if c not in keys)]
        batch = staged(new, "staged-batch")
        folders = self._live(name, _folder_names(batch, partition_by))
        if on_conflict != "replace":  # which rewrites all rows of its partitions
            folders = self._may_hold(name, folders, batch, list(keys), partition_by)
        existing = _read(self.spark, self.root, name, folders, schema) if folders else None
        if on_conflict == "error":
            check_keys(batch, existing, on, f" in {name}")
        else:
            batch = one_per_key(batch, on)
        if existing is not None and on_conflict == "skip":
            batch = batch.join(existing.select(*on), on, "left_anti")
        elif existing is not None and on_conflict == "replace":
            if partition_by:
                existing = existing.join(batch.select(*partition_by).distinct(), partition_by,
                                         "left_semi")
            batch = append_unique(batch, existing, on, "replace")
        self.write(name, batch, partition_by, keys, replace=on_conflict == "replace")
        self.index(name, keys, partition_by, on_conflict == "replace", schema)

    def _live(self, name: str, partitions: Sequence[str] | None) -> list[str]:
        """Live folders of the table, or of these partitions of it."""
        folders = self.base.tables.get(name, [])
        if partitions is None:
            return folders
        wanted = set(partitions)
        return [f for f in folders if _partition(f) in wanted]

    def _may_hold(self, name: str, folders: list[str], batch: DataFrame, keys: list[str],
                  partition_by: list[str]) -> list[str]:
        """Those of ``folders`` that may hold a key of ``batch``."""
        indexed = set(self.base.tables.get(f"{name}{KEYS}", []))
        asked = [f for f in folders if f in indexed]
        if not asked or not _plain(batch, partition_by):
            return folders
        hits = may_be_stored(batch, _read(self.spark, self.root, f"{name}{KEYS}", asked), keys,
                             partition_by)
        found = {"/".join(filter(None, [r[0], _folder_name(partition_by, r[1:])])) for r in
                 hits.select(FOLDER, *(F.col(c).cast("string") for c in partition_by)).collect()}
        return [f for f in folders if f not in indexed or f in found]

    def index(self, name: str, keys: Sequence[str], partition_by: Sequence[str] = (),
              replace: bool = False, schema=None) -> None:
        """Store the key filters of what this transaction has written."""
        rows = self.written(name, schema)
        if rows is not None and _plain(rows, partition_by):
            self._put(f"{name}{KEYS}", key_filters(rows, keys, partition_by, self.batch),
                      list(partition_by), ["block"], replace)

    def commit(self) -> Version:
        """Make all writes visible at once."""
        new = Version(self.base.number + 1, self.tables)
        _publish(self.spark, self.root, new)
        return new


def compact(spark: SparkSession, root: str, name: str, partition_by: Sequence[str],
            keys: Sequence[str] = (), most: int = 8) -> int:
    """Rewrite the partitions of a table that live in more than ``most``
    folders; the number of partitions rewritten.  Readers of older versions
    go on reading the old folders."""
    tx = Transaction(spark, root)
    live: dict[str, list[str]] = {}
    for f in tx.base.tables.get(name, []):
        live.setdefault(_partition(f), []).append(f)
    many = [f for folders in live.values() if len(folders) > most for f in folders]
    if not many:
        return 0
    tx.write(name, _read(spark, root, name, many), partition_by, keys, replace=True)
    if f"{name}{KEYS}" in tx.base.tables:
        tx.index(name, keys, partition_by, replace=True)
    tx.commit()
    return len({_partition(f) for f in many})


def vacuum(spark: SparkSession, root: str, keep: int = 10, older_than_hours: float = 24) -> int:
    """Delete batches that none of the newest ``keep`` versions lists and that
    are older than any running job, and the versions before those; the number
    of folders deleted."""
    numbers = _numbers(spark, root)
    kept = [version(spark, root, n) for n in numbers[-keep:]]
    limit = (time.time() - 3600 * older_than_hours) * 1000
    gone = 0
    for name in sorted({t for v in kept for t in v.tables}):
        live = {f.split("/")[0] for v in kept for f in v.tables.get(name, [])}
        for batch in _names(spark, f"{root}/{name}", folders=True):
            fs, at, _ = _files(spark, f"{root}/{name}/{batch}")
            if batch.startswith(f"{BATCH}=") and batch not in live \
                    and fs.getFileStatus(at).getModificationTime() < limit:
                gone += bool(fs.delete(at, True))
    for n in numbers[:-keep]:
        fs, at, _ = _files(spark, f"{root}/{VERSIONS}/{n:012d}.json")
        fs.delete(at, False)
    return gone
