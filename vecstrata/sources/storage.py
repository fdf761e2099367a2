"""Tables and versioned manifests behind one small interface.

A manifest is written under a name of its own and then renamed to that of the next
version, which must not exist: that is the compare-and-swap, and no reader ever
sees half a manifest.  The rename is atomic and refuses an existing name on HDFS;
on local folders the lock file keeps other writers out.  Object stores without
such a rename need a lock of their own.  What a manifest names must be there.  Tables are written before the
manifest that names them and never changed after, so a reader of a manifest
sees a frozen state, and a failed writer leaves files that nothing names.
``FileStorage`` goes through Spark's file systems, so any path that Spark can
open will do; ``MemoryStorage`` keeps cached DataFrames in this process.

Tables of nodes are laid out by shard: as bucketed tables in files, as cached
partitions in memory.  What groups or joins them by shard then reads each bucket in
one task and shuffles nothing.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..errors import IndexExistsError, IndexNotFoundError, InvalidArgumentError, ManifestConflictError, StorageError

#: Buckets of a table at most; more shards share them.
MOST_BUCKETS = 4096
#: Partitions of a table in memory for each task that the session runs at once, at most: a task then reads many small shards.
WAVES = 8
#: What may lie in an index folder; anything else keeps it from being destroyed.
OWN = {"manifest", "segments", "deltas", "quantizers", "log", "LOCK", "state.json"}


def check_manifest(manifest: dict, there: Callable[[str], bool]) -> None:
    """An error if a manifest names a table twice or one that is not there, or says what cannot be."""
    refs = [x["ref"] for x in manifest.get("segments", [])]
    changes = [x["ref"] for x in manifest.get("changes", [])]
    names = [*(f"segments/{r}" for r in refs), *(f"deltas/{r}" for r in changes)]
    if manifest.get("quantizer") is not None:
        names.append(f"quantizers/{manifest['quantizer']}")
    if len(set(refs)) != len(refs) or len(set(changes)) != len(changes) or any(x["count"] < 0 for x in [*manifest.get("segments", []), *manifest.get("changes", [])]) or manifest.get("epoch", 0) < 0 or manifest.get("max_node", 0) < 0:
        raise StorageError("the manifest is not valid")
    if lacking := [n for n in names if not there(n)]:
        raise StorageError(f"the manifest names what is not there: {', '.join(lacking)}")


class Storage(Protocol):
    spark: SparkSession
    uid: str

    def latest(self) -> dict | None: ...
    def publish(self, manifest: dict, expected: int) -> dict: ...
    def put(self, name: str, df: DataFrame, shards: int = 0) -> None: ...
    def get(self, name: str, shards: int = 0) -> DataFrame: ...
    def buckets(self, shards: int) -> int: ...
    def names(self, kind: str) -> list[str]: ...
    def drop(self, name: str) -> None: ...
    def state(self) -> dict: ...
    def set_state(self, state: dict) -> None: ...
    def close(self) -> None: ...


class MemoryStorage:
    """Tables as cached DataFrames.

    Where the session has a checkpoint folder, tables are cut off from how they were
    made, so that plans do not grow with the number of changes; else lost partitions
    come back from their lineage.
    """

    _named: dict[str, MemoryStorage] = {}
    _guard = threading.Lock()

    def __init__(self, spark: SparkSession, name: str = ""):
        self.spark, self.name, self.uid = spark, name, f"memory:{name or id(self)}"
        self.manifests: dict[int, dict] = {}
        self.tables: dict[str, DataFrame] = {}
        self.kept: dict = {}
        self.open = True
        self.lock = threading.Lock()
        self._parallel = spark.sparkContext.defaultParallelism  # as it was at first: all tables are dealt out alike

    def buckets(self, shards: int) -> int:
        return min(shards, MOST_BUCKETS, WAVES * self._parallel)

    def latest(self) -> dict | None:
        return json.loads(json.dumps(self.manifests[max(self.manifests)])) if self.manifests else None

    def publish(self, manifest: dict, expected: int) -> dict:
        check_manifest(manifest, self.tables.__contains__)
        with self.lock:
            if max(self.manifests, default=0) != expected:
                raise ManifestConflictError(f"version {expected} is no longer the latest")
            self.manifests[expected + 1] = manifest | {"version": expected + 1}
        return self.latest()

    def put(self, name: str, df: DataFrame, shards: int = 0) -> None:
        made = df if self.spark.sparkContext.getCheckpointDir() is None else df.checkpoint()
        self.tables[name] = (made.repartition(self.buckets(shards), "shard") if shards else made).persist()
        self.tables[name].count()

    def get(self, name: str, shards: int = 0) -> DataFrame:
        if name not in self.tables:
            raise StorageError(f"no table {name}")
        return self.tables[name]

    def names(self, kind: str) -> list[str]:
        return sorted({n.split("/")[1] for n in self.tables if n.startswith(f"{kind}/")})

    def drop(self, name: str) -> None:
        for n in [n for n in self.tables if n == name or n.startswith(f"{name}/")]:
            self.tables.pop(n).unpersist()

    def state(self) -> dict:
        return dict(self.kept)

    def set_state(self, state: dict) -> None:
        self.kept = dict(state)

    def close(self) -> None:
        """A storage without a name cannot be opened again, so its tables go."""
        self.open = False
        if not self.name:
            for df in self.tables.values():
                df.unpersist()
            self.tables.clear()


class FileStorage:
    """Parquet tables and JSON manifests below a folder."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False, lock: bool = True):
        self.spark, self.path, self.uid = spark, path.rstrip("/"), f"file:{path.rstrip('/')}"
        jvm = spark._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        there = self.exists()
        if create and there:
            raise IndexExistsError(self.path)
        if not create and not there:
            raise IndexNotFoundError(self.path)
        self.locked = False
        if lock:
            if not self._create("LOCK", spark.sparkContext.applicationId):
                raise StorageError(f"{self.path} is in use")
            self.locked = True
            self._repair()

    def exists(self) -> bool:
        return self.fs.exists(self._path("manifest"))

    def buckets(self, shards: int) -> int:
        """The same in every session: files keep it."""
        return min(shards, MOST_BUCKETS)

    def _write(self, name: str, text: str) -> None:
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        out = self.fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Have a small file appear whole; False if it exists already and is not to be replaced."""
        path = self._path(name)
        if not overwrite and self.fs.exists(path):
            return False
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/")
        self._write(draft, text)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if overwrite else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        qualified = lambda n: self.fs.makeQualified(self._path(n))
        try:
            context.rename(qualified(draft), qualified(name), how)
        except Exception:
            self.fs.delete(self._path(draft), False)
            if not overwrite and self.fs.exists(path):
                return False
            raise
        return True

    def _repair(self) -> None:
        """Remove versions at the end that can not be read, as a writer without a rename may leave them; drafts are in nobody's way."""
        for version in reversed(self._versions()):
            try:
                json.loads(self._read(f"manifest/v={version:012d}.json"))
                return
            except ValueError:
                self.fs.delete(self._path(f"manifest/v={version:012d}.json"), False)

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        if not self.exists():
            return []
        return sorted(int(s.getPath().getName()[2:-5]) for s in self.fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v=") and s.getPath().getName().endswith(".json"))

    def latest(self) -> dict | None:
        versions = self._versions()
        return json.loads(self._read(f"manifest/v={versions[-1]:012d}.json")) if versions else None

    def publish(self, manifest: dict, expected: int) -> dict:
        check_manifest(manifest, lambda name: self.fs.exists(self._path(name)))
        if max(self._versions(), default=0) != expected:
            raise ManifestConflictError(f"version {expected} is no longer the latest")
        made = manifest | {"version": expected + 1}
        if not self._create(f"manifest/v={expected + 1:012d}.json", json.dumps(made)):
            raise ManifestConflictError(f"version {expected + 1} exists")
        return made

    def _table(self, name: str) -> str:
        """What a bucketed table is called in the session's catalog, which only holds where it lies."""
        return f"vecstrata_{hashlib.sha1(f'{self.path}/{name}'.encode()).hexdigest()[:20]}"

    def put(self, name: str, df: DataFrame, shards: int = 0) -> None:
        """Names come from the latest manifest, so a table that is there already was left by an interrupted writer and goes."""
        if not shards:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            return
        self.drop(name)
        n = self.buckets(shards)
        df.repartition(n, "shard").write.format("parquet").bucketBy(n, "shard").sortBy("node_id").option("path", f"{self.path}/{name}").saveAsTable(self._table(name))

    def get(self, name: str, shards: int = 0) -> DataFrame:
        """A table; with its number of shards, one that was laid out by them, known to this session's catalog from then on."""
        if not self.fs.exists(self._path(name)):
            raise StorageError(f"no table {name}")
        plain = self.spark.read.parquet(f"{self.path}/{name}")
        if not shards:
            return plain
        if not self.spark.catalog.tableExists(self._table(name)):
            columns = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
            where = f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"create table {self._table(name)} ({columns}) using parquet clustered by (shard) sorted by (node_id) into {self.buckets(shards)} buckets location '{where}'")
        return self.spark.table(self._table(name))

    def names(self, kind: str) -> list[str]:
        path = self._path(kind)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {self._table(name)}")
        self.fs.delete(self._path(name), True)

    def state(self) -> dict:
        return json.loads(self._read("state.json")) if self.fs.exists(self._path("state.json")) else {}

    def set_state(self, state: dict) -> None:
        self._create("state.json", json.dumps(state), overwrite=True)

    def close(self) -> None:
        if self.locked:
            self.fs.delete(self._path("LOCK"), False)
            self.locked = False

    def destroy(self) -> None:
        """Delete the folder, but only if all in it is the index's own."""
        foreign = [s.getPath().getName() for s in self.fs.listStatus(self._path()) if s.getPath().getName() not in OWN and not s.getPath().getName().startswith(".")]
        if foreign:
            raise StorageError(f"{self.path} also holds {', '.join(sorted(foreign))}")
        for kind in ("segments", "deltas"):
            for name in self.names(kind):
                self.spark.sql(f"drop table if exists {self._table(f'{kind}/{name}')}")
        self.fs.delete(self._path(), True)
        self.locked = False


def parse_uri(uri: str) -> tuple[str, str]:
    """(kind, name or path) of ``memory:``, ``memory:<name>`` and ``file:<folder>``; other URIs with :// are folders too."""
    if not isinstance(uri, str) or ":" not in uri:
        raise InvalidArgumentError(f"not a URI: {uri!r}")
    scheme, _, rest = uri.partition(":")
    if scheme == "memory":
        return "memory", rest.removeprefix("//")
    if scheme == "file":
        path = rest.removeprefix("//")
        if not path:
            raise InvalidArgumentError("file: needs a folder")
        return "file", path
    if rest.startswith("//"):
        return "file", uri
    raise InvalidArgumentError(f"unknown scheme {scheme!r}")


def open_uri(spark: SparkSession, uri: str, create: bool) -> Storage:
    kind, name = parse_uri(uri)
    if kind == "file":
        return FileStorage(spark, name, create)
    with MemoryStorage._guard:
        held = MemoryStorage._named.get(name) if name else None
        if create:
            if held is not None:
                raise IndexExistsError(uri)
            held = MemoryStorage(spark, name)
            if name:
                MemoryStorage._named[name] = held
            return held
        if held is None:
            raise IndexNotFoundError(uri)
        if held.open:
            raise StorageError(f"{uri} is in use")
        held.open = True
        return held


def destroy_uri(spark: SparkSession, uri: str) -> None:
    kind, name = parse_uri(uri)
    if kind == "file":
        FileStorage(spark, name, lock=True).destroy()
        return
    with MemoryStorage._guard:
        held = MemoryStorage._named.get(name)
        if held is None:
            raise IndexNotFoundError(uri)
        if held.open:
            raise StorageError(f"{uri} is in use")
        del MemoryStorage._named[name]
