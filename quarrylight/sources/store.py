"""A run store on Parquet: tables partitioned by key, replaced key by key, upserted, versioned and reused by fingerprint.

Changes to any number of tables become visible in one commit.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_by_key(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """All rows of `new`, and those of `existing` whose key `new` does not have."""
    fresh = new.select(*keys).distinct()
    return existing.join(fresh, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """As replace_by_key, for rows that have a key of their own; of several new rows with one key the last (pos) stays."""
    others = [c for c in new.columns if c not in keys and c != "pos"]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("pos") if "pos" in new.columns else F.lit(0)).alias("x"))
    return replace_by_key(existing, last.select(*keys, "x.*"), *keys)


def overlay(rows: DataFrame, payload: str, kind: str) -> DataFrame:
    """Columns of a JSON payload, with the table's own columns over them."""
    own = set(rows.columns)
    held = rows.withColumn("_p", F.from_json(payload, kind))
    return held.select(*[c for c in rows.columns if c != payload], *[F.col(f"_p.{f}").alias(f) for f in held.schema["_p"].dataType.fieldNames() if f not in own])


def row_fingerprint(*columns: str) -> Column:
    """sha256 of a row's columns as text, nulls apart from empty text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in columns]
    return F.sha2(F.concat_ws("\x01", *cells), 256)


def fingerprint(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """by, fingerprint: sha256 over the hashes of the group's rows in order, so that row order does not matter.

    Rows are dealt by the first three digits of their hash: each part is hashed in order of its rows, then the parts' hashes in
    order of their digits. No task holds a group, and at most 4,096 parts of it meet.
    """
    hashed = rows.select(*by, row_fingerprint(*columns).alias("h")).withColumn("part", F.substring("h", 1, 3))
    parts = hashed.groupBy(*by, "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "h")))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("fingerprint"))


def reusable(artifacts: DataFrame, corpus_version: str, wanted: str | None = None) -> DataFrame:
    """The artifacts (corpus_version, fingerprint, ...) if there are any, all have the version, and the fingerprint is the
    wanted one; else no rows."""
    right = (F.col("corpus_version") == corpus_version) & (F.lit(True) if wanted is None else F.col("fingerprint") == wanted)
    verdict = artifacts.agg(F.coalesce(F.bool_and(F.coalesce(right, F.lit(False))), F.lit(False)).alias("ok"))
    return artifacts.crossJoin(F.broadcast(verdict)).where("ok").drop("ok")


#: Versions are folders of a partition column, so that one scan reads them all; no table may have a column of this name.
VERSION = "store_version"


class RunStore:
    """Tables under one folder, in numbered commits that span tables.

    <root>/<table>/store_version=v-<id>/...   versions of a table's partitions, written before the commit that names them
    <root>/_commits/<n>.json      for each table the folders that make it up after commit n, and its columns

    A writer claims a number by creating <n>.claim, which fails where it is there, and then renames its draft to <n>.json: of two
    writers one has to try again on what the other has made, a reader sees all of a commit or nothing, and a writer that dies
    leaves the old state. A claim without a commit for longer than PATIENCE seconds is taken for dead. Versions that no commit names
    are litter that `vacuum` removes. A table is read by one scan, however many versions make it up.
    """

    ATTEMPTS, PATIENCE = 200, 60
    COLUMNS = "#columns"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # commits

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, number: int | None = None) -> tuple[int, dict]:
        """The last commit's number and, by table, its folders (and under COLUMNS, by table, their schema); 0 and nothing before the
        first."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{number}.json"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _claim(self, number: int) -> bool:
        """Whether this writer has the number. Local file systems create exclusively by their own call only."""
        name = f"{self.root}/_commits/{number}.claim"
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        try:
            if self._fs.getScheme() == "file":
                files = self.spark._jvm.java.nio.file
                files.Files.createFile(files.Paths.get(self._path(name).toUri().getPath(), self.spark._sc._gateway.new_array(self.spark._jvm.java.lang.String, 0)), self.spark._sc._gateway.new_array(files.attribute.FileAttribute, 0))
            else:
                self._fs.create(self._path(name), False).close()
        except Py4JJavaError:
            if not self._fs.exists(self._path(name)):
                raise
            made = self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000
            if time.time() - made > self.PATIENCE and not self._fs.exists(self._path(f"{self.root}/_commits/{number}.json")):
                self._fs.delete(self._path(name), False)
            return False
        return True

    def _commit(self, number: int, state: dict) -> bool:
        """Whether commit `number` could be made."""
        final = self._path(f"{self.root}/_commits/{number}.json")
        if self._fs.exists(final) or not self._claim(number):
            return False
        draft = self._path(f"{self.root}/_commits/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        return bool(self._fs.rename(draft, final))

    def transaction(self) -> Transaction:
        """with store.transaction() as t: t.replace(...); ... — all tables change in one commit, or none if the block fails."""
        return Transaction(self)

    def vacuum(self) -> int:
        """Remove versions that the last commit does not name; returns how many. Not beside running writers or readers."""
        _, state = self._state()
        kept, gone = {f.split("/")[0] for t in self.tables(state) for f in state[t]}, 0
        for table in self.tables(state):
            for f in self._fs.listStatus(self._path(f"{self.root}/{table}")):
                name = f.getPath().getName()
                if name.startswith(f"{VERSION}=") and name not in kept:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    # tables

    def tables(self, state: dict | None = None) -> list[str]:
        return sorted(t for t in (self._state()[1] if state is None else state) if t != self.COLUMNS)

    def read(self, table: str, **where: object) -> DataFrame:
        """A table as of the last commit, with the rows that have the given values; partitions without them are not read."""
        return self._read(self._state()[1], table, **where)

    def _read(self, state: dict, table: str, **where: object) -> DataFrame:
        if table not in state:
            raise KeyError(table)
        columns = T.StructType.fromJson(state[self.COLUMNS][table])
        paths = [f"{self.root}/{table}/{folder}" for folder in state[table]]
        out = self.spark.read.schema(columns).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*columns.names)
        for column, value in where.items():
            out = out.where(F.col(column) == F.lit(value))
        return out

    def create(self, table: str, rows: DataFrame, *partitions: str) -> None:
        """Write a new table; fails if it is there."""
        with self.transaction() as t:
            t.create(table, rows, *partitions)

    def replace(self, table: str, rows: DataFrame, *keys: str, partitions: tuple[str, ...] = ()) -> None:
        """Replace the rows of the keys that `rows` has; the table is made if it is not there."""
        with self.transaction() as t:
            t.replace(table, rows, *keys, partitions=partitions)

    def upsert(self, table: str, rows: DataFrame, *keys: str, partitions: tuple[str, ...] = ()) -> None:
        with self.transaction() as t:
            t.upsert(table, rows, *keys, partitions=partitions)


class Transaction:
    """Changes to tables of a store, visible to nobody until the block ends well."""

    def __init__(self, store: RunStore):
        self.store, self.steps = store, []

    def __enter__(self) -> Transaction:
        return self

    def create(self, table: str, rows: DataFrame, *partitions: str) -> None:
        self.steps.append((table, rows, (), partitions, "create"))

    def replace(self, table: str, rows: DataFrame, *keys: str, partitions: tuple[str, ...] = ()) -> None:
        self.steps.append((table, rows, keys, partitions, "replace"))

    def upsert(self, table: str, rows: DataFrame, *keys: str, partitions: tuple[str, ...] = ()) -> None:
        self.steps.append((table, rows, keys, partitions, "upsert"))

    def insert(self, table: str, rows: DataFrame, *keys: str, partitions: tuple[str, ...] = ()) -> None:
        """Adds rows of new keys; fails where the table has one of them when the commit is made. Nothing is written again."""
        self.steps.append((table, rows, keys, partitions, "insert"))

    def __exit__(self, kind, value, trace) -> None:  # noqa: ANN001
        if kind is not None:
            return
        for _ in range(self.store.ATTEMPTS):
            number, state = self.store._state()
            for step in self.steps:
                self._apply(state, *step)
            if self.store._commit(number + 1, state):
                return
            time.sleep(0.05)
        raise RuntimeError(f"{self.store.ATTEMPTS} other writers were faster")

    def _apply(self, state: dict, table: str, rows: DataFrame, keys: tuple[str, ...], partitions: tuple[str, ...], how: str) -> None:
        """Writes the table's next version; where it is partitioned by its first key, only the partitions that `rows` touches."""
        if how == "create" and table in state:
            raise FileExistsError(f"{table} exists in {self.store.root}")
        name = f"{VERSION}=v-{uuid.uuid4().hex}"
        folders = state.get(table, [])
        if how == "insert":
            if folders and not self.store._read(state, table).join(rows.select(*keys), list(keys), "left_semi").isEmpty():
                raise FileExistsError(f"{table} has a row of these keys")
            fresh, kept = rows, folders
        elif how == "create" or not folders:
            fresh, kept = (upsert(rows.limit(0), rows, *keys) if how == "upsert" else rows), []
        elif partitions and partitions[0] in keys:
            fresh, kept = self._partly(state, table, rows, keys, partitions[0], how)
        else:
            kept, fresh = [], self._merged(state, table, folders, rows, keys, how)
        writer = fresh.write.partitionBy(*partitions) if partitions else fresh.write
        writer.parquet(f"{self.store.root}/{table}/{name}")
        state[table] = [*kept, name]
        known = state.setdefault(self.store.COLUMNS, {})
        have = T.StructType.fromJson(known[table]).fields if table in known and kept else []
        more = [f for f in fresh.schema.fields if f.name not in {h.name for h in have}]
        known[table] = json.loads(T.StructType([T.StructField(f.name, f.dataType, True) for f in (*have, *more)]).json())

    #: Partitions that a change may name one by one; one of more rewrites the table.
    NAMED = 10_000

    def _partly(self, state: dict, table: str, rows: DataFrame, keys: tuple[str, ...], column: str, how: str) -> tuple[DataFrame, list[str]]:
        """The rows of the partitions that `rows` touches, as they become, and the folders of the others."""
        folders = state[table]
        values = rows.select(F.col(column).cast("string")).distinct().limit(self.NAMED + 1).collect()
        if len(values) > self.NAMED:
            return self._merged(state, table, folders, rows, keys, how), []
        touched = {f"{column}={_folder(v[0])}" for v in values}
        whole = [f for f in folders if "/" not in f]
        split = [f"{f}/{p}" for f in whole for p in self._parts(table, f)] + [f for f in folders if "/" in f]
        old = [f for f in split if f.split("/")[1] in touched]
        return (rows if not old else self._merged(state, table, old, rows, keys, how)), [f for f in split if f.split("/")[1] not in touched]

    def _merged(self, state: dict, table: str, folders: list[str], rows: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
        have = self.store._read(state | {table: folders}, table)
        return upsert(have, rows, *keys) if how == "upsert" else replace_by_key(have, rows, *keys)

    def _parts(self, table: str, folder: str) -> list[str]:
        at = self.store._path(f"{self.store.root}/{table}/{folder}")
        return [f.getPath().getName() for f in self.store._fs.listStatus(at) if "=" in f.getPath().getName()]


def _folder(value: str | None) -> str:
    """A partition value as Spark writes it in a folder's name."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 0x20 else c for c in value)


def fetch_run(store: RunStore, tables: tuple[str, ...], run_id: str, order: dict[str, tuple[str, ...]] | None = None, **where: object) -> dict[str, DataFrame]:
    """The rows of a run in each table that has any, in the table's order; only the run's partitions are read. All tables are as of
    one commit."""
    _, state = store._state()
    out = {}
    for table in tables:
        if table in state:
            rows = store._read(state, table, run_id=run_id, **where)
            out[table] = rows.orderBy(*order[table]) if order and table in order else rows
    return out


def snapshot(run_id: str, startup: str, **artifacts: DataFrame) -> DataFrame:
    """Artifacts of a run as rows that no store is needed to understand: run_id, startup, kind, corpus_version, pos, payload (JSON
    with sorted keys). Each artifact is a frame with any columns, corpus_version among them or not."""
    out = None
    for kind, rows in artifacts.items():
        version = F.col("corpus_version").cast("string") if "corpus_version" in rows.columns else F.lit("unknown")
        payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
        one = rows.select(F.lit(run_id).alias("run_id"), F.lit(startup).alias("startup"), F.lit(kind).alias("kind"), version.alias("corpus_version"), payload.alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def new_run(store: RunStore, run_id: str | None = None, **about: object) -> str:
    """Append a run to the table `runs` and return its id: a given one, which must be new, or one of the time and a random part."""
    name = run_id or f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:12]}"
    row = store.spark.range(1).select(F.lit(name).alias("run_id"), F.current_timestamp().alias("created_at"), *[F.lit(v).alias(k) for k, v in about.items()])
    with store.transaction() as t:
        t.insert("runs", row, "run_id")
    return name


def save_run(spark: SparkSession, root: str, run_id: str, raw: dict[str, DataFrame], processed: dict[str, DataFrame]) -> str:
    """A run as a folder of JSON lines: raw/NAME, processed/NAME (a name may have folders of its own) and manifest.json, which is
    written last. Fails if the folder is there; a run that fails half way leaves none."""
    folder = f"{root.rstrip('/')}/{run_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        raise FileExistsError(folder)
    try:
        files = [save_json(rows, folder, name, part is raw) for part in (raw, processed) for name, rows in part.items()]
        manifest = {"run_id": run_id, "artifacts": sorted(f.removeprefix(f"{folder}/") for f in files)}
        stream = fs.create(path(f"{folder}/manifest.json"), False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
    except Exception:
        fs.delete(path(folder), True)
        raise
    return folder


def load_run(spark: SparkSession, folder: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All artifacts of a run's folder by name, as its manifest lists them."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    names = {a.split("/", 1)[1]: f"{folder}/{a}" for a in manifest["artifacts"]}
    return {name: load_json(spark, at, (schemas or {}).get(name)) for name, at in names.items()}


def save_json(rows: DataFrame, folder: str, name: str, raw: bool = False) -> str:
    """Rows as JSON lines under <folder>/raw or <folder>/processed; fails if they are there. Returns the path."""
    path = f"{folder.rstrip('/')}/{'raw' if raw else 'processed'}/{name}"
    rows.write.mode("error").json(path)
    return path


def load_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines or documents that were saved before; with the schema that is expected of them, or the one they show."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)
