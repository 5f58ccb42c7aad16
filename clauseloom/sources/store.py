"""Keyed tables in levelled runs, several of them behind one manifest.

A batch writes, for each of its tables, a run: its rows, and the keys it
replaces (a replaced key without rows is gone). Nothing is seen of it until a
manifest that names its runs is put in place by one rename, so fields and
findings of a batch appear together or not at all, and a batch that was cut
short leaves only files that no manifest names. A repeated batch changes
nothing.

``fan`` runs of a level are merged into one of the next, the newest batch of a
key winning; a read therefore meets a number of runs that grows with the
logarithm of the number of batches. Runs are retired only after a manifest
without them is in place, and stay for readers of the manifest before.

Rows are dealt over the files of a run by leading bits of a hash of their key,
and the bits of each file are kept beside the run: a look-up of some keys opens
the files that hold their bits, not the history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

K = "contract_id"

#: Leading bits of a key's hash by which rows are dealt over files.
_BITS = 16
_PART = f"shiftright(_hash, {64 - _BITS})"


@dataclass(frozen=True)
class Snapshot:
    """What one manifest names: the last batch, each table's schema, and its runs, oldest first."""

    number: int = 0
    batch: int = -1
    schemas: dict[str, str] = field(default_factory=dict)
    runs: dict[str, list[dict]] = field(default_factory=dict)


class Batch:
    """The tables of a batch that is being written."""

    def __init__(self, store: Store, snapshot: Snapshot, batch_id: int):
        self.store, self.batch_id = store, batch_id
        self.done = batch_id <= snapshot.batch  # seen before: nothing to do
        self.written: dict[str, dict] = {}
        self.schemas: dict[str, str] = {}

    def write(self, table: str, rows: DataFrame, touched: DataFrame) -> DataFrame:
        """Write the rows that replace those of the touched keys; returns them as written."""
        path = f"{table}/run-{self.batch_id}-{uuid.uuid4().hex}"
        self.store._write(path, rows.withColumn("_batch", F.lit(self.batch_id)), touched.withColumn("_batch", F.lit(self.batch_id)))
        self.written[table] = {"path": path, "level": 0, "first": self.batch_id, "last": self.batch_id}
        self.schemas[table] = rows.schema.json()
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{path}/rows")


class Store:
    """Tables under ``root`` whose rows are replaced by key; one writer, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = (K,), fan: int = 4):
        if fan < 2:
            raise ValueError("fan is at least 2")
        self.spark, self.root, self.keys, self.fan = spark, root.rstrip("/"), list(keys), fan
        self.opened = 0  # files of rows and keys that the last look-up read

    # --- files ---

    def _fs(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _numbers(self) -> list[int]:
        fs, folder = self._fs("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest manifest, or one by number."""
        number = next(iter(self._numbers()[-1:]), 0) if number is None else number
        if not number:
            return Snapshot()
        fs, path = self._fs(f"manifest/{number:012d}.json")
        stream = fs.open(path)
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, snapshot: Snapshot) -> None:
        name = f"manifest/{snapshot.number:012d}.json"
        fs, path = self._fs(name)
        draft = self._fs(f"{name}.{uuid.uuid4().hex}")[1]
        out = fs.create(draft)
        out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"another writer has put manifest {snapshot.number} in place")

    def _retire(self, snapshot: Snapshot) -> None:
        """Delete runs and manifests that neither the newest manifest nor the one before names."""
        numbers = self._numbers()
        recent = [snapshot, self.snapshot(numbers[-2])] if len(numbers) > 1 else [snapshot]
        named = {r["path"] for s in recent for runs in s.runs.values() for r in runs}
        for table in snapshot.runs:
            fs, folder = self._fs(table)
            for status in fs.listStatus(folder):
                if f"{table}/{status.getPath().getName()}" not in named:
                    fs.delete(status.getPath(), True)
        for number in numbers[:-2]:
            fs, path = self._fs(f"manifest/{number:012d}.json")
            fs.delete(path, False)

    # --- writing ---

    @contextmanager
    def batch(self, batch_id: int) -> Iterator[Batch]:
        """Write the tables of a batch inside the block; they become visible together at its end, if it ends well."""
        before = self.snapshot()
        made = Batch(self, before, batch_id)
        yield made
        if made.done:
            return
        runs = {t: [*r] for t, r in before.runs.items()}
        for table, run in made.written.items():
            runs.setdefault(table, []).append(run)
        schemas = before.schemas | made.schemas
        runs = {t: self._merged(t, r, schemas[t]) for t, r in runs.items()}
        after = Snapshot(before.number + 1, batch_id, schemas, runs)
        self._publish(after)
        self._retire(after)

    def _write(self, path: str, rows: DataFrame, touched: DataFrame | None) -> None:
        """Write a run; without ``touched`` its keys are those of its rows, read back as written."""
        hashed = F.xxhash64(*self.keys).alias("_hash")
        names = [c for c in rows.columns if c != "_hash"]
        stored = self._write_part(f"{self.root}/{path}/rows", rows.select(*names, hashed))
        keys = (stored if touched is None else touched).select(*self.keys, "_batch", hashed)
        self._write_part(f"{self.root}/{path}/keys", keys.distinct())

    def _write_part(self, folder: str, df: DataFrame) -> DataFrame:
        # files of about one size: small parts are put together, and the part of a hot key is split
        dealt = df.withColumn("_part", F.expr(_PART)).hint("rebalance", F.col("_part")).drop("_part")
        dealt.sortWithinPartitions("_hash").write.mode("overwrite").parquet(folder)
        stored = self.spark.read.schema(df.schema).parquet(folder)
        held = stored.select(F.col("_metadata.file_name").alias("file"), F.expr(_PART).alias("part")).distinct()
        held.coalesce(1).write.mode("overwrite").parquet(f"{folder}-parts")
        return stored

    def _merged(self, table: str, runs: list[dict], schema: str) -> list[dict]:
        """The runs with every full level merged into the next. Levels fall from the oldest run to the newest."""
        while True:
            full = next((lv for lv in sorted({r["level"] for r in runs}) if sum(r["level"] == lv for r in runs) >= self.fan), None)
            if full is None:
                return runs
            old = [r for r in runs if r["level"] == full]
            path = f"{table}/run-{old[0]['first']}-{old[-1]['last']}-{uuid.uuid4().hex}"
            keys = self._newest(self._part(old, "keys", None))
            rows = self._of_newest(self._part(old, "rows", schema), keys)
            # with nothing older left to be hidden by a key without rows, the keys are those of the rows
            self._write(path, rows, None if old[0] is runs[0] else keys)
            at = runs.index(old[0])
            made = {"path": path, "level": full + 1, "first": old[0]["first"], "last": old[-1]["last"]}
            runs = [*runs[:at], made, *[r for r in runs[at:] if r not in old]]

    # --- reading ---

    def _same(self):
        return F.expr(" AND ".join(["r._hash = n._hash", *(f"r.`{k}` <=> n.`{k}`" for k in self.keys)]))

    def _newest(self, keys: DataFrame) -> DataFrame:
        return keys.groupBy("_hash", *self.keys).agg(F.max("_batch").alias("_batch"))

    def _of_newest(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of each key's newest batch."""
        return rows.alias("r").join(keys.alias("n"), self._same() & F.expr("r._batch = n._batch"), "left_semi")

    def _schema(self, part: str, schema: str | None, first: str) -> StructType | None:
        if part == "rows":
            own = StructType.fromJson(json.loads(schema))
            return StructType([f for f in own if f.name not in ("_batch", "_hash")]).add("_batch", "integer").add("_hash", "long")
        return self.spark.read.parquet(first).schema

    def _part(self, runs: list[dict], part: str, schema: str | None, files: list[str] | None = None) -> DataFrame:
        """The rows or keys of some runs, or of some of their files."""
        folders = [f"{self.root}/{r['path']}/{part}" for r in runs]
        shape = self._schema(part, schema, folders[-1])
        if files is not None and not files:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*(folders if files is None else files))

    def _files(self, runs: list[dict], part: str, hashes: DataFrame) -> list[str]:
        """The files that hold the bits of one of the hashes; only names reach the driver."""
        held = None
        for run in runs:
            folder = f"{self.root}/{run['path']}/{part}"
            own = self.spark.read.schema("file string, part long").parquet(f"{folder}-parts")
            own = own.select(F.concat(F.lit(folder + "/"), "file").alias("file"), "part")
            held = own if held is None else held.unionByName(own)
        looked_up = hashes.select(F.expr(_PART).alias("part")).distinct()
        return [r["file"] for r in held.join(looked_up, "part").select("file").distinct().collect()]

    def read(self, table: str, keys: DataFrame | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The current rows of a table; with ``keys``, those of these keys, from the files that can hold them."""
        snapshot = snapshot or self.snapshot()
        if table not in snapshot.schemas:
            raise KeyError(f"no batch has written table {table}")
        runs, schema = snapshot.runs[table], snapshot.schemas[table]
        names = StructType.fromJson(json.loads(schema)).names
        if keys is None:
            found = self._of_newest(self._part(runs, "rows", schema), self._newest(self._part(runs, "keys", None)))
            return found.select(*[F.col(f"r.`{c}`") for c in names])
        wanted = keys.select(*self.keys).distinct().withColumn("_hash", F.xxhash64(*self.keys))
        files = {part: self._files(runs, part, wanted.select("_hash").distinct()) for part in ("keys", "rows")}
        self.opened = sum(map(len, files.values()))
        some = self._newest(self._part(runs, "keys", None, files["keys"]))
        some = some.alias("n").join(wanted.alias("r"), self._same(), "left_semi")
        return self._of_newest(self._part(runs, "rows", schema, files["rows"]), some).select(*[F.col(f"r.`{c}`") for c in names])
