"""A table of keyed rows in the shared folder, with numbered versions.

A version is a manifest that lists parts; a part holds rows that were put and keys that were taken away by one commit, and a
row counts if no later part has its key. A commit writes its part first and then creates the manifest of the next number,
which only one writer can: the other one gets ``Conflict``, reads again and repeats its change. Readers hold a number and see
nothing of later commits. A writer that is lost leaves a part that no manifest names, or an empty manifest, which the next
writer turns into a repetition of the version before it. The cost of a commit follows the rows that it changes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.bm25 import sized


class Conflict(Exception):
    """Another writer has made the version that this one was to be."""


class VersionedTable:
    #: Seconds after which an empty manifest counts as that of a lost writer.
    PATIENCE = 60.0
    #: Parts of a version beyond which a commit writes the whole table anew.
    PARTS = 16

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str]) -> VersionedTable:
        """A table whose version 1 has these rows; a key that stands twice is an error."""
        out = cls(rows.sparkSession, path, key)
        part = out._write(rows, None)
        twice = out.spark.read.parquet(part["rows"]).groupBy(*out.key).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"{twice.first()} stands more than once")
        out._publish(1, {"parts": [part], "note": "create"})
        return out

    # ------------------------------------------------------------ manifests

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _publish(self, version: int, manifest: dict) -> None:
        fs = self._fs()
        try:
            out = fs.create(self._at(self._manifest(version)), False)
        except Exception as error:
            if fs.exists(self._at(self._manifest(version))):
                raise Conflict(f"version {version} of {self.path} is there") from error
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _read(self, version: int) -> dict | None:
        fs, at = self._fs(), self._at(self._manifest(version))
        size = fs.getFileStatus(at).getLen()
        if not size:
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of the versions, those of writers at work or lost left out."""
        files = self._fs().listStatus(self._at(f"{self.path}/versions"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files if f.getLen() and f.getPath().getName().endswith(".json"))

    def version(self) -> int:
        return self.versions()[-1]

    def history(self) -> list[tuple[int, str]]:
        return [(v, self._read(v)["note"]) for v in self.versions()]

    def repair(self) -> int | None:
        """The number of a lost writer's empty manifest, which becomes a repetition of the version before; none if there is none."""
        fs, last = self._fs(), self.version()
        at = self._at(self._manifest(last + 1))
        if not fs.exists(at) or fs.getFileStatus(at).getLen() or time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < self.PATIENCE:
            return None
        fs.delete(at, False)
        self._publish(last + 1, self._read(last) | {"note": "lost writer"})
        return last + 1

    # ------------------------------------------------------------ reading

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last one if none is named."""
        parts = self._read(version or self.version())["parts"]
        out, later = None, None
        for part in reversed(parts):
            rows = self.spark.read.parquet(part["rows"])
            if later is not None:
                rows = rows.join(sized(later), self.key, "left_anti")
            out = rows if out is None else out.unionByName(rows)
            touched = self.spark.read.parquet(part["rows"]).select(*self.key)
            if part["gone"]:
                touched = touched.unionByName(self.spark.read.parquet(part["gone"]))
            later = touched if later is None else later.unionByName(touched)
        return out

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, gone: DataFrame | None) -> dict:
        folder = f"{self.path}/parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/rows")
        if gone is not None:
            gone.select(*self.key).write.parquet(f"{folder}/gone")
        return {"rows": f"{folder}/rows", "gone": f"{folder}/gone" if gone is not None else None}

    def commit(self, rows: DataFrame, gone: DataFrame | None, base: int, note: str = "") -> int:
        """Put ``rows`` in the place of those of their keys and take the keys of ``gone`` away, on top of version ``base``.

        The number of the new version, or ``Conflict`` where another writer was first; the part that was written then stays
        unnamed until ``vacuum``.
        """
        part = self._write(rows, gone)
        manifest = {"parts": [*self._read(base)["parts"], part], "note": note}
        if len(manifest["parts"]) > self.PARTS:
            whole = self.snapshot(base).join(rows.select(*self.key), self.key, "left_anti")
            whole = whole if gone is None else whole.join(gone.select(*self.key), self.key, "left_anti")
            manifest["parts"] = [self._write(whole.unionByName(self.spark.read.parquet(part["rows"])), None)]
        self._publish(base + 1, manifest)
        return base + 1

    def apply(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame | Callable[[DataFrame], DataFrame], note: str = "", tries: int = 5) -> int:
        """Replace the rows of ``keys`` (a table, or what gives it from the rows of a version) by what ``change`` makes of them:
        rows that it leaves out are taken away, keys that it adds are added. After a conflict it is done again on the new version."""
        for _ in range(tries):
            self.repair()
            base = self.version()
            now = self.snapshot(base)
            named = (keys(now) if callable(keys) else keys).select(*self.key).distinct()
            old = now.join(sized(named), self.key, "left_semi")
            new = change(old).select(*now.columns)
            try:
                return self.commit(new, old.join(new.select(*self.key), self.key, "left_anti").select(*self.key), base, note)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests but for the last ``keep`` and the parts that these do not name; the number of parts deleted.
        Parts of writers at work must not be there."""
        fs, known = self._fs(), self.versions()
        for v in known[:-keep]:
            fs.delete(self._at(self._manifest(v)), False)
        named = {p["rows"].rsplit("/", 1)[0] for v in known[-keep:] for p in self._read(v)["parts"]}
        stray = [f.getPath() for f in fs.listStatus(self._at(f"{self.path}/parts")) if not any(n.endswith("/" + f.getPath().getName()) for n in named)]
        for p in stray:
            fs.delete(p, True)
        return len(stray)
