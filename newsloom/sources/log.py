"""A commit log over Parquet parts: numbered commits, put only if absent, name the parts that make up a version of a keyed table.

A writer first writes its rows to a part of its own, then puts commit `expected + 1`. The commit appears whole or not at all, and only one
writer can put a number: a loser gets Conflict, reads what the winner committed and tries again. So a reader always sees a whole version,
a crash before the commit leaves the last version as it was, and two writers lose nothing. Local folders put by a hard link, others by a rename that
does not replace; a store must offer one of the two.

A commit that adds records costs those records, not the table: it appends a part to the list. Of the records of one key that of the last part
counts; within a part keys are apart. After PARTS parts the writer writes one whole part again. A damaged commit counts as a taken number; the highest whole
commit below it is the version. Old commits, and parts that no kept commit names, are deleted once they are older than an hour and not among the last ones.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import small_enough

#: Parts of a version before they become one; versions and seconds that are kept at least.
PARTS, VERSIONS, SECONDS = 24, 5, 3600.0


class Conflict(Exception):
    """Another writer has put this version."""


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str | None, kept: Callable[[DataFrame], DataFrame] = lambda records: records, clock: Callable[[], float] = time.time, by: str | None = None):
        """key: None where all records of all parts count. kept: what of the records stays when parts become one. by: a column by which parts lie in folders."""
        self.spark, self.folder, self.schema, self.key, self.kept, self.clock, self.by = spark, folder.rstrip("/"), schema, key, kept, clock, by

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, of: str) -> dict[str, float]:
        """Names in a folder of the log, and when they were changed (seconds)."""
        path, fs = self._path(f"{self.folder}/{of}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    def _read(self, name: str) -> dict | None:
        """A commit; None if it is damaged or gone."""
        path, fs = self._path(f"{self.folder}/_log/{name}")
        jvm = self.spark.sparkContext._jvm
        try:
            stream = fs.open(path)
            try:
                found = json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            finally:
                stream.close()
            return found if isinstance(found, dict) and isinstance(found.get("parts"), list) else None
        except Exception as e:  # Py4J names the Java class only in the text
            if isinstance(e, ValueError) or "FileNotFoundException" in str(e) or "ChecksumException" in str(e):
                return None
            raise

    def _put(self, number: int, commit: dict) -> None:
        """Put a commit whole, or raise Conflict where its number is taken."""
        fresh, name = f"{self.folder}/_log/.{uuid.uuid4().hex}", f"{self.folder}/_log/{number:020d}.json"
        path, fs = self._path(fresh)
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(commit).encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(urlparse(fresh).path, urlparse(name).path)
            else:
                jvm = self.spark.sparkContext._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                target, _ = self._path(name)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path, target, none)
        except FileExistsError as e:
            raise Conflict(number) from e
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(number) from e
            raise
        finally:
            fs.delete(path, False)

    def versions(self) -> list[int]:
        """Numbers that are taken, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json") and not n.startswith("."))

    def current(self) -> tuple[int, dict]:
        """The highest taken number (0: none yet) and the highest whole commit."""
        taken = self.versions()
        for number in reversed(taken):
            commit = self._read(f"{number:020d}.json")
            if commit:
                return taken[-1], commit
        return (taken or [0])[-1], {"parts": []}

    def _table(self, parts: list[str]) -> DataFrame:
        """The records of parts; of one key that of the last part."""
        read = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{p}").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        if not read:
            return self.spark.createDataFrame([], self.schema)
        if self.key is None:
            return reduce(DataFrame.unionByName, read).select(self.schema.names)
        # the later parts are small: each holds what one run added
        later = reduce(DataFrame.unionByName, read[1:], read[0].limit(0))
        last = later.groupBy(self.key).agg(F.max("_part").alias("_last"))
        kept = later.join(last, self.key).filter("_part = _last").select(self.schema.names)
        base = read[0] if len(read) == 1 else read[0].join(small_enough(last.select(self.key)), self.key, "left_anti")
        nameless = later.filter(F.col(self.key).isNull())
        return reduce(DataFrame.unionByName, [base.select(self.schema.names), *([kept, nameless.select(self.schema.names)] if len(read) > 1 else [])])

    def load(self) -> DataFrame:
        return self._table(self.current()[1]["parts"])

    def part(self, name: str) -> DataFrame:
        """The records of one part as they were added."""
        return self._table([name])

    def _part(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows = rows.select(self.schema.names)
        (rows.write.partitionBy(self.by) if self.by else rows.write).parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, rows: DataFrame, expected: int | None = None, whole: bool = False, note: dict | None = None) -> int:
        """Add records (keys apart) to version `expected` (default: the current one), or with `whole` put them in place of all records; its number.

        note: what the commit says besides; what earlier ones said under other names goes on."""
        taken, now = self.current()
        if expected is not None and taken != expected:
            raise Conflict(expected + 1)
        parts = [] if whole else now["parts"]
        if len(parts) >= PARTS:
            parts = [self._part(self.kept(self._table(parts)))]
        note = now.get("note", {}) | (note or {})
        self._put(taken + 1, {"version": taken + 1, "at": self.clock(), "parts": [*parts, self._part(rows)], "note": note})
        self.clean()
        return taken + 1

    def change(self, change: Callable[[DataFrame], DataFrame], whole: bool = False, attempts: int = 10, note: dict | None = None) -> int:
        """Commit what `change` makes of the current records; made anew of what another writer has committed meanwhile."""
        for left in range(attempts - 1, -1, -1):
            number, now = self.current()
            try:
                return self.commit(change(self._table(now["parts"])), number, whole, note)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def clean(self, keep: int = VERSIONS, seconds: float = SECONDS) -> None:
        """Delete commits that are neither among the last `keep` nor younger than `seconds`, then such parts that no kept commit names.

        Parts and commits in the making are young, so none of another writer is touched.
        """
        old, logs = self.clock() - seconds, self._names("_log")
        taken = self.versions()
        _, now = self.current()
        # commits without a whole one after them stay
        going = [n for n in taken[: max(0, len(taken) - keep)] if logs.get(f"{n:020d}.json", old) < old and n < now.get("version", 0)]
        named = {p for n in taken if n not in going for p in (self._read(f"{n:020d}.json") or {"parts": []})["parts"]}
        for n in going:
            self._delete(f"_log/{n:020d}.json")
        for name, changed in logs.items():
            if name.startswith(".") and not name.endswith(".crc") and changed < old:
                self._delete(f"_log/{name}")
        for name, changed in self._names("data").items():
            if name not in named and changed < old:
                self._delete(f"data/{name}")

    def _delete(self, at: str) -> None:
        path, fs = self._path(f"{self.folder}/{at}")
        fs.delete(path, True)
