"""Tables that streams keep: sorted runs, merged when read and compacted by size.

A batch appends one run of its own rows and reads nothing of the table, so what
it writes is in proportion to what it brings. A run's files are ranges of the
keys' hash. Once a level has FAN runs they become one run of the next level, so a
row is written anew about log(table / batch) times; a run has as many files as
its size asks for. What is in the table says a manifest, a small numbered file
that lists the runs' files with their ranges; it is written under another name
and renamed, so a reader sees the state before a batch or after it. The manifest
also holds the last batch, which is not applied twice.

Readers keep their files: manifests that are neither among the last few nor young
go, and with them the runs that only they list. One writer at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_blank
from lectern.operators import memory

#: Runs of a level that become one, manifests that stay in any case, and seconds for which older ones do.
FAN, KEPT, SECONDS = 4, 3, 3600
SLOT = "_slot"


@dataclass
class Manifest:
    number: int = -1
    batch: int = -1
    #: Runs, oldest first: name, level, rows, bytes and files, each with the lowest and highest hash.
    runs: list[dict] = field(default_factory=list)


class KeptTable:
    """Rows by key, of which ``newest`` keeps what counts; it must give the same for parts and for their union.

    It is also given the columns by which equal keys lie together already, and need not be shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[Column | str], newest: Callable[[DataFrame, list[str]], DataFrame], fan: int = FAN, kept: int = KEPT, seconds: int = SECONDS):
        self.spark, self.path, self.keys, self.newest, self.fan, self.kept, self.seconds = spark, path.rstrip("/"), keys, newest, fan, kept, seconds
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        at = self.at(f"{self.path}/{folder}")
        return list(self.store.listStatus(at)) if self.store.exists(at) else []

    def _manifests(self) -> dict[int, object]:
        found = [(s.getPath().getName(), s) for s in self._list("manifests")]
        return {int(n[:-5]): s for n, s in found if n.endswith(".json") and not n.startswith(("_", "."))}

    def manifest(self, number: int | None = None) -> Manifest:
        """The table's newest state, or a former one that is still kept."""
        known = self._manifests()
        if number is None:
            number = max(known, default=-1)
        if number < 0:
            return Manifest()
        text = self.spark.read.text(known[number].getPath().toString(), wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, after: Manifest) -> None:
        target, own = (self.at(f"{self.path}/manifests/{name}") for name in (f"{after.number:012d}.json", f"_{after.number:012d}"))
        out = self.store.create(own, True)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        if self.store.exists(target) or not self.store.rename(own, target):
            raise RuntimeError(f"another writer has written {target}")
        self._forget()

    def _forget(self) -> None:
        known = self._manifests()
        old = sorted(known)[: -self.kept]
        old = [n for n in old if known[n].getModificationTime() <= (time.time() - self.seconds) * 1000]
        if old:
            names = lambda numbers: {r["name"] for n in numbers for r in self.manifest(n).runs}
            gone = names(old) - names(set(known) - set(old))
            for n in old:
                self.store.delete(known[n].getPath(), False)
            for name in gone:
                self.store.delete(self.at(f"{self.path}/runs/{name}"), True)

    def _write(self, rows: DataFrame, name: str, level: int) -> dict | None:
        """A run of what counts of the rows, its files ranges of the hash and about as large as adaptive execution makes partitions.

        The rows are shuffled once; a key should come few times.
        """
        folder = f"{self.path}/runs/{name}"
        keyed = rows.withColumn(SLOT, F.xxhash64(*self.keys))
        self.newest(keyed.repartitionByRange(SLOT), [SLOT]).sortWithinPartitions(SLOT).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        sizes = {s.getPath().getName(): s.getLen() for s in self._list(f"runs/{name}")}
        file = F.element_at(F.split(F.input_file_name(), "/"), -1)
        bounds = self.spark.read.parquet(folder).groupBy(file.alias("file")).agg(F.min(SLOT).alias("low"), F.max(SLOT).alias("high"), F.count("*").alias("rows")).orderBy("low").collect()
        files = [{"file": r.file, "low": r.low, "high": r.high, "rows": r["rows"], "bytes": sizes[r.file]} for r in bounds]
        return {"name": name, "level": level, "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files), "files": files} if files else None

    def write(self, batch: DataFrame, batch_id: int, few: bool = False) -> None:
        """A foreachBatch writer; a batch that has been applied changes nothing.

        Unless it is said that ``few`` rows share a key, they are first made fewer where they lie.
        """
        now = self.manifest()
        if batch_id <= now.batch:
            return
        run = self._write(batch if few else self.newest(batch, []), f"{now.number + 1:012d}-0", 0)
        self._commit(Manifest(now.number + 1, batch_id, now.runs + ([run] if run else [])))
        while self.compact():
            pass

    def compact(self) -> bool:
        """Makes one run of the lowest level that is full; says whether there was one."""
        now = self.manifest()
        levels = sorted({r["level"] for r in now.runs})
        full = next((lv for lv in levels if sum(r["level"] == lv for r in now.runs) >= self.fan), None)
        if full is None:
            return False
        own = [r for r in now.runs if r["level"] == full]
        run = self._write(self._rows(own), f"{now.number + 1:012d}-{full + 1}", full + 1)
        self._commit(Manifest(now.number + 1, now.batch, [*([run] if run else []), *(r for r in now.runs if r not in own)]))
        return True

    def _rows(self, runs: list[dict], low: int = -(1 << 63), high: int = (1 << 63) - 1) -> DataFrame | None:
        files = [f"{self.path}/runs/{r['name']}/{f['file']}" for r in runs for f in r["files"] if f["high"] >= low and f["low"] <= high]
        return self.spark.read.parquet(*files).drop(SLOT) if files else None

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The whole table, or None before its first row."""
        runs = (manifest or self.manifest()).runs
        rows = self._rows(runs)
        return rows if len(runs) < 2 else self.newest(rows, [])

    def read_key(self, *values) -> DataFrame | None:
        """The rows of one key, from the files whose range holds it."""
        slot = self.spark.range(1).select(F.xxhash64(*values)).first()[0]
        rows = self._rows(self.manifest().runs, slot, slot)
        return None if rows is None else self.newest(rows.where(F.xxhash64(*self.keys) == slot), [])


def memory_table(spark: SparkSession, path: str, **how) -> KeptTable:
    """Translation memory: of each key the last non-blank result."""
    keys = [memory.memory_source("source"), "domain", "signature"]
    return KeptTable(spark, path, keys, lambda rows, parted: memory.last_written(rows.where(~is_blank("target")), parted), **how)


def history_table(spark: SparkSession, path: str, by: list[str], keep: int = memory.KEEP, **how) -> KeptTable:
    """History: of each id the newest entry, and the newest so many of those that share ``by``."""
    return KeptTable(spark, path, by, lambda rows, parted: memory.newest(rows, [*parted, *by], keep), **how)
