"""A keyed table as runs of files: the last write of a key counts.

Rows lie in buckets by a hash of their key. A batch writes one run, which has
files for the buckets that it touches and no others, and then a manifest that
lists the runs of every bucket. A manifest is committed by the marker that Spark
writes last, so a crash before it leaves a run that nobody reads, and the batch,
come again, writes another one; a batch whose manifest is committed does nothing.
A bucket of ``RUNS`` runs is merged into one by the batch that touches it next.
``vacuum`` removes what no kept manifest names. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a bucket before they are merged.
RUNS = 8


class KeyedTable:
    """``path`` is in any file system that Spark writes to. The schema is that of
    the first batch; keys must not be null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, runs: int = RUNS) -> None:
        self.spark, self.path, self.keys, self.buckets, self.runs = spark, path.rstrip("/"), keys, buckets, runs
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._place(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _committed(self, version: int) -> bool:
        return self._fs.exists(self._place(f"{self.path}/manifest/{version}/_SUCCESS"))

    def versions(self) -> list[int]:
        return sorted(int(x) for x in self._names("manifest") if self._committed(int(x)))

    def manifest(self, version: int) -> dict[int, list[str]]:
        """The runs of each bucket, oldest first: ``buckets * runs`` rows at most."""
        rows = self.spark.read.schema("bucket int, place int, run string").parquet(f"{self.path}/manifest/{version}").collect()
        out: dict[int, list[str]] = {}
        for r in sorted(rows):
            out.setdefault(r["bucket"], []).append(r["run"])
        return out

    def _before(self, version: int | None) -> int | None:
        """The last committed version, at or before the given one."""
        found = [v for v in self.versions() if version is None or v <= version]
        return found[-1] if found else None

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, list[str]], buckets: list[int]) -> DataFrame | None:
        """All rows of some buckets with the place of their run."""
        out = None
        for place in range(self.runs + 1):  # files of one place are one read
            paths = [f"{self.path}/runs/{held[b][place]}/_bucket={b}" for b in buckets if len(held.get(b, ())) > place]
            if paths:
                part = self.spark.read.schema(self._schema()).parquet(*paths).withColumn("_place", F.lit(place))
                out = part if out is None else out.unionByName(part)
        return out

    def _schema(self):
        return self.spark.read.parquet(f"{self.path}/schema").schema

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, "_place")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_place").alias("_v")).select(*self.keys, "_v.*")

    def upsert(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Writes ``rows``, one for a key, as of ``version`` (a batch's number), and
        marks the keys of ``gone`` as removed. Nothing happens if it is committed."""
        if self._committed(version):
            return
        rows = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.keys).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        if not self._fs.exists(self._place(f"{self.path}/schema/_SUCCESS")):
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        before = self._before(version - 1)
        held = self.manifest(before) if before is not None else {}
        run = f"{version}-{uuid.uuid4().hex}"
        self._write(rows, run)
        touched = sorted(int(x.split("=")[1]) for x in self._names(f"runs/{run}") if x.startswith("_bucket="))
        for b in touched:
            held[b] = [*held.get(b, []), run]
        full = [b for b in touched if len(held[b]) > self.runs]
        if full:
            merged = f"{run}-merged"
            self._write(self._last(self._rows(held, full)).where("not _gone"), merged)
            left = set(self._names(f"runs/{merged}"))
            for b in full:
                held[b] = [merged] if f"_bucket={b}" in left else []
        listed = [(b, i, r) for b, runs in held.items() for i, r in enumerate(runs)]
        self.spark.createDataFrame(listed, "bucket int, place int, run string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/runs/{run}")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version (the last one); None before the first."""
        at = self._before(version)
        held = self.manifest(at) if at is not None else {}
        rows = self._rows(held, sorted(held))
        return self._last(rows).where("not _gone").drop("_gone") if rows is not None else None

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame | None:
        """The rows of the given keys; only their buckets are read."""
        at = self._before(version)
        held = self.manifest(at) if at is not None else {}
        wanted = keys.select(*self.keys).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        rows = self._rows(held, [b for b in buckets if b in held])
        return self._last(rows.join(wanted, self.keys, "left_semi")).where("not _gone").drop("_gone") if rows is not None else None

    def vacuum(self, keep: int) -> int:
        """Removes manifests before version ``keep`` (but the last committed one
        at or before it) and all runs that no kept manifest names; gives the
        number of runs removed. Not while a batch is being written."""
        first = self._before(keep)
        kept = [v for v in self.versions() if first is None or v >= first]
        named = {r for v in kept for runs in self.manifest(v).values() for r in runs}
        for v in self._names("manifest"):
            if int(v) not in kept:
                self._fs.delete(self._place(f"{self.path}/manifest/{v}"), True)
        gone = [r for r in self._names("runs") if r not in named]
        for r in gone:
            self._fs.delete(self._place(f"{self.path}/runs/{r}"), True)
        return len(gone)
