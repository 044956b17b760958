"""Tables as Parquet segments: a write makes new folders, and then a pointer file of a higher number names them. One writer.

A table is a snapshot and the changes since, in order. A change holds rows and the keys that go; its own keys replace all
earlier rows of theirs. So a change writes what it changes and nothing else; a read joins older rows with the later keys,
and once a table has more than ``most_segments`` segments it is compacted to one. Segments never change, so a reader of an
older pointer, or a write that reads the table, is not disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SEGMENTS = 16


class Store:
    """Named tables under a root that Spark can read and write.

    The pointers of a table stand beside its folder and are read through the Hadoop file system; the one with the
    largest number holds, so a driver that dies in a write leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str, most_segments: int = MOST_SEGMENTS):
        self.spark, self.root, self.most_segments = spark, root.rstrip("/"), most_segments

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, name: str) -> list[str]:
        """The names of the table's pointer files, in order."""
        fs, folder = self._files(f"{self.root}/{name}.pointers")
        if not fs.exists(folder):
            return []
        return sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))

    def pointer(self, name: str) -> dict | None:
        """What the current pointer holds: the segments and the note of its write."""
        names = self._pointers(name)
        return self._pointed(name, names[-1]) if names else None

    def _pointed(self, name: str, file: str) -> dict:
        fs, p = self._files(f"{self.root}/{name}.pointers/{file}")
        stream = fs.open(p)
        try:
            held = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return held if "segments" in held else {"segments": [{"at": held["at"]}], "note": held.get("note")}

    def _point(self, name: str, segments: list[dict], note) -> None:
        names = self._pointers(name)
        number = int(names[-1].removesuffix(".json")) + 1 if names else 0
        fs, p = self._files(f"{self.root}/{name}.pointers/{number:020d}.json")
        temporary = self._files(f"{self.root}/{name}.pointers/{uuid.uuid4().hex}.new")[1]
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps({"segments": segments, "note": note}).encode()))
        stream.close()
        if not fs.rename(temporary, p):
            raise OSError(f"the pointer of {name} could not be moved")

    def current(self, name: str) -> str | None:
        """The folder of the last segment with rows or keys; None where the table was never written."""
        found = self.pointer(name)
        last = found["segments"][-1] if found else {}
        return last.get("at") or last.get("gone")

    def note(self, name: str):
        """What the last write of the table noted, such as a batch number."""
        found = self.pointer(name)
        return found and found.get("note")

    def _segment(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{folder}")

    def read(self, name: str) -> DataFrame:
        found = self.pointer(name)
        if found is None:
            from fathom.sources.schemas import schema

            return self.spark.createDataFrame([], schema(name))
        segments = found["segments"]
        rows, dead = None, {}
        for k, s in enumerate(segments):
            own = self._segment(name, s["at"]) if s.get("at") else None
            if s.get("keys"):
                keys = [x.select(*s["keys"]) for x in (own, self._segment(name, s["gone"]) if s.get("gone") else None) if x is not None]
                dead.setdefault(tuple(s["keys"]), []).extend(x.withColumn("_until", F.lit(k)) for x in keys)
            if own is not None:
                own = own.withColumn("_since", F.lit(k))
                rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        for keys, parts in dead.items():
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            last = every.groupBy(*keys).agg(F.max("_until").alias("_until")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_until")
            same = F.col("_until") > F.col("_since")
            for i, c in enumerate(keys):
                same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
            rows = rows.join(last, same, "left_anti")
        return rows.drop("_since")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, note=None) -> None:
        """The table is ``df`` from now on. The new segment is complete before the pointer is, so ``df`` may read the old ones."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.root}/{name}/{version}")
        self._point(name, [{"at": version}], note)

    def change(self, name: str, keys: list[str], rows: DataFrame | None = None, gone: DataFrame | None = None, note=None) -> None:
        """Rows whose ``keys`` are those of ``rows`` or ``gone`` go, and ``rows`` come; nulls are equal. A table that does not exist is made."""
        found = self.pointer(name)
        if found is None:
            if rows is None:
                raise ValueError(f"there is no table {name}")
            return self.write(name, rows, note=note)
        segment: dict = {"keys": keys}
        for part, df in (("at", rows), ("gone", None if gone is None else gone.select(*keys).distinct())):
            if df is not None:
                segment[part] = f"v-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{name}/{segment[part]}")
        self._add(name, found, segment, note)

    def append(self, name: str, df: DataFrame) -> None:
        found = self.pointer(name)
        if found is None:
            return self.write(name, df)
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        self._add(name, found, {"at": version}, found.get("note"))

    def _add(self, name: str, found: dict, segment: dict, note) -> None:
        self._point(name, [*found["segments"], segment], note)
        if len(found["segments"]) + 1 > self.most_segments:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Makes one segment of all."""
        self.write(name, self.read(name), note=self.note(name))

    def drop(self, name: str) -> None:
        """Deletes a table, if there is one: the pointers first."""
        for path in (f"{self.root}/{name}.pointers", f"{self.root}/{name}"):
            fs, p = self._files(path)
            fs.delete(p, True)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Deletes what only pointers before the last ``keep`` name, and those pointers."""
        names = self._pointers(name)
        old, kept = names[: max(0, len(names) - max(1, keep))], names[-max(1, keep) :]
        folders = lambda file: {s[part] for s in self._pointed(name, file)["segments"] for part in ("at", "gone") if s.get(part)}
        held = set().union(*map(folders, kept)) if kept else set()
        for n in old:
            for folder in folders(n) - held:
                fs, p = self._files(f"{self.root}/{name}/{folder}")
                fs.delete(p, True)
            fs, p = self._files(f"{self.root}/{name}.pointers/{n}")
            fs.delete(p, False)


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes ``df`` as JSON lines, CSV with a header, Parquet or ORC."""
    if form not in ("json", "csv", "parquet", "orc"):
        raise ValueError(f"no such form: {form}")
    writer = df.write
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
