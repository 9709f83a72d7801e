"""A table of session states that a stream keeps, in versions that are committed by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.sources.kept import file_system

#: Tables of a version at most, but for large ones: with one more, those that are not are merged.
MERGE_EVERY = 20
#: A table is large beside the ones after it if it has so many times their rows.
LARGE = 2


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each session."""
    rest = [c for c in changes.columns if c != "session_id"]
    return changes.groupBy("session_id").agg(F.max_by(F.struct(*rest), "ts").alias("s")).select("session_id", "s.*").select(*changes.columns)


class SessionStore:
    """Versions of a table of sessions under a folder.

    data/ holds Parquet tables with names of their own; versions/ holds a file for each
    committed epoch, which lists the tables that make up the version, with their rows: first
    what has been merged, then the changes of each epoch since. Merges leave out tables that
    are large beside what comes after them, so a row is written again a number of times that
    grows with the logarithm of the table only. A version comes to be by renaming its
    finished file into place: before that it is not seen, after it all of it is. Tables that
    neither the last version nor the one before it lists are deleted after a commit, those
    of attempts that died among them; a reader that has begun on a version can so finish
    while the next is made. One writer at a time: a stream's micro-batches are.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = MERGE_EVERY):
        self.spark, self.path, self.merge_every = spark, path.rstrip("/"), merge_every

    def _names(self, folder: str) -> list[str]:
        system, at = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []

    def epochs(self) -> list[int]:
        """Committed epochs whose versions are still there."""
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json")]

    def tables(self, epoch: int) -> list[list]:
        """Name and number of rows of each table of a version, the oldest first."""
        system, at = file_system(self.spark, f"{self.path}/versions/{epoch:019d}.json")
        stream = system.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, df: DataFrame, epoch: int) -> list:
        name, watch = f"{epoch:019d}-{uuid.uuid4().hex}", Observation()
        df.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/data/{name}")
        return [name, watch.get["n"]]

    def read(self, tables: list[list], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{name}" for name, _ in tables])

    def commit(self, tables: list[list], epoch: int) -> None:
        system, draft = file_system(self.spark, f"{self.path}/versions/_{epoch:019d}-{uuid.uuid4().hex}")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        _, final = file_system(self.spark, f"{self.path}/versions/{epoch:019d}.json")
        if not system.rename(draft, final):
            raise OSError(f"version {epoch} of {self.path} could not be committed")

    def clean(self) -> None:
        """Delete what the last two versions don't list."""
        last = self.epochs()[-2:]
        listed = {name for e in last for name, _ in self.tables(e)}
        gone = [f"data/{n}" for n in self._names("data") if n not in listed]
        gone += [f"versions/{n}" for n in self._names("versions") if n not in {f"{e:019d}.json" for e in last}]
        for name in gone:
            system, at = file_system(self.spark, f"{self.path}/{name}")
            system.delete(at, True)

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """Adds an epoch's changes; one that is committed already, or older, is done."""
        done = self.epochs()
        if done and done[-1] >= epoch:
            return
        tables = self.tables(done[-1]) if done else []
        tables.append(self.write(newest(changes), epoch))
        if len(tables) > self.merge_every:
            k = 0
            while k < len(tables) - 2 and tables[k][1] >= LARGE * sum(n for _, n in tables[k + 1 :]):
                k += 1
            merged = newest(self.read(tables[k:], changes.schema))
            # a deletion is forgotten only where nothing older is left that it hides
            tables[k:] = [self.write(merged if k else merged.where("not deleted"), epoch)]
        self.commit(tables, epoch)
        self.clean()

    def states(self, schema: StructType) -> DataFrame:
        """The latest states of the last committed version, without deleted ones."""
        done = self.epochs()
        tables = self.tables(done[-1]) if done else []
        if not tables:
            return self.spark.createDataFrame([], schema)
        return newest(self.read(tables, schema)).where("not deleted").select(*[f.name for f in schema])


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY):
    """session_upsert kept by a stream of changes (session_id, ts, deleted and the state's columns).

    Each micro-batch commits a version: its newest states beside what was there, with the
    smaller tables merged every so many micro-batches.
    A micro-batch that is tried again after a fault at any point adds nothing twice and loses
    nothing. A change that comes, merges later, with an older ts than the state it meets is
    passed over; after a merge has forgotten a deletion, it would bring the session back.
    """
    store = SessionStore(changes.sparkSession, path, merge_every)
    return changes.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint)


def stored_sessions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Latest states that upsert_stream has stored, without deleted ones: one whole version, whatever is written meanwhile."""
    return SessionStore(spark, path).states(schema)
