"""Versioned store: append-only Parquet tables, validity derived from events.

``points`` holds chunks and never changes; ``postings`` holds their word counts, in
partitions of words. ``doc_events`` holds ingests and
deactivations; an ingest appends its points first and its event last, so a
crash leaves points that no event names, and readers don't see them. A writer
holds a claim file while it makes versions, so two can't make the same.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError, StoreError
from ..operators.search import postings, term_bucket

POINTS = (
    "point_id string, document_id string, document_type string, source string, chunk_type string, chunk_role string, searchable boolean, sequence int, hierarchy array<string>, parent_point_id string, "
    "version int, valid_from double, valid_from_iso string, token_estimate int, content string, n_words long, meta string, chunk_extra string, dense array<double>, sparse struct<indices:array<bigint>,values:array<double>>, ingest_id string"
)
POSTINGS = "point_id string, ingest_id string, len long, term string, tf long, bucket int"
EVENTS = "document_id string, event_seq long, ingest_id string, kind string, version int, before_version int, ts double, ts_iso string"


def validity(events: DataFrame) -> DataFrame:
    """(document_id, version, ingest_id, valid_from, valid_from_iso, valid_to, valid_to_iso, is_active) from the event log.

    A version ends where the next one begins, or at the first later
    deactivation that covers it. Order is that of events, not of clocks.

    Versions never meet deactivations row by row, which a document with many of both would square. A
    deactivation before no version that has begun, or of all, covers all that have begun, so the first
    one after an ingest counts. One before version b, where b has begun, covers versions
    under b, all of which have begun before it, so the first one with a greater b counts. Either is a
    running minimum over the document's events in one order.
    """
    stops, ingests = F.col("kind") == "deactivate", F.col("kind") == "ingest"
    rows = events.where(stops | ingests).withColumn("_at", F.struct("event_seq", "ts", "ts_iso"))
    of = Window.partitionBy("document_id")
    # an ingest of the same number as a deactivation comes after it: only later deactivations count
    begun = F.max(F.when(ingests, F.col("version"))).over(of.orderBy(F.col("event_seq").asc(), stops.desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_all", stops & (F.col("before_version").isNull() | F.coalesce(F.col("before_version") > begun, F.lit(True))))
    rows = rows.withColumn("_later", F.min(F.when(F.col("_all"), F.col("_at"))).over(of.orderBy(F.col("event_seq").desc(), ingests.desc()).rowsBetween(Window.unboundedPreceding, 0)))
    # a deactivation before b stands between b - 1 and b
    rank = F.when(ingests, F.col("version")).otherwise(F.col("before_version") - 1)
    by_version = of.orderBy(rank.desc_nulls_last(), stops.desc(), F.col("event_seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_under", F.min(F.when(stops & ~F.col("_all"), F.col("_at"))).over(by_version))
    starts = rows.where(ingests).withColumn("_next", F.lead("_at").over(of.orderBy("version")))
    end = F.least("_next", "_later", "_under").alias("_end")
    out = starts.select("document_id", "version", "ingest_id", F.col("ts").alias("valid_from"), F.col("ts_iso").alias("valid_from_iso"), end)
    return out.select("document_id", "version", "ingest_id", "valid_from", "valid_from_iso", F.col("_end.ts").alias("valid_to"), F.col("_end.ts_iso").alias("valid_to_iso"), F.col("_end").isNull().alias("is_active"))


def history(versions: DataFrame, points: DataFrame) -> DataFrame:
    """(document_id, version, valid_from, valid_to, is_active, chunk_count), one row a version."""
    counts = points.groupBy("document_id", "version", "ingest_id").agg(F.count("*").alias("chunk_count"))
    joined = versions.join(counts, ["document_id", "version", "ingest_id"])
    return joined.select("document_id", "version", F.col("valid_from_iso").alias("valid_from"), F.col("valid_to_iso").alias("valid_to"), "is_active", "chunk_count")


class Store:
    """The tables under a path. Writers take turns by a claim file, which is made atomically; one older than ``stale`` seconds is a dead writer's."""

    stale = 6 * 3600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def ensure_ready(self, dimension: int) -> None:
        """Creates what isn't there; a store of another dimension is an error."""
        fs, p = self._fs("store.json")
        if fs.exists(p):
            have = json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])["dimension"]
            if have != dimension:
                raise ConfigurationError(f"the store holds vectors of dimension {have}, not {dimension}")
            return
        self.spark.createDataFrame([], POSTINGS).write.partitionBy("bucket").mode("append").parquet(f"{self.path}/postings")
        for name, schema in (("points", POINTS), ("doc_events", EVENTS)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")
        out = fs.create(p)
        out.write(bytearray(json.dumps({"dimension": dimension}).encode()))
        out.close()

    def points(self) -> DataFrame:
        return self.spark.read.schema(POINTS).parquet(f"{self.path}/points")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/doc_events")

    def current(self) -> DataFrame:
        """Points of named ingests with their validity."""
        v = validity(self.events()).drop("valid_from", "valid_from_iso")
        return self.points().join(v, ["document_id", "version", "ingest_id"])

    def latest(self) -> DataFrame:
        """(document_id, version): the last version of each document, active or not."""
        return self.events().where("kind = 'ingest'").groupBy("document_id").agg(F.max("version").alias("version"))

    @contextmanager
    def claim(self, wait: float = 60.0):
        """Holds the store for one writer; waits for another, and fails after ``wait`` seconds."""
        fs, p = self._fs("writer.claim")
        until = time.time() + wait
        while True:
            try:
                fs.create(p, False).close()  # fails if it is there
                break
            except Exception as e:
                if not fs.exists(p):
                    if time.time() > until:
                        raise StoreError(f"the store can't be claimed: {str(e).splitlines()[0]}") from e
                elif time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.stale:
                    fs.delete(p, False)
                elif time.time() > until:
                    raise StoreError("another writer holds the store") from e
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(p, False)

    def knows(self, ingest_id: str) -> bool:
        """Whether an event names this ingest."""
        return not self.events().where(F.col("ingest_id") == ingest_id).isEmpty()

    def upsert(self, points: DataFrame, ingest_id: str, again: bool = False) -> None:
        """Appends the points of an ingest and their postings; rows of a document lie together, so its statistics prune.

        ``again``: an ingest of this id may have died half way; what it left isn't written twice.
        """
        names = [f.name for f in self.points().schema]
        points = points.select(*names)
        if again:
            points = points.join(self.points().where(F.col("ingest_id") == ingest_id).select("point_id"), "point_id", "left_anti").select(*names)
        points.repartition("document_id").sortWithinPartitions("document_id", "version", "sequence").write.mode("append").parquet(f"{self.path}/points")
        found = postings(self.points().where(F.col("ingest_id") == ingest_id), "point_id", "content", "ingest_id").withColumn("bucket", term_bucket(F.col("term")))
        if again:
            found = found.join(self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where(F.col("ingest_id") == ingest_id).select("point_id", "term"), ["point_id", "term"], "left_anti")
        found.select("point_id", "ingest_id", "len", "term", "tf", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """Postings of all named ingests, and one row of their number of points and mean length."""
        named = self.events().where("kind = 'ingest'").select("ingest_id").distinct()
        every = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").join(named, "ingest_id", "left_semi")
        total = self.points().select("ingest_id", "n_words").join(named, "ingest_id", "left_semi").agg(F.count("*").alias("n"), F.avg("n_words").alias("avg_len"))
        return every, total

    def _next_seq(self) -> int:
        return (self.events().agg(F.max("event_seq")).first()[0] or 0) + 1

    def append_ingests(self, versions: DataFrame) -> None:
        """Events of (document_id, version, ingest_id, ts, ts_iso), after their points."""
        seq = self._next_seq()
        order = Window.partitionBy("document_id").orderBy("version")
        rows = versions.select("document_id", (F.row_number().over(order) - 1 + seq).cast("long").alias("event_seq"), "ingest_id", F.lit("ingest").alias("kind"), "version", F.lit(None).cast("int").alias("before_version"), "ts", "ts_iso")
        rows.write.mode("append").parquet(f"{self.path}/doc_events")

    def deactivate(self, document_id: str, ts: float, ts_iso: str, before_version: int | None = None) -> int:
        """Ends the active versions of a document, or those before a version; the number of points that this concerns."""
        on = (F.col("document_id") == document_id) & F.col("is_active")
        if before_version is not None:
            on = on & (F.col("version") < before_version)
        n = self.current().where(on).count()
        if n:
            row = [(document_id, self._next_seq(), uuid.uuid4().hex, "deactivate", None, before_version, ts, ts_iso)]
            self.spark.createDataFrame(row, EVENTS).write.mode("append").parquet(f"{self.path}/doc_events")
        return n

    def scroll(self, where=None, columns: tuple[str, ...] = ()) -> DataFrame:
        """A filtered full scan with the asked columns."""
        df = self.current() if where is None else self.current().where(where)
        return df.select(*columns) if columns else df

    def history(self, document_id: str | None = None) -> DataFrame:
        events, points = self.events(), self.points()
        if document_id is not None:
            events, points = (x.where(F.col("document_id") == document_id) for x in (events, points))
        return history(validity(events), points)
