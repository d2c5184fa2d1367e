"""A read-only engine that tails the commit log with Structured Streaming.

Opening reads what has been published so far. From then on a file source over
the log delivers records, whose checkpoint keeps the offset; records that are
known already, as after a restart, are passed over. Records are applied in order
of their number; one that the stream missed, or met while it was torn, is read
from its file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.log import LOG, RECORD_SCHEMA, Record


class Follower:
    def __init__(self, spark: SparkSession, root: str, checkpoint: str) -> None:
        self.spark = spark
        self.engine = Engine(spark, root, write=False)
        self.checkpoint = checkpoint
        self.waiting: dict[int, Record] = {}

    def log_stream(self) -> DataFrame:
        return self.spark.readStream.schema(RECORD_SCHEMA).option("pathGlobFilter", "*.json").json(self.engine.store.files.at(LOG))

    def catch_up(self) -> int:
        """Apply what has been published since the last call; the number of records applied."""
        before = self.engine.store.log.lsn
        self._start(availableNow=True).awaitTermination()
        # A number that was torn when the stream met it, and is the last one still.
        self.engine.store.catch_up()
        return self.engine.store.log.lsn - before

    def follow(self, every: str = "1 second") -> StreamingQuery:
        """Keep catching up until the query that is returned is stopped."""
        return self._start(processingTime=every)

    def _start(self, **trigger) -> StreamingQuery:
        return self.log_stream().writeStream.option("checkpointLocation", self.checkpoint).trigger(**trigger).foreachBatch(self._receive).start()

    def _receive(self, batch: DataFrame, _: int) -> None:
        store = self.engine.store
        # One small record per commit; data files are never read here.
        for r in batch.where("lsn IS NOT NULL").toLocalIterator():
            if r["lsn"] > store.log.lsn:
                self.waiting[r["lsn"]] = Record(r["lsn"], r["type"], r["txn"], r["epoch"], json.loads(r["body"]))
        while self.waiting:
            if (record := self.waiting.pop(store.log.lsn + 1, None)) is not None:
                store.receive(record)
            elif not store.catch_up():
                break
            for known in [n for n in self.waiting if n <= store.log.lsn]:
                del self.waiting[known]

    def promote(self) -> Engine:
        """Take over as the writer, in a new epoch."""
        self.catch_up()
        self.engine.promote()
        return self.engine
