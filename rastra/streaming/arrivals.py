"""When files arrive: counts by event time, and those that come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent


def by_time(files: DataFrame, length: str, delay: str, at: str = "modificationTime", size: str = "length", *keys: str) -> DataFrame:
    """(keys, start, end, files, bytes) for windows of event time, of a table or a stream of files.

    On a stream a window is done once files that are ``delay`` newer than its end have come; then its state goes, and later files of it are
    dropped (``LateFiles`` counts them). A table has no late files. Files without a time are in no window.
    """
    timed = files.where(F.col(at).isNotNull()).withWatermark(at, delay)
    counts = timed.groupBy(*keys, F.window(at, length).alias("w")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return counts.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "files", "bytes")


class LateFiles(StreamingQueryListener):
    """Counts the rows that queries drop as later than their watermark: ``spark.streams.addListener(late)``, then late.dropped by query id.

    A dropped row is one after partial aggregation: files of one window and batch that are late together count once for each task.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
