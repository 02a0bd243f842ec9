"""Progress of streaming queries: what each micro-batch read, on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Adds up rows and batches of all queries of a session and tells `report` after each batch."""

    def __init__(self, report: Callable[[str, int, int], None] | None = None):
        self.report, self.rows, self.batches, self.ended = report, 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        if self.report:
            self.report(event.progress.name, self.rows, self.batches)

    def onQueryTerminated(self, event) -> None:
        self.ended += 1


def watch(spark: SparkSession, report: Callable[[str, int, int], None] | None = None) -> Progress:
    """A listener added to the session; spark.streams.removeListener takes it out again."""
    made = Progress(report)
    spark.streams.addListener(made)
    return made
