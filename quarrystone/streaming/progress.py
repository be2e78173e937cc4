"""Progress of running streams, kept as rows."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the last entries of every query's progress: query, batch, input rows and rates."""

    def __init__(self, most: int = 1000):
        self.most, self.rows = most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.rows = [*self.rows, (p["name"] or p["id"], p["batchId"], p.get("numInputRows", 0), p.get("processedRowsPerSecond", 0.0))][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
