"""What a stream reports of its batches: how many rows wait, came and were written, and which batches failed."""

from __future__ import annotations

from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last figures of each query by its name; add with spark.streams.addListener."""

    def __init__(self):
        self.figures: dict[str, dict] = {}

    def _of(self, name: str | None, query) -> dict:
        return self.figures.setdefault(name or str(query), {"batches": 0, "rows": 0, "last_rows": 0, "failed": 0})

    def onQueryStarted(self, event) -> None:
        self._of(event.name, event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        f = self._of(p.name, p.id)
        f["batches"] += 1
        f["rows"] += p.numInputRows
        f["last_rows"] = p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            for f in self.figures.values():
                f["failed"] += 1
