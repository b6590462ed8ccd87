"""The live pool as keyed state: each demand is kept where its key is, and a batch writes only what it changed.

State lies in RocksDB. What a demand keeps is bounded but for its authors, which are a map of the state store, a row each. Merges do not depend on the
order of arrival: each field, author and snippet remembers the smallest ordinal that brought it, so the state after all rows is what a batch merge of them gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plaintide.functions import text
from plaintide.operators.merging import EVIDENCE, HEAD
from plaintide.operators.messages import human
from plaintide.sources import ledger

#: A message that is a demand: what the stream is made of.
DEMAND = "canonical_key string, ordinal long, title string, why string, reach long, author string, snippet string, ts timestamp"
#: A demand as the pool shows it; ``faded`` if nothing was said for so long.
SHOWN = "canonical_key string, title string, why string, reach long, authors long, merged long, evidence string, first_seen timestamp, last_seen timestamp, status string"
_HELD = "first long, title string, reach long, why_at long, why string, rows long, authors long, first_seen timestamp, last_seen timestamp, last_millis long"
#: Authors of a demand that are read from the state together.
LISTED = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pool(StatefulProcessor):
    """The state of one demand, and a timer that tells when it fades."""

    def __init__(self, fade: timedelta) -> None:
        self.fade = fade

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.authors = handle.getMapState("authors", "author string", "ordinal long")
        self.snippets = handle.getMapState("snippets", "head string", "ordinal long, snippet string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Rows are reduced as they come, as plain values: a key has a few rows a batch, and a call of pandas for each costs more than they do. The state is asked for what a new key cannot have no
        more than once: a short list of authors is read in one go, a longer one author by author.
        """
        old = self.held.get()
        first, title, reach, why_at, why, n, authors, seen, last, millis = old or (None, None, 0, None, "", 0, 0, None, None, 0)
        people: dict[str, int] = {}
        told: dict[str, tuple[int, str]] = {}
        for part in rows:
            times, columns = part["ts"].tolist(), [part[x].tolist() for x in ("ordinal", "title", "reach", "why", "author", "snippet")]
            n += len(times)
            for at, name, wide, because, author, said in zip(*columns, strict=True):
                if first is None or at < first:
                    first, title, reach = at, name, 0 if wide is None or wide != wide else int(wide)
                if isinstance(because, str) and because and (why_at is None or at < why_at):
                    why_at, why = at, because
                if isinstance(author, str) and author:
                    people[author] = min(at, people.get(author, at))
                if isinstance(said, str) and said and ((head := said[:HEAD]) not in told or at < told[head][0]):
                    told[head] = (at, said)
            millis = max(millis, *part["millis"].tolist())
            low, high = min(times).to_pydatetime(), max(times).to_pydatetime()
            seen, last = low if seen is None else min(seen, low), high if last is None else max(last, high)
        known = set() if not authors else {k[0] for k in self.authors.keys()} if authors <= LISTED else {x for x in people if self.authors.containsKey((x,))}
        for author, at in people.items():
            if author not in known:
                self.authors.updateValue((author,), (at,))
                authors += 1
        kept = {k[0]: v for k, v in self.snippets.iterator()} if old else {}
        best = sorted([(at, head, said) for head, (at, said) in (kept | {h: min(v, kept.get(h, v)) for h, v in told.items()}).items()])[:EVIDENCE]
        for head in kept.keys() - {h for _, h, _ in best}:
            self.snippets.removeKey((head,))
        for at, head, said in best:
            if kept.get(head) != (at, said):
                self.snippets.updateValue((head,), (at, said))
        self.held.update((first, title, reach, why_at, why, n, authors, seen, last, millis))
        for timer in list(self.handle.listTimers()) if old else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(millis + int(self.fade.total_seconds() * 1000))
        yield self._row(key, "new", title, reach, why, n, authors, seen, last, best=[(at, said) for at, _, said in best])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, title, reach, _, why, n, authors, seen, last, _ = self.held.get()
        yield self._row(key, "faded", title, reach, why, n, authors, seen, last, sorted(v for _, v in self.snippets.iterator()))

    def _row(self, key: tuple, status: str, title: str, reach: int, why: str, n: int, authors: int, seen: datetime, last: datetime, best: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], title, why, max(reach, authors), authors, n - 1, ",".join(x for _, x in best), seen, last, status)], columns=[x.split()[0] for x in SHOWN.split(", ")])

    def close(self) -> None:
        pass


def demands_of(messages: DataFrame, fade: timedelta, late: str = "1 day") -> DataFrame:
    """A stream of :data:`DEMAND` rows as a stream of the demands that changed (:data:`SHOWN`)."""
    timed = messages.withWatermark("ts", late).withColumn("millis", F.unix_millis("ts"))
    return timed.groupBy("canonical_key").transformWithStateInPandas(statefulProcessor=Pool(fade), outputStructType=SHOWN, outputMode="Update", timeMode="EventTime")


def write_pool(root: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A batch function that lays changed demands over the ledger at ``root``. Each batch is a run of the ledger, so one that is repeated after a crash changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        # a demand that changes and fades in one batch: what it says last holds
        last = batch.groupBy("canonical_key").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "canonical_key"]), F.struct("last_seen", "merged", "status")).alias("r"))
        ledger.upsert(last.select("canonical_key", "r.*"), "canonical_key", root, f"batch-{n}", F.current_timestamp(), buckets=buckets)

    return write


def pool_of(spark: SparkSession, root: str) -> DataFrame:
    """The demands of the pool at ``root`` as of its last batch; none before the first."""
    found = ledger.current(spark, root)
    return spark.createDataFrame([], SHOWN) if found is None else found


def follow(messages: DataFrame, root: str, checkpoint: str, fade: timedelta, every: str | None = None, late: str = "1 day") -> StreamingQuery:
    """The pool at ``root`` from a stream of :data:`DEMAND` rows.

    Without ``every`` the backlog is worked off in batches of the source's size (:func:`arriving`) and the query ends. Stopped between two or in the midst of one, it goes
    on from its checkpoint, and no row is lost or counted twice.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = demands_of(messages, fade, late).writeStream.outputMode("update").foreachBatch(write_pool(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def arriving(spark: SparkSession, folder: str, schema: str = DEMAND, files: int = 1) -> DataFrame:
    """The files that arrive in ``folder`` as a stream, at most ``files`` a batch, so that a backlog of any size is worked off in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def flush(messages: DataFrame, classify: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, fade: timedelta, every: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Messages to the pool: human ones, those with a signal, what ``classify`` makes :data:`DEMAND` rows of, kept as state and written by key."""
    wanted = human(messages).where(text.has_signal(F.col("text")))
    return follow(classify(wanted), root, checkpoint, fade, every, late)
