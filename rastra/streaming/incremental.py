"""Files that arrive in pieces, and folders that files arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rastra.functions.riff import CHUNK_HEADER, FILE_HEADER

EVENTS = "path string, event string, idx int, fourcc string, payload_start long, size long"
#: What is kept for a file: bytes that are not yet read (never a payload), the place in the file, bytes of payload still to skip, the number of chunks, the file's end.
STATE = "pending binary, at long, skip long, idx int, end long, done boolean"


def new_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """A stream of the files that appear in a folder: path, modificationTime, length, content."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def advance(state: tuple | None, pieces: list[bytes]) -> tuple[tuple, list[tuple]]:
    """Feed pieces of a file in order; the new state and the events (event, idx, fourcc, payload_start, size).

    Events: header, chunk (its header is complete), finished, and error; after the last two nothing follows. Payload bytes are
    skipped as they come, so the state stays at a few bytes however long the file is.
    """
    pending, at, skip, idx, end, done = state or (b"", 0, 0, 0, -1, False)
    events: list[tuple] = []
    for piece in pieces:
        if done:
            break
        drop = min(skip, len(piece))
        skip, at = skip - drop, at + drop
        data = bytes(pending) + piece[drop:]
        while not done:
            if skip:
                drop = min(skip, len(data))
                data, skip, at = data[drop:], skip - drop, at + drop
                if skip:
                    break
            if at == 0:
                if len(data) < FILE_HEADER:
                    break
                if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
                    events.append(("error", None, None, None, None))
                    done = True
                    break
                end = 8 + int.from_bytes(data[4:8], "little")
                events.append(("header", None, None, FILE_HEADER, end))
                data, at = data[FILE_HEADER:], FILE_HEADER
            if at + CHUNK_HEADER > end:
                events.append(("finished", idx, None, None, at))
                done = True
                break
            if len(data) < CHUNK_HEADER:
                break
            size = int.from_bytes(data[4:8], "little")
            events.append(("chunk", idx, data[:4].decode("latin-1"), at + CHUNK_HEADER, size))
            data, at, skip, idx = data[CHUNK_HEADER:], at + CHUNK_HEADER, size + size % 2, idx + 1
        pending = b"" if done else data
    return (pending, at, skip, idx, end, done), events


def _table(path: object, events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(path, *e) for e in events], columns=["path", "event", "idx", "fourcc", "payload_start", "size"]).astype({"idx": "Int32", "payload_start": "Int64", "size": "Int64"})


def whole_events(pieces: DataFrame) -> DataFrame:
    """The chunk events of a table of all pieces (path, seq, bytes), as the stream would give them; path may be of any type, as a string in the result."""
    one = lambda key, rows: _table(key[0], advance(None, [bytes(b) for b in rows.sort_values("seq")["bytes"] if b is not None])[1])
    return pieces.select(pieces["path"].cast("string").alias("path"), "seq", "bytes").groupBy("path").applyInPandas(one, EVENTS)


def chunk_events(pieces: DataFrame, idle: str | None = None) -> DataFrame:
    """A stream of chunk events from a stream of pieces (path, seq, bytes): EVENTS.

    The pieces of one micro-batch are ordered by seq; across batches they must come in order. The events don't depend on how a
    file is cut up. A finished file's state stays as a mark, so that late pieces are ignored. With ``idle`` (such as "1 hour" of processing
    time) it goes when nothing has come for so long; an unfinished file then has the event abandoned at the place it had come to, and
    pieces after that begin a file anew. Streams that run on should set it; with it Spark keeps making batches, so that a stream
    that is to end by itself needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    wait_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, at, _, idx, _, done = state.get
            events = [] if done else [("abandoned", idx, None, None, at)]
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            new, events = advance(state.get if state.exists else None, [bytes(b) for b in rows["bytes"] if b is not None])
            state.update(new)
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        yield _table(key[0], events)

    return pieces.groupBy("path").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


class FileState(StatefulProcessor):
    """One file of ``chunk_events_with_ttl``: what is pending, where the reader is, and a timer for files that stop coming."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "bytes binary", self.ttl_ms)
        self.place = handle.getValueState("place", "at long, skip long, idx int, end long", self.ttl_ms)
        self.done = handle.getValueState("done", "done boolean", self.ttl_ms)

    def _read(self) -> tuple | None:
        if not self.place.exists():
            return None
        (pending,) = self.pending.get() if self.pending.exists() else (b"",)
        return (bytes(pending), *self.place.get(), self.done.exists())

    def _wait(self, until: int | None) -> None:
        """Only the last timer of a file counts, and a finished file has none: its state just expires."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        (pending, at, skip, idx, end, done), events = advance(self._read(), [bytes(b) for b in frame["bytes"] if b is not None])
        self.pending.update((pending,))
        self.place.update((at, skip, idx, end))
        if done:
            self.done.update((True,))
        self._wait(None if done else timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield _table(key[0], events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._read()  # gone if the timer comes late
        self.pending.clear()
        self.place.clear()
        yield _table(key[0], [("abandoned", state and state[3], None, None, state and state[1])])

    def close(self) -> None:
        pass


def chunk_events_with_ttl(pieces: DataFrame, idle: str) -> DataFrame:
    """``chunk_events`` with state variables that expire: the bytes, the place and the end of a file are kept apart, each for ``idle`` after its last change.

    Needs Spark's RocksDB state store. When its timer runs out, an unfinished file has the event abandoned and its state goes; should the
    timer come late, the state is gone all the same and the event has no place. A piece after that begins the file anew.
    """
    ttl_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return pieces.groupBy("path").transformWithStateInPandas(FileState(ttl_ms), EVENTS, "append", "ProcessingTime")
