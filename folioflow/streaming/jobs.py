"""Keyed state: message assembly, edit-log replay and debounced snapshots, as batch jobs and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

#: Commands that can be undone.
HISTORY = 50
#: Milliseconds after which an idle group of a stream is forgotten.
IDLE_MS = 600_000


class Held(Protocol):
    """The texts of a group's parts so far."""

    def get(self, idx: int) -> str | None: ...
    def put(self, idx: int, text: str) -> None: ...
    def clear(self) -> None: ...
    def joined(self) -> str: ...


Head = tuple[int, int] | None


def feed(held: Held, head: Head, idx: int, total: int, text: str) -> tuple[Head, str | None]:
    """A part arrives: (total, parts held) of the group from now on, None if it begins anew, and the body if the part completes it.

    A part that contradicts the group, by another total or another text of an index, ends the group without a body
    and is not kept; what comes later starts a group of its own, as it does after a completed one.
    """
    known = held.get(idx) if head else None
    if head and (head[0] != total or known not in (None, text)):
        held.clear()
        return None, None
    n = head[1] if head else 0
    if known is None:
        held.put(idx, text)
        n += 1
    if n < total:
        return (total, n), None
    body = held.joined()
    held.clear()
    return None, body


class InMemory(dict):
    """Parts of one group in a dictionary: as many as a message has."""

    def put(self, idx: int, text: str) -> None:
        self[idx] = text

    def joined(self) -> str:
        return "".join(self[i] for i in sorted(self))


def assemble(parts: DataFrame) -> DataFrame:
    """group_key, n (1, 2, ... of the group's bodies), body from parts (group_key, seq, idx, total, text) in order of arrival; see :func:`feed`.

    Each task goes through its groups in order and holds the parts of one incomplete message, however many rows a
    group has. Parts without a text are empty; null indexes or totals are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, head, n = None, InMemory(), None, 0
        for batch in batches:
            done = []
            for k, idx, total, text in zip(batch["group_key"], batch["idx"], batch["total"], batch["text"], strict=True):
                if k != key:
                    key, head, n = k, None, 0
                    held.clear()
                head, body = feed(held, head, idx, total, text)
                if body is not None:
                    n += 1
                    done.append((k, n, body))
            yield pd.DataFrame(done, columns=["group_key", "n", "body"])

    rows = parts.where("group_key IS NOT NULL AND idx IS NOT NULL AND total IS NOT NULL").select("group_key", "seq", "idx", "total", F.coalesce("text", F.lit("")).alias("text"))
    kind = parts.schema["group_key"].dataType.simpleString()
    # dealt by a hash of the key: a union of tables that are dealt by the key itself would not be dealt again, though
    # its parts may be put together differently, and a group's rows would lie in several tasks
    return rows.repartition(F.xxhash64("group_key")).sortWithinPartitions("group_key", "seq").mapInPandas(run, f"group_key {kind}, n int, body string")


def replay(events: DataFrame, *, most: int = HISTORY) -> DataFrame:
    """key, commands: ids that survive an edit log (key, seq, op, id): execute pushes, keeps the last ``most`` and clears what could be redone; undo and redo move the top, or do nothing."""
    rows = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "id"))).alias("log"))
    zero = F.expr("named_struct('done', cast(array() as array<bigint>), 'undone', cast(array() as array<bigint>))")

    def step(s, e):
        done, undone = s["done"], s["undone"]
        nothing = F.array().cast("array<bigint>")
        without_last = lambda a: F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))
        pushed = F.concat(done, F.array(e["id"]))
        pushed = F.slice(pushed, F.greatest(F.lit(1), F.size(pushed) - most + 1), F.lit(most))
        run, back, again = e["op"] == "execute", (e["op"] == "undo") & (F.size(done) > 0), (e["op"] == "redo") & (F.size(undone) > 0)
        return F.struct(
            F.when(run, pushed).when(back, without_last(done)).when(again, F.concat(done, F.slice(undone, -1, 1))).otherwise(done).alias("done"),
            F.when(run, nothing).when(back, F.concat(undone, F.slice(done, -1, 1))).when(again, without_last(undone)).otherwise(undone).alias("undone"),
        )

    return rows.select("key", F.aggregate("log", zero, step, lambda s: s["done"]).alias("commands"))


def debounce(events: DataFrame, *, key: str = "key", ts: str = "ts", gap: str = "800 milliseconds") -> DataFrame:
    """key, saved_at, value: the last value of each burst of changes whose gaps are shorter than ``gap``; on a stream, give it a watermark first."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w.alias("burst")).agg(F.max_by("value", F.struct(ts, "tie")).alias("value")).select(key, F.col("burst.end").alias("saved_at"), "value")


def debounce_stream(events: DataFrame, *, key: str = "key", ts: str = "ts", gap: str = "800 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The rows of :func:`debounce` from a stream, each when the watermark (``delay`` behind the latest change) has passed its burst; write them in append mode."""
    return debounce(events.withWatermark(ts, delay), key=key, ts=ts, gap=gap)


def upsert_saved(batch: DataFrame, state: DataFrame, *, key: str = "key") -> DataFrame:
    """The state with the latest save of each key; a save that comes late does not replace a later one."""
    every = state.select(key, "saved_at", "value").unionByName(batch.select(key, "saved_at", "value"))
    return every.groupBy(key).agg(F.max("saved_at").alias("saved_at"), F.max_by("value", "saved_at").alias("value"))


class SavedTable:
    """The latest save of each key in a folder that all machines share, for ``foreachBatch``.

    A batch writes its own saves to a folder of its number, and every ``whole_every``-th the whole table instead. It
    counts from the moment when its row in ``commits`` is there: what a failed attempt left before is written over,
    and a batch whose number is not above the last committed one changes nothing. A folder belongs to one stream and
    its checkpoint, whose numbers it goes by.
    """

    def __init__(self, path: str, schema: str, *, key: str = "key", whole_every: int = 10):
        self.path, self.schema, self.key, self.whole_every = path.rstrip("/"), schema, key, whole_every

    def _commits(self, spark: SparkSession) -> list[tuple[int, bool]]:
        """(batch, whole) of the last whole table and the batches since, a few rows."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        commits = spark.read.schema("batch long, whole boolean").parquet(f"{self.path}/commits/*")
        base = commits.where("whole").agg(F.max("batch")).first()[0]
        return sorted((r.batch, r.whole) for r in commits.where(F.lit(base is None) | (F.col("batch") >= F.lit(base))).collect())

    def read(self, spark: SparkSession) -> DataFrame:
        """key, saved_at, value after the last committed batch."""
        folders = [f"{self.path}/data/{n}" for n, _ in self._commits(spark)]
        rows = spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)
        return upsert_saved(rows.limit(0), rows, key=self.key)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = self._commits(spark)
        if commits and number <= commits[-1][0]:
            return
        since = len(commits) - any(whole for _, whole in commits)
        whole = since + 1 >= self.whole_every
        saves = upsert_saved(batch, self.read(spark) if whole else batch.limit(0), key=self.key)
        saves.write.mode("overwrite").parquet(f"{self.path}/data/{number}")
        spark.createDataFrame([(number, whole)], "batch long, whole boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number}")


def save_stream(events: DataFrame, path: str, checkpoint: str, *, gap: str = "800 milliseconds", delay: str = "10 seconds") -> DataStreamWriter:
    """A stream of changes (key, ts, tie, value) whose bursts are saved to a :class:`SavedTable`; to be started."""
    saves = debounce_stream(events, gap=gap, delay=delay)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in saves.schema)
    return saves.writeStream.foreachBatch(SavedTable(path, schema)).option("checkpointLocation", checkpoint).outputMode("append")


class Assembler(StatefulProcessor):
    """Parts of a group until all are there (:func:`feed`); an idle group expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "total long, held long, bodies int")
        self.parts = handle.getMapState("parts", "idx long", "text string")

    def get(self, idx: int) -> str | None:
        return self.parts.getValue((idx,))[0] if self.parts.containsKey((idx,)) else None

    def put(self, idx: int, text: str) -> None:
        self.parts.updateValue((idx,), (text,))

    def clear(self) -> None:
        self.parts.clear()

    def joined(self) -> str:
        held = {k[0]: v[0] for k, v in self.parts.iterator()}
        return "".join(held[i] for i in sorted(held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, held, n = self.head.get() if self.head.exists() else (0, 0, 0)
        head, done = (total, held) if held else None, []
        # a micro-batch comes in no order
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            head, body = feed(self, head, int(r.idx), int(r.total), r.text)
            if body is not None:
                n += 1
                done.append((key[0], n, body))
        self.head.update((*(head or (0, 0)), n))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + IDLE_MS)
        if done:
            yield pd.DataFrame(done, columns=["group_key", "n", "body"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        self.head.clear()
        return iter(())

    def close(self) -> None:
        pass


def assemble_stream(parts: DataFrame) -> DataFrame:
    """The rows of :func:`assemble` from a stream of parts, each when its last part is there; parts of a later micro-batch arrive later."""
    rows = parts.where("group_key IS NOT NULL AND idx IS NOT NULL AND total IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("group_key").transformWithStateInPandas(Assembler(), outputStructType="group_key long, n int, body string", outputMode="append", timeMode="processingTime")


class Replayer(StatefulProcessor):
    """The stacks of an edit log."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stacks = handle.getValueState("stacks", "done array<long>, undone array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.stacks.get() if self.stacks.exists() else ([], [])
        done, undone = list(held[0]), list(held[1])
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            if e.op == "execute":
                done, undone = [*done, int(e.id)][-HISTORY:], []
            elif e.op == "undo" and done:
                undone.append(done.pop())
            elif e.op == "redo" and undone:
                done.append(undone.pop())
        self.stacks.update((done, undone))
        yield pd.DataFrame({"key": [key[0]], "commands": [done]})

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame) -> DataFrame:
    """key, commands after each micro-batch of a stream of edits (key, seq, op, id)."""
    return events.groupBy("key").transformWithStateInPandas(Replayer(), outputStructType="key long, commands array<long>", outputMode="update", timeMode="none")
