"""Streams of events: reading, idempotent writing, and the stateful rules.

A stream is read in micro-batches and written below the shared folder, one folder for each micro-batch that is overwritten
where the batch is run again, so a restart writes nothing twice. State is kept by key (applyInPandasWithState); a function sees
the rows of a key in one micro-batch, which maxFilesPerTrigger bounds, and orders them by time and id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import shared_folder

#: Files of a micro-batch.
FILES_PER_TRIGGER = 8


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The files of a table as a stream; timestamps without zone become instants, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(f"{sf_dir}/{name}.[p]arquet")  # a pattern, as a single file is no folder; it has no other match
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def written(stream: DataFrame, name: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there, and reads what it wrote."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, f"{name}-out"), shared_folder(spark, f"{name}-state")
    schema = (prepare(stream) if prepare else stream).schema

    def write(batch: DataFrame, epoch: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/epoch=*").drop("epoch")


def per_key(stream: DataFrame, keys: list[str], schema: str, state: str, step: Callable[[pd.DataFrame, tuple], tuple[list, tuple]], first: tuple) -> DataFrame:
    """step(rows of a key by ts and id, state) -> (rows to put out, new state), in each micro-batch."""

    def over(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable")
        out, after = step(rows, held.get if held.exists else first)
        held.update(after)
        names = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame([(*key, *r) for r in out], columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(over, schema, state, "append", GroupStateTimeout.NoTimeout)


def rolling_cap(most: int, seconds: float = 86_400.0) -> Callable:
    """Accepts a row while fewer than `most` accepted rows lie in the `seconds` before it; state: their times."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
        accepted, out = list(state[0]), []
        for at, ident in zip(rows.ts.astype("int64") / 1e9, rows.id, strict=True):
            accepted = [x for x in accepted if x > at - seconds]
            if len(accepted) < most:
                accepted.append(at)
                out.append((ident,))
        return out, (accepted,)

    return step


def follow(stay_m: float = 5.0, most_speed: float = 50.0, least_s: float = 1.0) -> Callable:
    """A marker that follows positions: it stays within stay_m, moves at a likely speed, and else waits for a second like reading.

    Speed is that since the last move, least_s being the least time counted. A reading that is too fast is the suspect; a later one
    that is not too fast since the suspect confirms it, and the marker moves. Staying changes neither place nor time of the last move.
    rows: ts, id, x, y in metres. Puts out (id, what): stays, moves, waits. state: place and time of the last move, then of the suspect;
    a time below 0 stands for none.
    """

    def too_fast(x: float, y: float, at: float, px: float, py: float, t: float) -> bool:
        return ((px - x) ** 2 + (py - y) ** 2) ** 0.5 / max(t - at, least_s) > most_speed

    def step(rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
        x, y, at, sx, sy, suspected = state
        out = []
        for t, ident, px, py in zip(rows.ts.astype("int64") / 1e9, rows.id, rows.x, rows.y, strict=True):
            if at >= 0 and ((px - x) ** 2 + (py - y) ** 2) ** 0.5 < stay_m:
                what, suspected = "stays", -1.0
            elif at < 0 or not too_fast(x, y, at, px, py, t) or (suspected >= 0 and t > suspected and not too_fast(sx, sy, suspected, px, py, t)):
                what, suspected = "moves", -1.0
                x, y, at = px, py, t
            else:
                what = "waits"
                if suspected != t:
                    sx, sy, suspected = px, py, t
            out.append((ident, what))
        return out, (float(x), float(y), float(at), float(sx), float(sy), float(suspected))

    return step


def alerts(fire_m: float = 40.0, rearm_m: float = 100.0) -> Callable:
    """Fires once when the distance falls to fire_m, and again only after it was beyond rearm_m. rows: ts, id, metres."""

    def step(rows: pd.DataFrame, state: tuple) -> tuple[list, tuple]:
        armed, out = bool(state[0]), []
        for ident, metres in zip(rows.id, rows.metres, strict=True):
            if armed and metres <= fire_m:
                armed = False
                out.append((ident,))
            elif not armed and metres > rearm_m:
                armed = True
        return out, (armed,)

    return step


def with_row_before(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs a stream over all that is there: its rows, and for each the row before it of its key as <column>_before, null for the first.

    Rows of a micro-batch follow each other by (ts, id), and the last one of a key from the micro-batches before. That last row is all the
    state there is. It is kept as a table, one folder for each micro-batch, not as a state function's: a key with a few rows costs what
    its rows cost, so there may be as many keys as rows. A micro-batch that is run again reads the same folder and overwrites its own.
    """
    spark, columns = stream.sparkSession, [c for c in stream.columns if c not in keys]
    out, lasts, state = (shared_folder(spark, f"{name}-{part}") for part in ("out", "last", "state"))
    kept = stream.select(*keys, F.struct("ts", "id", *(c for c in columns if c not in ("ts", "id"))).alias("row"))
    before = F.lag("row").over(Window.partitionBy(*keys).orderBy("new", "row.ts", "row.id"))
    told = lambda df: df.select(*keys, *(F.col(f"row.{c}") for c in columns), *(F.col(f"last.{c}").alias(f"{c}_before") for c in columns))

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.select(*kept.columns, F.lit(True).alias("new"))
        if epoch:
            held = batch.sparkSession.read.schema(kept.schema).parquet(f"{lasts}/epoch={epoch - 1}")
            batch = batch.unionByName(held.select(*kept.columns, F.lit(False).alias("new")))
        told(batch.withColumn("last", before).where("new")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        last = batch.groupBy(*keys).agg(F.max(F.struct("new", F.col("row.ts"), F.col("row.id"), "row")).alias("last"))
        last.select(*keys, "last.row").write.mode("overwrite").parquet(f"{lasts}/epoch={epoch}")

    kept.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    schema = told(kept.withColumn("last", F.col("row"))).schema
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/epoch=*").drop("epoch")


def unfollowed(stream: DataFrame, keys: list[str], schema: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """keys, id of the rows with `starts` that no row of their key with `ends` follows within `seconds`; told when the watermark passes
    that deadline, by a timer, whether or not another row of the key comes.

    stream: keys, ts, id, starts, ends. A row follows another by (ts, id); one with both is held and ends those before it. Rows may come
    in any order up to `late`; the result does not depend on how they fall into micro-batches. State of a key: rows held, and the ends
    that may still meet rows to come; it goes when neither is left. schema: of keys and id.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    reach = round(seconds * 1e6)

    def over(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, ends, end_ids = (list(x) for x in held.get) if held.exists else ([], [], [], [])
        rows = [] if held.hasTimedOut else list(frames)
        for frame in rows:
            at = frame.ts.astype("datetime64[us]").astype("int64").to_numpy()
            for t, ident, starts, stops in zip(at.tolist(), frame.id.tolist(), frame.starts, frame.ends, strict=True):
                if stops:
                    ends.append(t)
                    end_ids.append(ident)
                if starts:
                    times.append(t)
                    ids.append(ident)
        now = held.getCurrentWatermarkMs() * 1000
        stops = sorted(zip(ends, end_ids, strict=True))
        later = lambda t, i: bisect_right(stops, (t, i))  # noqa: E731  the first end after a row is the only one that counts
        stopped = lambda t, i: (k := later(t, i)) < len(stops) and stops[k][0] - t <= reach
        waiting = [(t, i) for t, i in zip(times, ids, strict=True) if not stopped(t, i)]
        out = [i for t, i in waiting if t + reach < now]
        waiting = [(t, i) for t, i in waiting if t + reach >= now]
        recent = [(e, j) for e, j in zip(ends, end_ids, strict=True) if e >= now]  # an earlier end follows no row that can still come
        if waiting or recent:
            held.update(([t for t, _ in waiting], [i for _, i in waiting], [e for e, _ in recent], [j for _, j in recent]))
            wake = min([t + reach for t, _ in waiting] + [e for e, _ in recent])
            held.setTimeoutTimestamp(max(wake // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(*key, i) for i in out], columns=names)

    marked = stream.withWatermark("ts", late)
    return marked.groupBy(*keys).applyInPandasWithState(over, schema, "times array<long>, ids array<long>, ends array<long>, end_ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def whole_or_not(stream: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """keys, id of the rows of batches without a bad row; a batch is told by its keys, and comes whole or in parts, in any micro-batches.

    stream: keys, id, bad, size (how many rows the sender says the batch has). A batch is judged once all its rows are there; rows sent
    again are known by their ids. A batch that is never whole stays in the state. schema: of keys and id.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def over(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ids, bad, done = held.get if held.exists else ([], False, False)
        ids, size = set(ids), 0
        for frame in frames:
            ids |= set(frame.id.tolist())
            bad, size = bool(bad or frame.bad.any()), int(frame["size"].max())
        out = []
        if not done and len(ids) >= size:
            out, done = ([] if bad else sorted(ids)), True
        held.update(([] if done else sorted(ids), bad, done))
        yield pd.DataFrame([(*key, i) for i in out], columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(over, schema, "ids array<long>, bad boolean, done boolean", "append", GroupStateTimeout.NoTimeout)
