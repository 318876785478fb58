"""Structured Streaming: sliding counts, sessions, and a keep-best store that flushes behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DecimalType, FractionalType, NumericType, StructField, StructType

from strandloom.sources.storage import kept, shared_dir


def sliding_counts(stream: DataFrame, at: str, keys: list[str], length: str, step: str, late: str) -> DataFrame:
    """Counts by window and key; windows are final once the watermark has passed their end."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, length, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Groups of a key whose rows are less than gap apart."""
    g = stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_best(stream: DataFrame, at: str, keys: list[str], by: str, payload: list[str], bucket: str, late: str) -> DataFrame:
    """Of each key within a bucket of time the row that is largest in by, then in payload.

    A bucket is given out when the watermark passes its end; rows later than that are dropped, so nothing
    is given out twice. Ties don't depend on the order of arrival.
    """
    best = F.max(F.struct(by, *payload)).alias("m")
    g = stream.withWatermark(at, late).groupBy(F.window(at, bucket).alias("w"), *keys).agg(best)
    return g.select(F.col("w.start").alias("start"), *keys, F.col(f"m.{by}").alias(by), *(F.col(f"m.{c}").alias(c) for c in payload))


def best_of_bucket(n_keys: int, state: StructType, ends: str, names: list[str]) -> StatefulProcessor:
    """State of a part of a bucket's keys: a list of the best row so far of each, which a timer at the bucket's end gives out,
    once. The list is read and written once a batch, so a key costs no calls of its own.

    The class is made here, so that it travels by value: the process in which the driver asks for its state does not have
    this package.
    """

    def rank(row: tuple) -> tuple:  # nulls before all, what is no number behind all
        return tuple((x is not None, x != x, x if x is not None and x == x else 0) for x in row)

    inputs = [f"{x}{i}" for i in range(len(state.fields)) for x in "vn"]

    def column(values: tuple) -> pd.Series:  # whole numbers stay such beside nulls
        return pd.Series(values, dtype=object if any(x is None for x in values) and any(isinstance(x, int) for x in values) else None)

    class Best(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.best = handle, handle.getListState("best", state)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            best, held, end = {}, self.best.exists(), None
            for row in self.best.get() if held else ():
                best[row[:n_keys]] = (rank(row[n_keys:]), row)
            for batch in rows:
                end = int(batch[ends].iloc[0])
                for x in batch[inputs].itertuples(index=False, name=None):
                    row = tuple(None if null or v is None or v is pd.NaT else v for v, null in zip(x[::2], x[1::2]))
                    own, now = row[:n_keys], rank(row[n_keys:])
                    if own not in best or now > best[own][0]:
                        best[own] = (now, row)
            if best:
                if not held:
                    self.handle.registerTimer(end)
                self.best.put([row for _, row in best.values()])
            return iter(())

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            rows = [(key[0], *row) for row in self.best.get()]
            self.best.clear()
            given = list(zip(*rows))
            yield pd.DataFrame({n: column(x) for n, x in zip(names, [*given, *([v is None for v in x] for x in given[1:])])})

        def close(self) -> None:
            pass

    return Best()


def keep_best_with_timers(stream: DataFrame, at: str, keys: list[str], by: str, payload: list[str], bucket: str, late: str, parts: int = 128) -> DataFrame:
    """As keep_best(), by a state of its own and event-time timers: a bucket's rows are given out when the watermark passes
    its end, each once, and their state goes. Keys are dealt by hash to so many parts, each a state and a timer a bucket. Runs
    in append mode on a state store that has timers (RocksDB)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [by, *payload]
    part = F.pmod(F.hash(*keys), F.lit(parts)).alias("part")
    of = {f.name: f.dataType for f in stream.schema.fields}
    # Whole numbers beside nulls would become doubles, so nulls go in columns of their own.
    full = lambda c: F.coalesce(c, F.lit(0).cast(of[c])) if isinstance(of[c], NumericType) else F.col(c)
    values = [x for i, c in enumerate([*keys, *columns]) for x in (full(c).alias(f"v{i}"), F.isnull(c).alias(f"n{i}"))]
    rows = stream.withWatermark(at, late).withColumn("__w", F.window(at, bucket)).select(F.col("__w.start").alias("start"), part, at, *values, F.unix_millis("__w.end").alias("bucket_end"))
    state = StructType([StructField(f"c{i}", of[c]) for i, c in enumerate([*keys, *columns])])
    out = StructType([StructField("k0", rows.schema["start"].dataType), *state.fields, *(StructField(f"n{i}", BooleanType()) for i in range(len(state.fields)))])
    best = best_of_bucket(len(keys), state, "bucket_end", out.names)
    found = rows.groupBy("start", "part").transformWithStateInPandas(best, out, "append", "eventtime")
    number = lambda i, c: F.coalesce(f"c{i}", F.lit(float("nan")).cast(of[c])) if isinstance(of[c], FractionalType) and not isinstance(of[c], DecimalType) else F.col(f"c{i}")
    return found.select(F.col("k0").alias("start"), *(F.when(~F.col(f"n{i}"), number(i, c)).alias(c) for i, c in enumerate([*keys, *columns])))


def run_available(df: DataFrame, name: str, mode: str = "append", listener: list | None = None, folder: str | None = None) -> DataFrame:
    """Run a query over what is there, in batches, into a table below the shared folder, and return the table.

    The checkpoint and the table lie below one folder, a new one of spark.checkpoint.dir if none is given; a query that is
    run again with its folder goes on where it stopped. Complete mode keeps the last batch's result only. Progress of each batch goes to listener, if given.
    """
    spark, folder = df.sparkSession, kept(folder or shared_dir(df.sparkSession, f"stream-{name}"))
    out, schema = f"{folder}/rows", df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if listener is not None:
        listener.extend(progress(q))
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def progress(query: StreamingQuery) -> list[dict]:
    """Of each batch its number, rows read, and watermark, rows held and dropped as late of its state."""
    out = []
    for p in query.recentProgress:
        state = p.stateOperators
        out.append({"batch": p.batchId, "rows": p.numInputRows, "watermark": (p.eventTime or {}).get("watermark"), "held": sum(s.numRowsTotal for s in state), "late": sum(s.numRowsDroppedByWatermark for s in state)})
    return out
