"""Race snapshots as a keyed stream with typed state.

One row of the stream is one pulled snapshot: league, season, day, the pull's number and its race
rows. The state of a season holds one entry a day: the last pull's content and the fingerprints
of all of that day's pulls. Pulls may come in any order, late days included. A day is stored
when any of its pulls differs from the last content before that day, and holds its last pull, so a
pull decides its own day and the next one again; whatever changed leaves the batch as an update.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.snapshots import KEY, ROW
from ..sources.shipping import ship
from ..sources.sinks import table_exists

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RACES = "ARRAY<STRUCT<race: STRING, rank: INT, player_id: BIGINT, player_name: STRING, score: DOUBLE>>"
PULL = f"league STRING, season STRING, snap_date DATE, arrival BIGINT, rows {RACES}"
UPDATE = "league string, season string, snap_date date, arrival long, keep boolean, rows string"


def pulls(arrivals: DataFrame) -> DataFrame:
    """Race rows of arrivals as one document a pull (a pull holds a bounded board a race)."""
    rows = F.array_sort(F.collect_list(F.struct("race", F.col("rank").cast("int").alias("rank"), "player_id", "player_name", "score")))
    return arrivals.groupBy(*KEY, "snap_date", F.col("arrival").cast("long").alias("arrival")).agg(rows.alias("rows"))


class SnapshotFold(StatefulProcessor):
    """Decides, day by day, which snapshots of a season are stored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day string", "arrival long, mark string, marks string, rows string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        touched = set()
        for batch in rows:
            for day, arrival, mark, text in zip(batch["day"], batch["arrival"], batch["mark"], batch["rows"]):
                held = self.days.getValue((day,)) if self.days.containsKey((day,)) else None
                marks = set(held[2].split(",")) if held else set()
                marks.add(mark)
                newest = held is None or arrival >= held[0]
                last = (int(arrival), mark, text) if newest else (held[0], held[1], held[3])
                self.days.updateValue((day,), (last[0], last[1], ",".join(sorted(marks)), last[2]))
                touched.add(day)
        order = sorted(k[0] for k in self.days.keys())  # at most the days of a season
        out = []
        for i, day in enumerate(order):
            if day not in touched and (i == 0 or order[i - 1] not in touched):
                continue
            before = self.days.getValue((order[i - 1],))[1] if i else None
            arrival, _, marks, text = self.days.getValue((day,))
            keep = before is None or any(m != before for m in marks.split(","))
            out.append((key[0], key[1], pd.Timestamp(day).date(), arrival, keep, text))
        if out:
            yield pd.DataFrame(out, columns=["league", "season", "snap_date", "arrival", "keep", "rows"])


def snapshot_updates(stream: DataFrame) -> DataFrame:
    """Updates (league, season, snap_date, arrival, keep, rows as text) from a stream of pulls."""
    ship(stream.sparkSession)
    text = F.to_json(F.array_sort("rows"))
    docs = stream.select(*KEY, F.col("snap_date").cast("string").alias("day"), "arrival", F.sha2(text, 256).alias("mark"), text.alias("rows"))
    return docs.groupBy(*KEY).transformWithStateInPandas(SnapshotFold(), UPDATE, "Update", "None")


def follow_snapshots(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a table of updates, one folder a micro-batch, so a replayed batch replaces its own."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    w = snapshot_updates(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def stored_snapshots(spark: SparkSession, table: str) -> DataFrame:
    """The history as it stands: each day's newest update, if it is kept, as race rows."""
    if not table_exists(spark, table):
        return spark.createDataFrame([], f"{', '.join(f'{k} string' for k in KEY)}, snap_date date, race string, rank int, player_id long, player_name string, score double")
    newest = Window.partitionBy(*KEY, "snap_date").orderBy(F.desc("batch"))
    last = spark.read.parquet(table).withColumn("_n", F.row_number().over(newest)).where("_n = 1 AND keep")
    rows = F.explode(F.from_json("rows", RACES)).alias("r")
    return last.select(*KEY, "snap_date", rows).select(*KEY, "snap_date", *[F.col(f"r.{c}").alias(c) for c in ROW])
