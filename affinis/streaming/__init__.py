"""Sliding-window counts over event time, for batch rows and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str = "ts", length: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    """df with start: a row for each window that holds it."""
    return df.withColumn("w", F.window(F.col(ts).cast("timestamp"), length, slide)).withColumn("start", F.col("w.start")).drop("w")


def sliding_distinct(df: DataFrame, key: str, ts: str = "ts", length: str = "30 minutes", slide: str = "10 minutes") -> DataFrame:
    return windowed(df, ts, length, slide).groupBy("start").agg(F.count_distinct(key).alias("n"))


def stream_distinct(stream: DataFrame, key: str, exact: bool, ts: str = "ts", length: str = "30 minutes", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Distinct keys of each window of a stream: exact (the state keeps the keys) or estimated."""
    n = F.size(F.collect_set(key)).cast("long") if exact else F.approx_count_distinct(key)
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, length, slide).alias("w")).agg(n.alias("n")).select(F.col("w.start").alias("start"), "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now, and give its table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def append_csv(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None, mode: str = "update"):
    """Start a query that writes each micro-batch of a windowed stream as headered CSV under path/batch=<number>. checkpoint is a
    shared folder from which a restart goes on; a batch that is done again replaces what it wrote. trigger, such as "5 seconds":
    how often; none: what there is now, then stop."""

    def write(batch, number):
        batch.write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return started(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint, trigger)


def started(writer, checkpoint: str, trigger: str | None = None):
    when = {"processingTime": trigger} if trigger else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**when).start()


def priority(key):
    return (F.col(key) * 7919 + 104729) % 149399


def reservoir_stream(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(batch rows) after each micro-batch a priority sample of `size` rows (key, tag) of all so far, as (key, tag, n): n counts the
    sample's rows with that tag. The sample is the operator's state, so a restart from the checkpoint goes on with it. stream has a
    whole-number key and a string column tag; each task passes on at most `size` rows of a batch to the one that holds the state."""
    from pyspark.sql.streaming import StatefulProcessor

    kinds = "key long, tag string"

    class Reservoir(StatefulProcessor):
        def init(self, handle):
            self.rows = handle.getListState("rows", kinds)

        def handleInputRows(self, group, pdfs, timers):
            import pandas as pd

            held = pd.DataFrame([tuple(r) for r in self.rows.get()] if self.rows.exists() else [], columns=["key", "tag"])
            for pdf in pdfs:
                held = pd.concat([held, pdf[["key", "tag"]]])
                order = ((held.key.astype("int64") * 7919 + 104729) % 149399).rename("p")
                held = held.assign(p=order).sort_values(["p", "key"], kind="stable").head(size)[["key", "tag"]]
            self.rows.put([(int(k), t) for k, t in held.itertuples(index=False)])
            held["n"] = held.groupby("tag", dropna=False)["key"].transform("size").astype("int64")
            yield held

        def close(self):
            pass

    def least(pdfs):
        import pandas as pd

        best = None
        for pdf in pdfs:
            best = pdf if best is None else pd.concat([best, pdf])
            best = best.assign(p=(best.key * 7919 + 104729) % 149399).sort_values(["p", "key"], kind="stable").head(size)[["key", "tag"]]
        if best is not None:
            yield best

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col("tag").cast("string").alias("tag")).where("key IS NOT NULL")
    few = rows.mapInPandas(least, kinds).withColumn("all", F.lit(0))
    return few.groupBy("all").transformWithStateInPandas(Reservoir(), f"{kinds}, n long", "Update", "None")
