"""Job intake as a stream: files that land in a shared folder become job entries once each, under names of their own.

An extension of the batch intake; the operators are the same. What a job has used of names and seen of
files is keyed state of the stream, so names stay unique over triggers and restarts, and no
driver holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.folders import stem

_NAMED = "job_id string, file_name string, saved_name string, saved_path string, text string"


def landing(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (job_id, file_name, saved_path, text); job_id is the name of the file's folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("job_id"), F.concat(stem(path), F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("file_name"), path.alias("saved_path"), F.col("value").alias("text"))


class Names(StatefulProcessor):
    """Of each job the names used, in lower case, and the files seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "name string", "n int")
        self.seen = handle.getMapState("seen", "path string", "name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.sort_values("saved_path", kind="stable")
            kept, names = [], []
            for i, (name, path) in enumerate(zip(batch["file_name"], batch["saved_path"], strict=True)):
                if self.seen.containsKey((path,)):
                    continue
                own = self._own(name)
                self.seen.updateValue((path,), (own,))
                kept.append(i)
                names.append(own)
            out = batch.iloc[kept].assign(saved_name=names)
            yield out[["job_id", "file_name", "saved_name", "saved_path", "text"]]

    def _own(self, name: str) -> str:
        """The name, or with _2, _3 and so on before its ending if others of the job have it, whatever their case."""
        first, dot, ending = name.rpartition(".")
        first, ending = (first, dot + ending) if dot else (name, "")
        own, low = name, name.lower()
        if self.used.containsKey((low,)):
            n = self.used.getValue((low,))[0]
            while True:
                n += 1
                own = f"{first}_{n}{ending}"
                if not self.used.containsKey((own.lower(),)):
                    break
            self.used.updateValue((low,), (n,))
            low = own.lower()
        self.used.updateValue((low,), (1,))
        return own

    def close(self) -> None:
        pass


def named(entries: DataFrame) -> DataFrame:
    """Entries of `landing` with saved_name, unique in the job over all triggers; a file that has been seen gives no second entry."""
    return entries.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Names(), outputStructType=_NAMED, outputMode="Append", timeMode="None")


def run(entries: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Processes what has landed, appends job entries as Parquet, and stops; started again, it goes on after them.

    A batch that is tried again after a failure replaces what it had written.
    """

    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
