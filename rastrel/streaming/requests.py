"""Requests and images as streams: the latest request for each key wins, stale results are dropped, folders are watched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(requests: DataFrame, key: str = "image_id", generation: str = "generation") -> DataFrame:
    """The request with the greatest generation of each key, as one partial aggregate; works on batches and streams."""
    rest = F.struct(*(c for c in requests.columns if c != key))
    return requests.groupBy(key).agg(F.max_by(rest, generation).alias("r_")).select(key, "r_.*")


def current(results: DataFrame, awaited: DataFrame, key: str = "image_id", generation: str = "generation") -> DataFrame:
    """Results of the generation that each key waits for; older ones are stale."""
    return results.join(awaited.select(key, generation), [key, generation], "left_semi")


def watch(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", trigger: str = "1 second"):
    """Read image files as they come and hand each micro-batch (path, content) to a function, once each."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path).select("path", "content")
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def debounced(requests: DataFrame, key: str = "image_id", at: str = "at", quiet: str = "220 milliseconds") -> DataFrame:
    """The last request of each burst: requests of one key that follow each other within `quiet` are one burst.

    On a stream with a watermark on `at`, a burst's request comes out once the watermark has passed its quiet time.
    """
    rest = F.struct(*(c for c in requests.columns if c != key))
    burst = requests.groupBy(F.session_window(at, quiet).alias("burst_"), key).agg(F.max_by(rest, at).alias("r_"))
    return burst.select(key, "r_.*")


class Worker:
    """A loop over a stream of requests: of each micro-batch the latest request of a key is worked on, and the results handed on.

    Requests that come while a batch is at work wait together for the next one, where only the latest counts; results of older
    generations are dropped by current(). After a failure the checkpoint folder gives the unfinished batch again.
    """

    def __init__(self, requests: DataFrame, work: Callable[[DataFrame], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, key: str = "image_id", generation: str = "generation", trigger: str = "100 milliseconds"):
        def batch(given: DataFrame, number: int) -> None:
            handle(work(latest(given, key, generation)), number)

        self.query = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()

    def busy(self) -> bool:
        """Whether a batch is at work or waiting."""
        status = self.query.status
        return bool(status["isTriggerActive"] or status["isDataAvailable"])

    def drain(self) -> None:
        """Wait until all that has come is handled; raises what the work raised."""
        self.query.processAllAvailable()

    def stop(self) -> None:
        self.query.stop()
