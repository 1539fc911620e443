"""What the text operators share: scratch tables, column names, label splits, global row numbers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS_BYTES = b"\x20\t\n\x0b\x0c\r"  # the separators of bytes.split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one where it names none and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rastrel-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the application's scratch folder goes when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark).rstrip('/')}/rastrel-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)


#: Scratch tables in a local folder have no .crc files. For each, as for each file and task, Hadoop starts a chmod, which until
#: it runs shares the executor's memory and is counted beside it. Other kinds of store ignore these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost nothing above it."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table() that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/rastrel-" in path:
            _remove(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have, whatever the case of its own."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32 of doc_id as text leaves this rest; a null doc_id counts as held out, so no label is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == F.lit(rest), F.lit(True))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_partitions(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an exchange of whole texts: what the session sets, or its cores if more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)


def offsets(counted: DataFrame, within: list[str], part: str, n: str, name: str) -> DataFrame:
    """The columns within and part, and as `name` the sum of n over the smaller parts of the same `within`. A row for each."""
    before = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*within, part, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(name))


MOST_BROADCAST = 2_000_000  # rows of a few numbers


def small_join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join rows with a table that has a row for each task or part: broadcast after its rows are counted, shuffled if too many."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, on)
