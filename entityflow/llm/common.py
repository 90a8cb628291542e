"""What the operators of this subpackage share: word tables, clash-free columns, tables in the shared folder."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to lower-case words separated by spaces: A-Z is lowered, digits, a-z and all non-ASCII bytes stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words in a text that is not lowered yet.
WORD_IN_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The separators between words as a Java pattern for text that is not lowered yet.
JAVA_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Rows of an Arrow batch between Spark and Python. A batch stands several times in an executor's memory outside the heap:
#: as vectors, as the stream made of them and in the worker. Spark's own 10,000 texts take tens of megabytes each time.
ROWS_A_BATCH = 512
#: Its bytes at most, or one row: 512 long texts would be tens of megabytes again.
BYTES_A_BATCH = 4 << 20


def to_words(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns that an operator is about to add, so that its own result wins a clash of names."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra columns never reach an operator that does not return them."""
    return df.select(*[df[n] for n in names])


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or in local mode one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="entityflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def short_batches(spark: SparkSession):
    """``ROWS_A_BATCH`` rows and ``BYTES_A_BATCH`` bytes in an Arrow batch of what is run inside, or the session's own bounds
    where those are less."""
    prefix = "spark.sql.execution.arrow.max"
    rows, size = f"{prefix}RecordsPerBatch", f"{prefix}BytesPerBatch"
    own = {key: spark.conf.get(key) for key in (rows, size)}
    n, most = int(own[rows]), spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own[size])
    spark.conf.set(rows, str(ROWS_A_BATCH if n <= 0 else min(ROWS_A_BATCH, n)))
    spark.conf.set(size, str(BYTES_A_BATCH if most <= 0 else min(BYTES_A_BATCH, most)))
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, what: str, rows: int | None = None, per_file: int = 1 << 17) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, survives a lost executor.

    With a bound of its rows it goes to a file for each ``per_file`` rows, and to one for each core at least, not to one
    for each shuffle partition. Give none where ``df`` ends in a join: a task that takes several partitions of a
    sort-merge join keeps the memory of every one. What earlier tables were shuffled by is of no more use then; the driver's
    collector lets Spark delete it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // per_file)))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more; what was made of them must be written by then."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the parts by MD5: 52 bits, the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, also where ``f`` uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]
