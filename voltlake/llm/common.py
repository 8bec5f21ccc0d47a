"""Helpers shared by the text operators: staged tables, words, packed token postings."""

from __future__ import annotations

import contextlib
import string
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts that read letters and digits only (after A-Z became a-z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local master without it (tests) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: While tables are staged: batches are bounded by bytes, as whole texts are long and a Python task holds some on either side; shuffle files go with the job.
WHILE_STAGING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_lock = threading.Lock()
_staging: dict[str, tuple[int, dict]] = {}  # by session: writes under way, and the settings to come back to


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Settings of staged writes; the first of several threads sets them, the last brings the user's own back."""
    who = str(spark._jsparkSession.sessionUUID())
    with _lock:
        n, before = _staging.get(who, (0, {}))
        if n == 0:
            before = {k: spark.conf.get(k, None) for k in WHILE_STAGING}
            for k, v in WHILE_STAGING.items():
                spark.conf.set(k, v)
        _staging[who] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _staging[who]
            _staging[who] = n - 1, before
            if n == 1:
                del _staging[who]
                for k, v in before.items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voltlake/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with staging(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more, as what was made of them is staged itself."""
    for df in tables:
        ref, path = _paths.pop(id(df), (lambda: None, None))
        if ref() is df:
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (staged), to be broadcast if it has at most ``rows`` rows; else the same join is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all else stays (``lower`` would change other letters as well)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def canonical(text: Column) -> Column:
    """The words of a text joined by single blanks; null or wordless texts give ''."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


#: DuckDB: CRC-32's table of bytes as one row (t); and, with it joined, the unsigned checksum of a short ASCII string.
CRC_TABLE_SQL = """crc_of AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
