"""Small helpers that several training-data operators share."""

from __future__ import annotations

import re
import string
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the operators split and strip on: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder that the session names in ``spark.checkpoint.dir``.

    A local session without one gets a folder of its own; a cluster raises, as a folder of the driver's
    would not be there for the executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="meterlake-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows and ``size`` bytes of a text column.

    A longer text makes a slice of its own, so what a task holds is bounded by its longest text.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, before + size, side="right")), begin + 1)
            end = min(end, begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about ``size`` code points, each beginning at white space that follows something else.

    What stands between two such places (a very long word or run of blanks) is never cut.
    """
    begin = 0
    while len(text) - begin > size:
        at = _EDGE.search(text, begin + size)
        if at is None:
            break
        yield text[begin : at.start()]
        begin = at.start()
    yield text[begin:]


#: Unicode's white space, as the body of a class (Python's \\s also holds the separators 1C to 1F).
UNICODE_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"(?<=[^{UNICODE_WHITE}])(?=[{UNICODE_WHITE}])")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key of more than this part of all rows, and of more than MIN_HOT rows, is split in a spread join.
HOT = 1024
MIN_HOT = 500


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, salt: list[str]) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and the key's rows of ``left`` as ``n``.

    Keys of more than a HOT-th of the rows - there are at most HOT, so their table is broadcast - are
    split into as many parts as they have HOT-ths, by a hash of the columns ``salt`` of ``left``.
    ``right`` is read several times and should be cut.
    """
    part = max(MIN_HOT, (right.agg(F.sum(n)).first()[0] or 0) // HOT)
    right = right.withColumn("__of", F.ceil(F.col(n) / part).cast("int"))
    hot = right.filter("__of > 1").select(*(F.col(k).alias(f"__hot{i}") for i, k in enumerate(keys)), F.col("__of").alias("__parts"))
    same = [F.col(k) == F.col(f"__hot{i}") for i, k in enumerate(keys)]
    for more in same[1:]:
        same[0] = same[0] & more
    number = F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__parts")), F.lit(0)).cast("int")
    tagged = left.join(F.broadcast(hot), same[0], "left").withColumn("__salt", number).drop("__parts", *(f"__hot{i}" for i in range(len(keys))))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__of") - 1))).drop("__of")
    return tagged.join(copies, [*keys, "__salt"]).drop("__salt")
