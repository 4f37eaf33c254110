"""What the corpus operators share: folders, staged tables, folds and tokens."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to a Python worker at once; long documents stay bounded.
ARROW_ROWS = "500"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset on a single machine (tests) a temporary folder is
    taken; a cluster without it is refused, for its executors could not see
    each other's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    The files outlive lost executors and cut the lineage; every later reader
    sees the same rows, also where df holds ids that are only fixed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(name: str, *frames: DataFrame) -> str:
    """name, or a longer one where a table has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that may be sent to every task (8 bytes each, or a short text); more meet in a shuffle.
FEW_IDS = 1_000_000


def split_off(df: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """The rows of df whose id is (left_semi) or is not (left_anti) in ids, a staged table of one column.

    Up to FEW_IDS ids go to every task, so df's texts stay where they are.
    """
    name = spare("_id", df)
    ids = ids.toDF(name)
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return df.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col(name), how)


def small_batches(spark: SparkSession) -> None:
    """Sets how many texts a Python worker gets at once, for this session and for good: lazy results need it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(n)).cast("int")


class Ids(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n
