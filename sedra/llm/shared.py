"""What the operators of this subpackage share: scratch tables and word splitting."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset and all run on one machine, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sedra-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, what: str) -> str:
    """A path under the shared folder that was never used before."""
    return f"{shared_dir(spark)}/sedra-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    This cuts lineage: an executor lost later costs no recomputation of what was
    written. Unlike a checkpoint the table is columnar, and its size is known to
    the planner, so a later join broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; results that still read them must be stored before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sedra-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as struct `row` beside the named columns, so that no input column clashes with them."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in columns.items()])


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def groups_for(rows: int, each: int) -> int:
    """How many groups of about `each` rows hold `rows` rows."""
    return max(1, math.ceil(rows / each))
