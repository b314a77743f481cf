"""Tables in a folder: scan, append, staged replacement, raw SQL with parameters, row printing."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or, where unset and all run on one machine, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="sedra-")


class Store:
    """Parquet tables by name. A replacement is staged beside the table and then swapped in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def columns(self, name: str) -> list[tuple[str, str]]:
        """Names and types, as the table has them."""
        return self.read(name).dtypes

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows without reading the table."""
        rows.write.mode("append").parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes rows, which may read the table itself, and swaps them in; a failed write leaves the table as it was.

        Between the two renames of the swap no table has the name: readers at that
        moment fail, and after a crash there the old one is beside it as `.old`.
        """
        staged, old = f"{self.path(name)}.staged", f"{self.path(name)}.old"
        rows.write.mode("overwrite").parquet(staged)
        fs, p = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.delete(p(old), True)
        if fs.exists(p(self.path(name))):
            fs.rename(p(self.path(name)), p(old))
        fs.rename(p(staged), p(self.path(name)))
        fs.delete(p(old), True)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def sql(spark: SparkSession, text: str, params: dict | list | None = None, **tables: DataFrame) -> DataFrame:
    """A raw statement with bound parameters (:name or ?), over the frames given by name."""
    return spark.sql(text, params, **tables) if params is not None else spark.sql(text, **tables)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database with a JDBC driver on the class path; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def printed(df: DataFrame, patterns: dict[str, str], separator: str = "\t") -> DataFrame:
    """`line`: each row as text, dates and times by pattern; nulls are empty."""

    def one(name: str) -> Column:
        c = F.col(name)
        return F.coalesce(F.date_format(c, patterns[name]) if name in patterns else c.cast("string"), F.lit(""))

    return df.select(F.concat_ws(separator, *[one(c) for c in df.columns]).alias("line"))
