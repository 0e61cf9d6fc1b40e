"""Tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header at this very path, in any store that Spark writes to: a (small) table is written by one
    task into a folder beside it, and its only part takes the name."""
    spark = df.sparkSession
    folder = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
    files = spark._jvm.org.apache.hadoop.fs
    source = files.Path(folder)
    store = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part = next(f.getPath() for f in store.listStatus(source) if f.getPath().getName().startswith("part-"))
    target = files.Path(path)
    store.delete(target, False)
    if not store.rename(part, target):
        raise OSError(f"could not write {path}")
    store.delete(source, True)
