"""Small files and folders of any storage that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str, start: str = "") -> list[str]:
    fs, where = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if n.startswith(start))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then put it there in one step, over what was there."""
    fs, where = file_system(spark, path)
    aside = where.suffix(".tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    sc = spark.sparkContext
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(where), options)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
