"""Saving fitted models and reading them back.

A kept model is a folder of versions and a small file that names the current one. A new version is written beside the
old one and takes over by one atomic rename, so a save that fails leaves the last good model as it was.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import SparkSession

_POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop package, its configuration, the path, and its file system."""
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    conf = context._jsc.hadoopConfiguration()
    where = fs.Path(path)
    return fs, conf, where, where.getFileSystem(conf)


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the version in force; None if there is none."""
    fs, _, where, system = _hadoop(spark, path)
    pointer = fs.Path(where, _POINTER)
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, version: str) -> None:
    """Name another version: a whole new pointer replaces the old one by a rename."""
    fs, conf, where, system = _hadoop(spark, path)
    written = fs.Path(where, f"{_POINTER}-{uuid.uuid4().hex}")
    stream = system.create(written)
    stream.writeUTF(version)
    stream.close()
    context = spark.sparkContext
    rename = getattr(fs, "Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = fs.FileContext.getFileContext(system.getUri(), conf)
    files.rename(system.makeQualified(written), system.makeQualified(fs.Path(where, _POINTER)), options)


def save_model(model: Model | MLWritable, path: str) -> None:
    """Write a fitted pipeline or a single fitted stage, and let it take the place of the model at the path.

    Until the new version is complete, and if writing it fails, the path gives the old one. The version before is
    removed afterwards, so a reader that opened it just then has to load again.
    """
    spark = SparkSession.active()
    version = f"version-{uuid.uuid4().hex}"
    before = _current(spark, path)
    model.write().save(f"{path}/{version}")
    _switch(spark, path, version)
    if before is not None:
        fs, _, where, system = _hadoop(spark, path)
        system.delete(fs.Path(where, before), True)


def load_model(path: str) -> Model:
    """Whatever ``save_model`` wrote, or a plain folder of Spark ML; the stored metadata names its class."""
    spark = SparkSession.active()
    version = _current(spark, path)
    return DefaultParamsReader.loadParamsInstance(path if version is None else f"{path}/{version}", spark)
