"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, where all is one machine, may leave it unset and gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="marquee-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marquee-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark writes to."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    path, files = _path(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def read_text(spark: SparkSession, file: str) -> str:
    path, files = _path(spark, file)
    stream = files.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, file: str, text: str) -> bool:
    """Writes a file that does not exist yet, whole or not at all; false if it exists, whoever made it.

    The text is written under another name first.  That file is then linked (local files) or renamed to
    its place, each of which fails where something is.
    """
    path, files = _path(spark, file)
    jvm = spark.sparkContext._jvm
    files.mkdirs(path.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if files.getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(place(path), place(draft))
            except Py4JJavaError as error:
                if "FileAlreadyExistsException" in str(error.java_exception):
                    return False
                raise
            return True
        return not files.exists(path) and files.rename(draft, path)
    finally:
        files.delete(draft, False)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has written to its part of the shared folder; results not yet read are lost."""
    delete_folder(spark, _root(spark))
