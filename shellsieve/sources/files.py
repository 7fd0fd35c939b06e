"""Scripts from file trees and from columns of tables."""

import uuid

from pyarrow.fs import FileSystem, FileType
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import functions as F

from shellsieve.functions.text import extension_of
from shellsieve.schemas import SCRIPTS
from shellsieve.sources.checkpoints import stored

# What marks a file as a script.
SCRIPT_EXTENSIONS = ("sh", "bash")
SCRIPT_FIRST_LINES = ("#!/bin/bash", "#!/bin/sh")


def _is_named_script(path):
    return extension_of(path).isin(*SCRIPT_EXTENSIONS)


def is_script(path, content):
    """Extension ``sh`` or ``bash``, else a first line naming /bin/bash or /bin/sh."""
    by_name = _is_named_script(path)
    by_line = F.startswith(content, F.lit(SCRIPT_FIRST_LINES[0])) | F.startswith(
        content, F.lit(SCRIPT_FIRST_LINES[1])
    )
    return by_name | (F.is_valid_utf8(content) & by_line)


def with_readable(files, path_col="path", bytes_col="content"):
    """Scripts among (path, bytes): text, or NULL and ``readable = false``.

    An unreadable script stays in the table, so it counts, but it yields no findings.
    """
    text = F.col(bytes_col).cast("string")
    readable = F.is_valid_utf8(text)
    return files.where(is_script(F.col(path_col), text)).select(
        *[name for name in files.columns if name not in (path_col, bytes_col)],
        F.col(path_col).alias("path"),
        F.when(readable, text).alias("content"),
        readable.alias("readable"),
    )


def read_scripts(spark, path, recursive=False):
    """Scripts of a file, of a directory or, with ``recursive``, of a tree.

    A path that does not exist gives an empty table. The files are listed when this is called, and
    read when the table is used. A file that is a script by its name and cannot be read
    by then, or is gone, stays as a row with ``content`` NULL and ``readable`` false: it counts, can
    be listed by name, and ends no scan. One that only its first line would make a script is left
    out. Names starting with '.' or '_' and empty files are not listed by Spark's file sources.
    """
    path = _qualified(spark, path).toString()
    try:
        files = _files(spark, path, recursive)
    except SparkRuntimeException as error:
        # Folders named key=value next to others are taken for broken partitions.
        if recursive or error.getCondition() != "CONFLICTING_DIRECTORY_STRUCTURES":
            raise
        files = _files(spark, path, recursive=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCRIPTS)

    def wanted(files):
        if recursive or any(char in path for char in "*?[{"):
            return files
        # Only direct children count, even where folders were read as partitions.
        parent = F.regexp_replace("path", "/[^/]*\\z", "")
        return files.where((parent == path.rstrip("/")) | (F.col("path") == path))

    # Names and sizes only; this reads no content, so no content can make it fail.
    named = wanted(files.select("path")).where(_is_named_script(F.col("path")))
    named = stored(named, "listing")
    read = wanted(files.select("path", "content"))
    # The second reading keeps paths alone. A scan drops rows without content, and this side with
    # them, so it reads every file once.
    lost = named.join(read.where(F.col("content").isNotNull()).select("path"), "path", "left_anti")
    return with_readable(read).unionByName(
        lost.select("path", F.lit(None).cast("string").alias("content"), F.lit(False).alias("readable"))
    )


def unreadable_scripts(scripts):
    """Paths of scripts that could not be read or hold bytes that are no text."""
    return scripts.where(~F.col("readable")).select("path")


def write_files(files, folder):
    """Each row of ``files`` (name, value) as a file of that name below ``folder``, a place all machines share.

    The tasks write the files through pyarrow, which knows local and mounted folders, HDFS and the larger
    object stores: without its native library, Hadoop's local file system starts two processes a file to
    set its mode. Names are unique. A file takes its name when it is whole, so a task that runs again, or
    beside another attempt, leaves the same files.
    """

    uri = _qualified(files.sparkSession, folder).toUri().toString()

    def write(rows):
        system, root = FileSystem.from_uri(uri)
        for row in rows:
            path = f"{root}/{row['name']}"
            if system.get_file_info(path).type != FileType.NotFound:
                continue
            parent = path.rpartition("/")[0]
            system.create_dir(parent)
            part = f"{parent}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(row["value"].encode())
            system.move(part, path)

    files.select("name", "value").foreachPartition(write)


def delete_files(names, folder):
    """Delete the files of ``names`` (name) below ``folder``; one that is gone already is no error."""

    uri = _qualified(names.sparkSession, folder).toUri().toString()

    def delete(rows):
        system, root = FileSystem.from_uri(uri)
        for row in rows:
            path = f"{root}/{row['name']}"
            if system.get_file_info(path).type != FileType.NotFound:
                system.delete_file(path)

    names.select("name").foreachPartition(delete)


def _qualified(spark, path):
    """``path`` as the file system spells it: absolute, with its scheme, without dots."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path)


def _files(spark, path, recursive):
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .load(path)
    )


def table_scripts(table, id_col, text_col, keep=()):
    """Any text column as a table of scripts."""
    text = F.col(text_col)
    readable = F.is_valid_utf8(text)
    return table.select(
        *keep,
        F.col(id_col).cast("string").alias("path"),
        F.when(readable, text).alias("content"),
        F.coalesce(readable, F.lit(False)).alias("readable"),
    )
