"""Where intermediate results are cut off from their lineage."""

import functools
import tempfile
import uuid


def checkpoint_root(spark):
    """The folder the cluster shares for checkpoints.

    That is the setting ``spark.checkpoint.dir`` or the folder given to the context. Where
    neither is set, a local master gets a temporary folder; a cluster gets an error, since
    its machines would write to folders the others cannot read.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.master == "local" or context.master.startswith("local["):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


@functools.cache
def _local_folder():
    return tempfile.mkdtemp(prefix="shellsieve-")


def shared_folder(spark, purpose):
    """A folder of its own below the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df, purpose):
    """``df`` written once to the shared folder and read back, cut off from its lineage."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Scratch:
    """Stored tables that are deleted once nothing reads them any more.

    Tables named in ``keep`` stay; so do all if the work breaks off, for a look at them.
    """

    def __init__(self, spark):
        self.spark, self.folders = spark, {}

    def stored(self, df, purpose):
        folder = shared_folder(self.spark, purpose)
        df.write.parquet(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[folder] = table
        return table

    def drop(self, keep=()):
        """Delete the folders of all tables but those in ``keep``."""
        kept = {}
        for folder, table in self.folders.items():
            if any(table is other for other in keep):
                kept[folder] = table
                continue
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = kept
