"""What a job keeps in the folder that all executors share: tables that cut its lineage, and files of arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from io import BytesIO

import numpy as np
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="siftwright-"))


class Workspace:
    """One job's folder below the shared root.

    Tables written here outlive the executors that made them. The last tables of a job
    stay, because the returned DataFrame reads them; ``drop`` removes the others early.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/siftwright/{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store_path(self, name: str) -> str:
        """The same place as pyarrow's file systems take it."""
        path = self.path(name)
        return path if ":" in path.split("/")[0] else os.path.abspath(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, from a parquet table instead of from its lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove a table, or the whole folder."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def save_arrays(folder: str, **arrays: np.ndarray) -> str:
    """A new file of arrays in folder; a task that runs again writes another, so nothing is overwritten."""
    held = BytesIO()
    np.savez(held, **arrays)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.npz"
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(held.getbuffer())
    return name


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f, np.load(BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}
