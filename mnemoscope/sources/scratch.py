"""Small tables between the rounds of an iterative operator."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back.

    This cuts the lineage between rounds, and the planner then knows the size of
    the table, so it broadcasts a small one and shuffles a large one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mnemoscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
