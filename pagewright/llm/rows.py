"""A key of each row of a table, for operators whose rows may lack an id or share one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

KEY = "_row"


def keyed(df: DataFrame, name: str = KEY) -> DataFrame:
    """``df`` with a long in ``name`` that no other row has: a hash of its file beside its place in the file.

    The key is fixed once the table is written, so every reading of it gives the same one. What is not read from files is written first. File
    names are not gathered: the hash takes the bits that the longest file leaves over, and one without a clash is found by counting.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name}; rename it or give another name")
    try:
        meta = df.metadataColumn("_metadata")
        file, index = meta["file_path"], meta["row_index"]
        most = df.select(index.alias("i")).agg(F.max("i").alias("m")).first()["m"]
    except AnalysisException:
        path = fresh_path(df.sparkSession, "rows")
        df.write.parquet(path)
        return keyed(df.sparkSession.read.parquet(path), name)
    bits = max(1, int(most or 0).bit_length())
    files = df.select(file.alias("file")).distinct()
    for seed in range(64):
        number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("file")), bits + 1)
        told = files.select(F.count("*").alias("n"), F.count_distinct(number).alias("d")).first()
        if told["n"] == told["d"]:
            place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), file), bits + 1)
            return df.select("*", (F.shiftleft(place, bits) + index).alias(name))
    raise RuntimeError("too many files for a key of 63 bits")
