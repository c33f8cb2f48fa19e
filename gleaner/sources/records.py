"""JSON records: one array per file, or one record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of the files at ``path``.

    ``lines`` reads one record per line, which Spark can split; it is the form for
    large inputs. Otherwise every file has to be one array from end to end: a
    single object, several values or anything after the array fails, as a
    reader would return the first value and drop the rest.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if lines:
        return reader.json(path)
    whole = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(" \t\r\n")).alias("value"))
    # In brackets of its own, such a file is a list of one element.
    alone = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
    array = F.coalesce(F.startswith("value", F.lit("[")) & alone, F.lit(False))
    # Nothing at all comes of an empty file.
    if whole.isEmpty() or not whole.filter(~array).isEmpty():
        raise ValueError(f"not one JSON array per file: {path}")
    return reader.option("multiLine", True).json(path)


def write_json_arrays(rows: DataFrame, path: str, key: str, per_file: int = 10_000) -> None:
    """One array of about ``per_file`` records per file, for readers of that form."""
    files = max(1, -(-rows.count() // per_file))
    bucket = F.pmod(F.xxhash64(key), F.lit(files))
    arrays = rows.select(bucket.alias("file"), F.struct(*rows.columns).alias("r")).groupBy("file")
    arrays = arrays.agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("file").text(path)
