"""Writers. Each writes a folder, with as many files as the data has partitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fasta(cds: DataFrame, path: str) -> None:
    cds.orderBy("gene").select(F.concat(F.lit(">"), F.col("gene").cast("string"), F.lit("\n"), "seq").alias("value")).write.option("compression", "gzip").text(path)


def tsv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Tab-separated with a header; doubles with the given significant digits."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    df.select([F.format_string(f"%.{digits}g", F.col(c).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.csv(path, sep="\t", header=True)


def bundle(frames: dict[str, DataFrame], config: dict, path: str, digits: int = 6) -> None:
    """A folder with a table for each frame, and as one row of JSON text the configuration and the tables' schemas; results.read reads it.
    With 17 digits doubles come back as they were."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        tsv(df, f"{path}/{name}", digits)
    schemas = {name: ", ".join(f"`{c}` {t}" for c, t in df.dtypes) for name, df in frames.items()}
    text = json.dumps(config | {"schemas": schemas}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/config")
