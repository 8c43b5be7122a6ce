"""A results folder as a source: the tables that sinks.bundle wrote, with their schemas, and the configuration of the run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "mode string, species string, kmer int, schemas map<string, string>, _damaged string"


def read(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict, list[str]]:
    """The tables by name, the configuration, and what is wrong with the folder.

    Tables are planned only, with the types that the configuration names. Where it is missing or damaged this is told, and tables have columns of
    text; so has a table that it does not name. A table that it names and that is not there is told as well."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")  # names alone, no contents
    folder = F.element_at(F.split("path", "/"), -2)
    there = sorted(r.name for r in listed.where("not endswith(path, '_SUCCESS')").select(folder.alias("name")).distinct().collect())  # as many as tables
    problems, config = [], {}
    if "config" in there:
        raw = spark.read.text(f"{path}/config", wholetext=True).select("value", F.from_json("value", CONFIG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("c"))
        row = raw.first()
        if row is None or row.c is None or row.c["_damaged"] is not None or row.c["schemas"] is None:
            problems.append("the configuration is damaged" if row is None or row.c is None or row.c["_damaged"] is not None else "the configuration names no schemas")
        else:
            config = json.loads(row.value)
    else:
        problems.append("there is no configuration")
    schemas = config.get("schemas", {})
    problems += [f"the table {n} is missing" for n in sorted(schemas) if n not in there]
    tables = {}
    for name in there:
        if name == "config":
            continue
        if schemas and name not in schemas:
            problems.append(f"the configuration does not name the table {name}")
        reader = spark.read.option("sep", "\t").option("header", True)
        tables[name] = reader.schema(schemas[name]).option("enforceSchema", False).csv(f"{path}/{name}") if name in schemas else reader.csv(f"{path}/{name}")
    return tables, config, problems
