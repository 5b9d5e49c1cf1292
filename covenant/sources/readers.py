"""Reading the source a contract declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.contract import CORRUPT, UNDECLARED, Contract, ContractError
from covenant.operators.columns import any_of, fresh


def read_source(spark: SparkSession, contract: Contract) -> DataFrame:
    """The raw rows, unchanged. Lines that cannot be parsed stay as rows (Spark's PERMISSIVE mode)."""
    source = contract.source
    reader = spark.read
    if source.format == "json":
        several_lines = str(source.options.get("multiLine", "false")).lower() == "true"
        # a record over several lines can only be read by Spark's own reader, which finds all fields
        return reader.options(**source.options).json(source.path) if source.infer or several_lines else _json_lines(spark, contract)
    if source.format == "csv":
        return _csv(spark, contract)
    if source.format == "parquet":
        return reader.options(**source.options).parquet(source.path)
    if source.format == "table":
        return reader.options(**source.options).table(source.path)
    raise ContractError(f"unknown source format {source.format!r}")


def _csv(spark: SparkSession, contract: Contract) -> DataFrame:
    """Columns as text by the header, and the text of records that do not fit it.

    A record with more fields than the header, or fewer, keeps those that have a column; its whole text then is in
    the column of corrupt records too, which reaches the quarantine table. Where the header has a column of that
    name, theirs gets an underscore more.
    """
    options = {"header": "true", "inferSchema": "false", **contract.source.options}
    columns = spark.read.options(**options).csv(contract.source.path).schema
    if str(options["inferSchema"]).lower() != "true":
        kept = options.setdefault("columnNameOfCorruptRecord", fresh(columns.names, CORRUPT))
        columns = columns if kept in columns.names else columns.add(kept, T.StringType())
    return spark.read.options(**options).schema(columns).csv(contract.source.path)


def _json_lines(spark: SparkSession, contract: Contract) -> DataFrame:
    """JSON lines in one pass: declared fields as text, all others in a map, and the text of bad lines.

    Text keeps numbers exactly as written, and a declared schema saves the inference pass. A field
    is matched by its exact name; where the session ignores case, a declared field that a record
    lacks is then looked for in other spellings. ``source.fields`` may name further fields, or
    give the spelling of a declared one. The map is only made for rows whose undeclared fields
    are used, which are those of the quarantine.
    """
    source = contract.source
    sensitive = str(spark.conf.get("spark.sql.caseSensitive", "false")).lower() == "true"
    fold = (lambda name: name) if sensitive else str.lower
    names = {fold(c.name): c.name for c in contract.columns}
    names.update({fold(field): field for field in source.fields})
    kept = source.options.get("columnNameOfCorruptRecord", CORRUPT)
    names.pop(fold(kept), None)
    declared = T.StructType([T.StructField(name, T.StringType()) for name in [*names.values(), kept]])
    options = {**source.options, "columnNameOfCorruptRecord": kept}

    lines = spark.read.options(**source.options).text(source.path).where(F.trim("value") != "")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>", options))
    records = lines.select(F.explode(F.coalesce(listed, F.array("value"))).alias("record"))
    parsed = records.select("record", F.from_json("record", declared, options).alias("found"))
    found = {name: F.col("found").getField(name) for name in [*names.values(), kept]}
    every = F.from_json("record", "map<string,string>", options)
    if not sensitive:
        lacks = found[kept].isNull() & any_of(found[name].isNull() for name in names.values())
        parsed = parsed.withColumn("others", F.when(lacks, F.map_entries(every)))
        for key, name in names.items():
            found[name] = F.coalesce(found[name], _spelled_otherwise("others", key))
    known = [F.lit(key) for key in names]
    rest = F.map_filter(every, lambda key, _: ~(key if sensitive else F.lower(key)).isin(*known))
    extra = F.when(found[kept].isNull() & (F.size(rest) > 0), rest)
    return parsed.select(*[value.alias(name) for name, value in found.items()], extra.alias(UNDECLARED))


def _spelled_otherwise(entries: str, key: str) -> Column:
    """The value of the first entry whose name is ``key`` but for case."""
    return F.get(F.filter(entries, lambda entry: F.lower(entry["key"]) == F.lit(key)), F.lit(0))["value"]
