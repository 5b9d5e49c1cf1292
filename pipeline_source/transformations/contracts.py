"""Source file of a declarative pipeline: five datasets for every contract.

``spark.covenant.contracts`` may name contract files by a pattern, else the bundled ones are taken;
``spark.covenant.source_base`` is the folder of their sources.
"""

from pyspark.sql import SparkSession

from covenant.plans.job import load_contracts
from covenant.plans.named import define_datasets

spark = SparkSession.active()
define_datasets(
    spark,
    load_contracts(spark.conf.get("spark.covenant.contracts", None)),
    source_base=spark.conf.get("spark.covenant.source_base", None),
)
