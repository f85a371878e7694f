"""Judges are derived in all tasks, whatever the row groups of the tables, and no hash is computed for a condition again."""

import pytest
from pyspark.sql import functions as F

from assay.plans import derive as D
from assay.plans import load_entries

SF = "/root/testdata/sf0.001"


def test_scored_rows_come_from_all_partitions(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = D.predictions(D.spread(D.bare_records(spark, SF)))
    assert rows.select(F.spark_partition_id()).distinct().count() == n


@pytest.mark.parametrize("name", ["confidence_histogram", "threshold_selection"])
def test_no_condition_hashes_again(spark, name):
    plan = load_entries()[name].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    hashing = [line for line in plan.splitlines() if "sha2(" in line]
    assert not [line for line in hashing if "Filter" in line]
