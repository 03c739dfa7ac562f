"""Shared tables: what is shuffled for one does not stay on the disk."""

from __future__ import annotations

import gc
import time

from pyspark.sql import functions as F

from graphwright.plans.storage import written


def test_shuffles_of_a_table_are_deleted(spark):
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    gc.collect()
    before = shuffled()
    rows = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count()
    table = written(rows, "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == rows.count() == 997
