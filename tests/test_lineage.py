"""Process instances and as-of joins over blocks against a walk over the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphwright.operators import joins, lineage
from graphwright.operators.blocks import carried

ROW = "position int, terminal int, pid int, parent_pid int, at long, starts boolean, ends boolean, sequence int"


def walked(rows):
    """What a reader of the rows in order keeps: {opening position: (pid, first, last, n, parent, outcome)} and memberships."""
    rows = sorted((r for r in rows if r[2] is not None and r[4] is not None), key=lambda r: (r[4], r[0]))
    bounds = {}
    for _, terminal, pid, _, at, starts, ends, sequence in rows:
        if starts or ends:
            bounds.setdefault((terminal, pid, at), set()).add(sequence)
    opened, found, member = {}, {}, {}
    for position, terminal, pid, parent, at, starts, ends, sequence in rows:
        key = (terminal, pid)
        if ends and bounds.get((*key, at), set()) - {sequence}:
            opened.pop(key, None)
            member[position] = None
            continue
        if key not in opened or starts:
            if parent is None:
                outcome, of = "no_parent_pid", None
            elif parent == pid:
                outcome, of = "own_pid", None
            elif bounds.get((terminal, parent, at), set()) - {sequence}:
                outcome, of = "ambiguous", None
            else:
                of = opened.get((terminal, parent))
                outcome = "not_open" if of is None else "parent"
            opened[key] = position
            found[position] = [terminal, pid, at, at, 0, of, outcome]
        own = opened[key]
        member[position] = own
        found[own][3], found[own][4] = at, found[own][4] + 1
        if ends:
            del opened[key]
    return found, member


def test_lineage_against_a_walk(spark):
    rng = random.Random(21)
    rows = []
    for i in range(3000):
        kind = rng.choice(["start", "end", "", "", ""])
        at = rng.choice([None, rng.randrange(400)]) if rng.random() < 0.02 else rng.randrange(400) * 1000
        rows.append((i, rng.randrange(2), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 1, 2, 3, 4, 5, 9]), at, kind == "start", kind == "end" or None if kind != "start" else False, rng.choice([0, 0, i])))
    processes, members = lineage.lineage(spark.createDataFrame(rows, ROW), ["terminal"], "pid", "parent_pid", "at", "sequence", "position")
    found, member = walked(rows)
    got = {r.process: [r.terminal, r.pid, r.first_seen, r.last_seen, r["rows"], r.parent, r.outcome] for r in processes.collect()}
    assert got == found
    assert {r.outcome for r in processes.collect()} == {"parent", "no_parent_pid", "own_pid", "ambiguous", "not_open"}
    assert {r.position: r.process for r in members.collect()} == member


def test_carried_over_blocks(spark):
    rng = random.Random(22)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(1000), i, rng.choice([None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    got = {r.i: r.w for r in carried(df, ["k"], ["t", "i"], F.col("v"), F.floor(F.col("t") / 50), "w").collect()}
    last, want = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            last[k] = v
        want[i] = None if k is None else last.get(k)
    assert got == want


def test_as_of_of_a_hot_key_is_many_tasks(spark):
    """Half of all rows have one key: no task sorts more than a small part of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(8000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 1000).alias("t"), F.col("id").alias("l"))
        right = left.select("k", (F.col("t") - 10).alias("u"), F.col("l").alias("r"))
        got = joins.asof_latest(left, right, ["k"], "t", "u")
        assert got.where("l = r").count() == 8000
        both = left.select("k", "t").withColumn("__block", F.floor(F.col("t") / 86_400))
        per_task = both.repartition("k", "__block").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert per_task < 1000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
