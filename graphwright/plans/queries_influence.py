"""Queries over influence: spans, versions of files, several questions and clocks.

Users write files (purchases) and read them (clicks); a signup replaces the file
of its number. Purchases are also contacts between users, folded to 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_s
from ..operators import clocks, influence
from .registry import query, table


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def steps(spark, sf_dir) -> DataFrame:
    """(step, src, dst, basis, width, and spans) of the contacts between users."""
    at = epoch_s(F.col("ts"))
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("step"), (F.col("user_id") % 50).alias("src"), (_k() % 50).alias("dst"),
        F.when(F.col("event_id") % 3 == 0, "argument_name").otherwise("operation").alias("basis"),
        F.when(F.col("event_id") % 4 == 0, 3600).otherwise(0).alias("width"),
        at.alias("depart_lo"), at.alias("depart_hi"), (at + 60).alias("arrive_lo"), (at + 60).alias("arrive_hi"),
    )


#: question, origin, target, start, end: at leisure, within some days, and too short for any but few.
QUESTIONS = [
    (1, 1, 2, 0, 4102444800), (2, 3, 17, 1704500000, 1704900000), (3, 5, 30, 1705000000, 1705150000),
    (4, 8, 9, 1705000000, 1705200000), (5, 11, 40, 1705500000, 1705600000), (6, 20, 21, 1706000000, 1706020000),
]
_QUESTIONS = ", ".join(map(str, QUESTIONS))

_STEPS = """
e as (select event_id as step, user_id % 50 as src, cast(json_extract_string(props, '$.k') as bigint) % 50 as dst,
    case when event_id % 3 = 0 then 'argument_name' else 'operation' end as basis,
    case when event_id % 4 = 0 then 3600 else 0 end as width, epoch_us(ts) // 1000000 as t
  from events where event_type = 'purchase')"""

_PATHS = f"""
with recursive {_STEPS},
s(search, wide, everything) as (values ('exact', 0, false), ('widened', 1, false), ('open', 1, true)),
q(question, origin, target, low, high) as (values {_QUESTIONS}),
c as (
  select search, step, src, dst, basis, t - wide * width as dlo, t + wide * width as dhi,
         t + 60 - wide * width as alo, t + 60 + wide * width as ahi
  from e, s where everything or basis <> 'argument_name'),
asked as (select search, question, origin, target, low - wide * 5 as low, high + wide * 5 as high from q, s),
f(search, question, node, tm) as (
  select search, question, origin, low from asked
  union
  select f.search, f.question, c.dst, greatest(f.tm, c.dlo, c.alo)
  from f join c on c.search = f.search and c.src = f.node and greatest(f.tm, c.dlo) <= c.dhi
    and greatest(f.tm, c.dlo, c.alo) <= c.ahi),
a as (select search, question, node, min(tm) as value from f group by all),
b(search, question, node, tm) as (
  select search, question, target, high from asked
  union
  select b.search, b.question, c.src, least(b.tm, c.ahi, c.dhi)
  from b join c on c.search = b.search and c.dst = b.node and least(b.tm, c.ahi) >= c.alo
    and least(b.tm, c.ahi, c.dhi) >= c.dlo),
d as (select search, question, node, max(tm) as value from b group by all),
found as (
  select c.search, a.question, c.step, c.basis
  from c join a on a.search = c.search and a.node = c.src
  join d on d.search = c.search and d.question = a.question and d.node = c.dst
  where greatest(a.value, c.dlo) <= c.dhi and c.alo <= least(d.value, c.ahi)
    and greatest(a.value, c.dlo) <= least(d.value, c.ahi))
select question, step, bool_or(search = 'exact') as exact, bool_or(search = 'widened') as widened,
       null::varchar as excluded_basis
from found where search <> 'open' group by question, step
union all
select question, step, false, false, basis
from found where search = 'open' and basis = 'argument_name'
  and question not in (select question from found where search = 'widened')"""


@query(_PATHS)
def influence_paths(spark, sf_dir):
    """Steps on paths for six questions: exact, by the width of their times, or shut by what is left out."""
    asked = spark.createDataFrame(QUESTIONS, "question int, origin long, target long, start long, `end` long")
    return influence.influence_paths(steps(spark, sf_dir), asked, ["argument_name"], 5)


def _replacements(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return rows.select(F.concat(F.lit("f"), _k().cast("string")).alias("node"), epoch_s(F.col("ts")).alias("at"))


def _contacts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')")
    user, file = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("f"), _k().cast("string"))
    writes, at, n = F.col("event_type") == "purchase", epoch_s(F.col("ts")), F.col("event_id") % 10
    lo = F.when(n == 0, None).when(n < 4, at - 40_000 * n).otherwise(at)
    return rows.select(
        F.col("event_id").alias("contact"), F.when(writes, user).otherwise(file).alias("src"),
        F.when(writes, file).otherwise(user).alias("dst"), lo.alias("lo"), at.alias("hi"),
    )


_VERSIONS = """
e as (select event_id, event_type, event_id % 10 as n, 'u' || user_id as u, 'f' || json_extract_string(props, '$.k') as f,
    epoch_us(ts) // 1000000 as t from events),
r as (select distinct f as node, t from e where event_type = 'signup'),
v as (
  select node, t as lo, lead(t) over (partition by node order by t) - 1 as hi from r
  union all select node, null, min(t) - 1 from r group by node),
c as (
  select event_id as contact, case when event_type = 'purchase' then u else f end as src,
         case when event_type = 'purchase' then f else u end as dst, f as file,
         case when n = 0 then null when n < 4 then t - 40000 * n else t end as lo, t as hi
  from e where event_type in ('purchase', 'click')),
pieces as (
  select contact, src, dst, case when src = file then v.lo end as src_version, case when dst = file then v.lo end as dst_version,
         case when v.lo is null or v.lo <= c.lo then c.lo when c.lo is null then v.lo else greatest(c.lo, v.lo) end as lo,
         case when v.hi is null or v.hi >= c.hi then c.hi else v.hi end as hi
  from c left join v on v.node = file and (v.lo is null or v.lo <= c.hi) and (v.hi is null or c.lo is null or v.hi >= c.lo))"""


@query(f"with {_VERSIONS} select * from pieces")
def versioned_contacts(spark, sf_dir):
    """Reads and writes between users and the versions of files, spans cut where a version ends."""
    return influence.versioned(_contacts(spark, sf_dir), _replacements(spark, sf_dir))


@query(f"""
with recursive {_VERSIONS},
s as (select concat_ws('@', src, src_version) as src, concat_ws('@', dst, dst_version) as dst, lo, hi from pieces),
a(node, tm) as (
  select 'u1', 1704067200
  union
  select s.dst, greatest(a.tm, coalesce(s.lo, a.tm)) from a join s on s.src = a.node and greatest(a.tm, coalesce(s.lo, a.tm)) <= s.hi)
select node, min(tm)::bigint as value from a group by node""")
def versioned_arrivals(spark, sf_dir):
    """When a user's influence first reaches each user and each version of a file; replaced content leads nowhere."""
    starts = spark.createDataFrame([(1, "u1", 1704067200)], "question int, node string, at long")
    found = influence.version_arrivals(_contacts(spark, sf_dir), _replacements(spark, sf_dir), starts)
    return found.select(F.concat_ws("@", "node", F.col("version").cast("string")).alias("node"), "value")


def _timed(spark, sf_dir, clock) -> DataFrame:
    own = steps(spark, sf_dir)

    def point(lo: str, hi: str):
        return F.array(F.struct(clock.alias("clock"), F.col(lo).alias("lo"), F.col(hi).alias("hi")))

    return own.select("step", "src", "dst", point("depart_lo", "depart_hi").alias("depart"), point("arrive_lo", "arrive_hi").alias("arrive"))


def _asked(spark, rows):
    return spark.createDataFrame(rows, "question int, origin long, origin_clock int, start long, target long, target_clock int, `end` long")


@query(f"""
with recursive {_STEPS},
c as (select step, src, dst, t as depart, t + 60 as arrive from e),
f(node, tm) as (select 1, 0 union select c.dst, c.arrive from f join c on c.src = f.node and c.depart >= f.tm),
a as (select node, min(tm) as value from f group by node),
b(node, tm) as (select 2, 4102444800 union select c.src, c.depart from b join c on c.dst = b.node and c.arrive <= b.tm),
d as (select node, max(tm) as value from b group by node)
select 1 as question, step, true as single, false as mixed
from c join a on a.node = c.src and c.depart >= a.value join d on d.node = c.dst and c.arrive <= d.value""")
def one_clock_paths(spark, sf_dir):
    """Steps on paths by matrices of bounds where all times are of one clock: those of plain reachability."""
    return clocks.reach_clocks(_timed(spark, sf_dir, F.lit(1)), _asked(spark, [(1, 1, 1, 0, 2, 1, 4102444800)]))[0]


@query()
def two_clock_paths(spark, sf_dir):
    """Steps on paths where the clocks of odd users and even users may differ by any time.

    SQL has no matrices; a test compares with the enumeration of all walks.
    """
    own = _timed(spark, sf_dir, (F.col("src") % 2).cast("int"))
    return clocks.reach_clocks(own, _asked(spark, [(1, 1, 1, 1706400000, 2, 0, 1706500000)]))[0]
