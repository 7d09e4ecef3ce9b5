"""Running sums, carried values and neighbours over ordered groups of any size.

A window over a whole group runs in one task, which fails once a single
conversation, user or document holds a large share of the rows. Here a group
is cut into segments by a bucket of its order column. Windows run inside a
segment, one summary row per segment is carried over the group, and the two
are joined on the segment key, by which the rows are partitioned already.

Where positions are dense, a window over a group's summaries holds one row in
SEGMENT. Where they are sparse, segments are as many as rows; then the
summaries are carried up a tree: FAN neighbouring segment numbers make one of
the next level, whatever the rows they hold, and what a level carries comes
down again to the segments under it. No window holds more than SEGMENT
positions of rows or FAN summaries, but for the top one, which holds one number
in FAN^levels: 2 levels take positions up to 2^59 with at most FAN rows there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096
FAN = 65_536


def position_bucket(position: str, size: int = SEGMENT) -> Column:
    return F.floor(F.col(position) / F.lit(size)).cast("long")


@dataclass(frozen=True)
class Mark:
    """Value of a running total at the last (or first) row so far where ``when`` holds."""

    total: str
    when: Column
    first: bool = False


@dataclass(frozen=True)
class Edge:
    """Running count of rows for which ``test(current, previous)`` holds.

    Both arguments map a name out of ``columns`` to that column of the row; a
    group's first row has nulls as its previous row.
    """

    columns: Sequence[str]
    test: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    marks: Mapping[str, Mark] | None = None,
    edges: Mapping[str, Edge] | None = None,
    nexts: Mapping[str, str] | None = None,
    prevs: Mapping[str, str] | None = None,
    levels: int = 0,
    fan: int = FAN,
) -> DataFrame:
    """Add running and neighbouring values along ``order`` inside each group.

    sums   running totals up to and including the row
    lasts  last non-null values up to and including the row
    marks  running totals at a marked row
    edges  running counts of changes against the row before
    nexts, prevs  values of the next and of the previous row, null at the ends

    ``bucket`` must not decrease along ``order`` inside a group; ``order`` is
    unique in it and keys are not null. All values asked for in one call share
    one shuffle of the rows; the segment summaries, a row each, pass ``levels``
    levels of ``fan`` segments and one window over what the last level leaves.
    Ask for levels where a group's positions are wide and sparse.
    """
    sums, lasts, marks, edges = dict(sums or {}), dict(lasts or {}), dict(marks or {}), dict(edges or {})
    nexts, prevs = dict(nexts or {}), dict(prevs or {})
    seg = [*keys, "_seg"]
    at = F.struct(*order)
    inside = Window.partitionBy(*seg).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    looked = sorted({c for e in edges.values() for c in e.columns})

    local = df.withColumns({"_seg": bucket, **{f"_v_{n}": v for n, v in {**sums, **lasts}.items()}})
    first_pass = {f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
    first_pass |= {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in lasts}
    first_pass |= {f"_l_{n}": F.lead(c).over(inside) for n, c in nexts.items()}
    first_pass |= {f"_l_{n}": F.lag(c).over(inside) for n, c in prevs.items()}
    first_pass |= {f"_g_{c}": F.lag(c).over(inside) for c in looked}
    if nexts:
        first_pass["_tail"] = F.lead(F.lit(1)).over(inside).isNull()
    if prevs or edges:
        first_pass["_head"] = F.lag(F.lit(1)).over(inside).isNull()
    local = local.withColumns(first_pass)
    flags = {
        f"_f_{n}": F.when(F.col("_head"), F.lit(0)).otherwise(e.test(F.col, lambda c: F.col(f"_g_{c}")).cast("long")) for n, e in edges.items()
    }
    local = local.withColumns(flags) if flags else local
    second_pass = {f"_l_{n}": F.sum(f"_f_{n}").over(upto) for n in edges}
    for n, m in marks.items():
        pick = F.first if m.first else F.last
        second_pass[f"_l_{n}"] = pick(F.when(m.when, F.col(f"_l_{m.total}")), ignorenulls=True).over(upto)
    local = local.withColumns(second_pass) if second_pass else local

    totals = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    totals += [F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in lasts]
    totals += [F.max_by(F.col(f"_l_{n}"), at).alias(f"_t_{n}") for n in marks]
    totals += [F.sum(f"_f_{n}").alias(f"_t_{n}") for n in edges]
    totals += [F.min_by(F.struct(F.col(c).alias("v")), at).alias(f"_t_{n}") for n, c in nexts.items()]
    totals += [F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_t_{n}") for n, c in prevs.items()]
    if edges:
        row = F.struct(*looked)
        totals += [F.min_by(row, at).alias("_start"), F.max_by(row, at).alias("_stop")]
    heads = local.groupBy(*seg).agg(*totals)

    up = lambda how, names: {n: (how, f"_t_{n}") for n in names}
    wanted = {**up("sum", sums), **up("last", lasts), **up("next", nexts), **up("prev", prevs)}
    if edges:
        wanted["_before"] = ("prev", "_stop")
    heads = _carried(heads, list(keys), "_seg", wanted, levels, fan)
    heads = heads.withColumns({f"_p_{n}": F.col(f"_p_{n}")["v"] for n in [*nexts, *prevs]}) if nexts or prevs else heads
    later = {f"_e_{n}": e.test(lambda c: F.col("_start")[c], lambda c: F.col("_p__before")[c]).cast("long") for n, e in edges.items()}
    later |= {f"_a_{n}": F.col(f"_p_{m.total}") + F.col(f"_t_{n}") for n, m in marks.items()}
    if later:  # changes and marks need what the first pass carried
        heads = heads.withColumns(later).withColumns({f"_s_{n}": F.col(f"_t_{n}") + F.coalesce(F.col(f"_e_{n}"), F.lit(0)) for n in edges})
        wanted = {n: ("sum", f"_s_{n}") for n in edges} | {n: ("first" if m.first else "last", f"_a_{n}") for n, m in marks.items()}
        heads = _carried(heads, list(keys), "_seg", wanted, levels, fan)
        # The count before a segment's rows takes in the change at its own first row.
        heads = heads.withColumns({f"_p_{n}": F.col(f"_p_{n}") + F.coalesce(F.col(f"_e_{n}"), F.lit(0)) for n in edges})
    heads = heads.select(*seg, *[f"_p_{n}" for n in [*sums, *lasts, *marks, *edges, *nexts, *prevs]])

    out = _rejoin(local, heads, seg)
    values = {n: F.col(f"_p_{n}") + F.coalesce(F.col(f"_l_{n}"), F.lit(0)) for n in [*sums, *edges]}
    values |= {n: F.coalesce(f"_l_{n}", f"_p_{n}") for n in lasts}
    for n, m in marks.items():
        here = F.col(f"_p_{m.total}") + F.col(f"_l_{n}")
        values[n] = F.coalesce(F.col(f"_p_{n}"), here) if m.first else F.coalesce(here, F.col(f"_p_{n}"))
    values |= {n: F.when(F.col("_tail"), F.col(f"_p_{n}")).otherwise(F.col(f"_l_{n}")) for n in nexts}
    values |= {n: F.when(F.col("_head"), F.col(f"_p_{n}")).otherwise(F.col(f"_l_{n}")) for n in prevs}
    return out.select(*df.columns, *[v.alias(n) for n, v in values.items()])


def _carried(heads: DataFrame, keys: list[str], at: str, wanted: Mapping[str, tuple[str, str]], levels: int, fan: int) -> DataFrame:
    """Add ``_p_<name>`` for every wanted (kind, column): what the rows before (for ``next`` the row behind) in the group give.

    sum: their total, 0 for none. last, first: their last or first non-null
    value. prev, next: the neighbouring row's value, a struct that is never null.

    With levels left, rows meet inside buckets of ``fan`` numbers; each bucket
    becomes one row, these are carried in the same way, and what comes from
    before the bucket is put to what the bucket itself gives.
    """
    bucket = f"{at}_up"
    group = [*keys, bucket] if levels else keys
    along = Window.partitionBy(*group).orderBy(at)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)),
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "first": lambda c: F.first(c, ignorenulls=True).over(before),
        "prev": lambda c: F.lag(c).over(along),
        "next": lambda c: F.lead(c).over(along),
    }
    if not levels:
        return heads.withColumns({f"_p_{n}": local[kind](c) for n, (kind, c) in wanted.items()})
    heads = heads.withColumn(bucket, F.floor(F.col(at) / F.lit(fan)).cast("long"))
    heads = heads.withColumns({f"_p_{n}": local[kind](c) for n, (kind, c) in wanted.items()})
    when = lambda c: F.when(F.col(c).isNotNull(), F.col(at))
    whole = {
        "sum": lambda c: F.sum(c),
        "last": lambda c: F.max_by(F.col(c), when(c)),
        "first": lambda c: F.min_by(F.col(c), when(c)),
        "prev": lambda c: F.max_by(F.col(c), F.col(at)),
        "next": lambda c: F.min_by(F.col(c), F.col(at)),
    }
    tops = heads.groupBy(*group).agg(*[whole[kind](c).alias(f"_w_{n}") for n, (kind, c) in wanted.items()])
    tops = _carried(tops, keys, bucket, {n: (kind, f"_w_{n}") for n, (kind, _) in wanted.items()}, levels - 1, fan)
    tops = tops.select(*group, *[F.col(f"_p_{n}").alias(f"_o_{n}") for n in wanted])
    both = _rejoin(heads, tops, group)
    put = {
        "sum": lambda n: F.col(f"_p_{n}") + F.col(f"_o_{n}"),
        "last": lambda n: F.coalesce(F.col(f"_p_{n}"), F.col(f"_o_{n}")),
        "first": lambda n: F.coalesce(F.col(f"_o_{n}"), F.col(f"_p_{n}")),
        "prev": lambda n: F.coalesce(F.col(f"_p_{n}"), F.col(f"_o_{n}")),
        "next": lambda n: F.coalesce(F.col(f"_p_{n}"), F.col(f"_o_{n}")),
    }
    return both.withColumns({f"_p_{n}": put[kind](n) for n, (kind, _) in wanted.items()}).drop(bucket, *[f"_o_{n}" for n in wanted])


def history(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, k: int, name: str) -> DataFrame:
    """Add ``name``, the array of the ``k`` values before each row of its group, oldest first.

    A segment hands on its last ``k`` values; as every segment has a row, the
    last ``k`` segments hold all that a row can look back on.
    """
    seg = [*keys, "_seg"]
    inside = Window.partitionBy(*seg).orderBy(*order)
    one = F.struct(F.col(value).alias("v"))
    local = df.withColumn("_seg", bucket).withColumn("_l", F.collect_list(one).over(inside.rowsBetween(-k, -1)))
    ends = df.withColumn("_seg", bucket)
    ends = ends.withColumn("_r", F.row_number().over(Window.partitionBy(*seg).orderBy(*[F.col(o).desc() for o in order]))).filter(F.col("_r") <= k)
    tails = ends.groupBy(*seg).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), one.alias("x")))).alias("_t"))
    along = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(-k, -1)
    heads = tails.select(*seg, F.transform(F.flatten(F.collect_list("_t").over(along)), lambda x: x["x"]).alias("_p"))
    out = _rejoin(local, heads, seg)
    both = F.concat(F.coalesce("_p", F.array().cast(heads.schema["_p"].dataType)), "_l")
    kept = F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k)
    return out.select(*df.columns, F.transform(kept, lambda x: x["v"]).alias(name))


def _rejoin(local: DataFrame, heads: DataFrame, seg: Sequence[str]) -> DataFrame:
    renamed = heads
    for c in seg:
        renamed = renamed.withColumnRenamed(c, f"_j{c}")
    match = [F.col(c) == F.col(f"_j{c}") for c in seg]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return local.join(renamed, on, "left").drop(*[f"_j{c}" for c in seg])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts each map task to ``k`` rows before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= F.lit(k))
