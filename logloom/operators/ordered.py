"""Ordered scans that never put a whole group into one task.

A session (or any ordered group) may hold a large share of all rows, so a plain
window over it would sort that share in a single task. Rows are therefore cut
into chunks of bounded size along their order; windows run inside
(group, chunk), one small summary row per chunk is scanned per group, and the
carried state is joined back on (group, chunk). The join reuses the hash
partitioning of the windows: rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 1 << 16


def chunk_of(order: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number along a dense integer order (line numbers, event ids)."""
    return F.floor(F.col(order) / F.lit(rows)).cast("bigint")


def scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    chunk: Column | None = None,
    *,
    lag: dict[str, Column] | None = None,
    carry: dict[str, Column] | None = None,
    carry_before: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    running_max: dict[str, Column] | None = None,
    island: dict[str, list[str]] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add columns computed along `order` within `group`.

    lag           value of the previous row (NULL on the first)
    carry         last non-null value up to and including the row
    carry_before  last non-null value strictly before the row
    running       sum of all rows up to and including the row
    running_max   maximum strictly before the row
    island        1-based number of the run of equal (null-safe) columns
    descending    scan from the last row to the first

    Group columns must not be NULL.
    """
    lag, carry, carry_before = lag or {}, carry or {}, carry_before or {}
    running, running_max, island = running or {}, running_max or {}, island or {}
    if chunk is None:
        chunk = chunk_of(order[0])
    rows = df.withColumn("__chunk", -chunk if descending else chunk)
    seq = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    at = F.struct(*order)
    first_of = (F.max_by if descending else F.min_by)
    last_of = (F.min_by if descending else F.max_by)
    w = Window.partitionBy(*group, "__chunk").orderBy(*seq)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    # inputs as plain columns, so rows and summary read the same values
    inputs = {f"__lag_{n}": c for n, c in lag.items()}
    inputs |= {f"__car_{n}": c for n, c in carry.items()}
    inputs |= {f"__cab_{n}": c for n, c in carry_before.items()}
    inputs |= {f"__run_{n}": c for n, c in running.items()}
    inputs |= {f"__max_{n}": c for n, c in running_max.items()}
    inputs |= {f"__isk_{n}": F.struct(*keys) for n, keys in island.items()}
    rows = rows.withColumns(inputs) if inputs else rows

    local: dict[str, Column] = {"__head": F.row_number().over(w) == 1}
    local |= {f"__l_lag_{n}": F.lag(f"__lag_{n}").over(w) for n in lag}
    local |= {f"__l_car_{n}": F.last(f"__car_{n}", ignorenulls=True).over(upto) for n in carry}
    local |= {f"__l_cab_{n}": F.last(f"__cab_{n}", ignorenulls=True).over(before) for n in carry_before}
    local |= {f"__l_run_{n}": F.sum(f"__run_{n}").over(upto) for n in running}
    local |= {f"__l_max_{n}": F.max(f"__max_{n}").over(before) for n in running_max}
    for n in island:
        prev = F.lag(f"__isk_{n}").over(w)
        local[f"__brk_{n}"] = F.when(prev.isNull() | prev.eqNullSafe(F.col(f"__isk_{n}")), 0).otherwise(1)
    rows = rows.withColumns(local)
    if island:
        rows = rows.withColumns({f"__l_isl_{n}": F.sum(f"__brk_{n}").over(upto) for n in island})

    # one summary row per (group, chunk), map-side combined
    agg = [F.count(F.lit(1)).alias("__n")]
    agg += [last_of(F.struct(F.col(f"__lag_{n}").alias("v")), at).alias(f"__t_lag_{n}") for n in lag]
    for tag, names in (("car", carry), ("cab", carry_before)):
        agg += [last_of(F.col(f"__{tag}_{n}"), F.when(F.col(f"__{tag}_{n}").isNotNull(), at)).alias(f"__t_{tag}_{n}")
                for n in names]
    agg += [F.sum(f"__run_{n}").alias(f"__t_run_{n}") for n in running]
    agg += [F.max(f"__max_{n}").alias(f"__t_max_{n}") for n in running_max]
    for n in island:
        agg += [first_of(F.col(f"__isk_{n}"), at).alias(f"__h_isl_{n}"),
                last_of(F.col(f"__isk_{n}"), at).alias(f"__t_isl_{n}"),
                F.sum(f"__brk_{n}").alias(f"__b_isl_{n}")]
    summary = rows.groupBy(*group, "__chunk").agg(*agg)

    cw = Window.partitionBy(*group).orderBy("__chunk")
    cb = cw.rowsBetween(Window.unboundedPreceding, -1)
    state: dict[str, Column] = {}
    state |= {f"__c_lag_{n}": F.lag(f"__t_lag_{n}").over(cw)["v"] for n in lag}
    for tag, names in (("car", carry), ("cab", carry_before)):
        state |= {f"__c_{tag}_{n}": F.last(f"__t_{tag}_{n}", ignorenulls=True).over(cb) for n in names}
    state |= {f"__c_run_{n}": F.sum(f"__t_run_{n}").over(cb) for n in running}
    state |= {f"__c_max_{n}": F.max(f"__t_max_{n}").over(cb) for n in running_max}
    for n in island:
        tail = F.lag(f"__t_isl_{n}").over(cw)
        state[f"__e_isl_{n}"] = F.when(tail.isNull() | tail.eqNullSafe(F.col(f"__h_isl_{n}")), 0).otherwise(1)
    summary = summary.withColumns(state)
    summary = summary.withColumns({
        f"__c_isl_{n}": F.coalesce(F.sum(f"__b_isl_{n}").over(cb), F.lit(0))
        + F.sum(f"__e_isl_{n}").over(cw.rowsBetween(Window.unboundedPreceding, 0)) for n in island})
    kept = [c for c in summary.columns if c.startswith("__c_")]
    # plain equality on the window's own keys: the rows keep their partitioning
    out = rows.join(summary.select(*group, "__chunk", *kept), [*group, "__chunk"], "left")
    final: dict[str, Column] = {}
    final |= {n: F.when(F.col("__head"), F.col(f"__c_lag_{n}")).otherwise(F.col(f"__l_lag_{n}")) for n in lag}
    for tag, names in (("car", carry), ("cab", carry_before)):
        final |= {n: F.coalesce(F.col(f"__l_{tag}_{n}"), F.col(f"__c_{tag}_{n}")) for n in names}
    final |= {n: F.coalesce(F.col(f"__l_run_{n}"), F.lit(0)) + F.coalesce(F.col(f"__c_run_{n}"), F.lit(0)) for n in running}
    final |= {n: F.greatest(F.col(f"__l_max_{n}"), F.col(f"__c_max_{n}")) for n in running_max}
    final |= {n: F.col(f"__l_isl_{n}") + F.col(f"__c_isl_{n}") + 1 for n in island}
    out = out.withColumns(final)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def top_one(df: DataFrame, group: list[str], best: Column, columns: list[str], largest: bool = False) -> DataFrame:
    """First (or last) row per group by `best`, as an aggregate so a hot group combines map-side."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*group).agg(pick(F.struct(*columns), best).alias("__r")).select(*group, "__r.*")


def upper_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Element floor(n/2) of the sorted values per group.

    Counts per distinct value are combined before anything is ordered, so the
    window sees at most one row per distinct (rounded) value of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*group).orderBy(value)
    total = F.sum("__c").over(Window.partitionBy(*group))
    upto = F.sum("__c").over(w)
    return (counts.withColumns({"__n": total, "__u": upto})
            .filter(F.col("__u") > F.floor(F.col("__n") / 2))
            .groupBy(*group).agg(F.min(value).alias(name)))
