"""Order-dependent columns for groups of any size.

A window partitioned by conversation puts a whole conversation into one task, and
one conversation may hold a large part of all rows. Here every group is cut into
chunks of consecutive ordinals. Windows run inside a chunk; one small row per chunk
is what is put in order across a group and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 4096


def ordered_scan(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running sums, running maxima and neighbouring values to ``df``.

    ``order`` is an integer column, unique inside a group, so a chunk never holds
    more than ``chunk_rows`` rows. ``sums`` and ``maxes`` include the current row.
    ``previous`` and ``following`` give the neighbour's value, null at the ends;
    ``firsts`` the value of the group's first row.
    """
    sums, maxes = sums or {}, maxes or {}
    previous, following, firsts = previous or {}, following or {}, firsts or {}
    key = [*group, "_chunk"]
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))

    # One row per chunk. Values of fixed width keep this a hash aggregation.
    per_chunk = [F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()]
    per_chunk += [F.max(e).alias(f"_max_{n}") for n, e in maxes.items()]
    per_chunk += [F.max_by(e, order).alias(f"_last_{n}") for n, e in previous.items()]
    per_chunk += [F.min_by(e, order).alias(f"_next_{n}") for n, e in following.items()]
    per_chunk += [F.min_by(e, order).alias(f"_first_{n}") for n, e in firsts.items()]
    totals = chunked.groupBy(*key).agg(*per_chunk)

    across = Window.partitionBy(*group).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = across.rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in sums]
    carried += [F.max(f"_max_{n}").over(before).alias(f"_carry_{n}") for n in maxes]
    carried += [F.lag(f"_last_{n}").over(across).alias(f"_carry_{n}") for n in previous]
    carried += [F.lead(f"_next_{n}").over(across).alias(f"_carry_{n}") for n in following]
    carried += [F.first(f"_first_{n}").over(whole).alias(f"_carry_{n}") for n in firsts]
    carry = totals.select(*key, *carried)

    inside = Window.partitionBy(*key).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = [F.sum(e).over(so_far).alias(f"_local_{n}") for n, e in sums.items()]
    local += [F.max(e).over(so_far).alias(f"_local_{n}") for n, e in maxes.items()]
    local += [F.lag(e).over(inside).alias(f"_local_{n}") for n, e in previous.items()]
    local += [F.lead(e).over(inside).alias(f"_local_{n}") for n, e in following.items()]
    # At a chunk's edge the neighbour is the carried one; inside, it may be null.
    if previous:
        local.append(F.lag(order).over(inside).isNull().alias("_opens"))
    if following:
        local.append(F.lead(order).over(inside).isNull().alias("_closes"))

    def at(edge: str, name: str) -> Column:
        return F.when(F.col(edge), F.col(f"_carry_{name}")).otherwise(F.col(f"_local_{name}"))

    out = [(F.coalesce(f"_carry_{n}", F.lit(0)) + F.col(f"_local_{n}")).alias(n) for n in sums]
    out += [F.greatest(f"_carry_{n}", f"_local_{n}").alias(n) for n in maxes]
    out += [at("_opens", n).alias(n) for n in previous]
    out += [at("_closes", n).alias(n) for n in following]
    out += [F.col(f"_carry_{n}").alias(n) for n in firsts]
    return chunked.select("*", *local).join(carry, key).select(*df.columns, *out)


def with_earlier_rows(
    df: DataFrame, group: list[str], order: str, rows: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Cut groups into chunks that also hold the ``rows`` rows before their first.

    ``order`` must be gap-free. Adds ``_chunk`` and ``_extra``: a window partitioned
    by group and ``_chunk`` that looks back at most ``rows`` rows is exact for every
    row whose ``_extra`` is false. Needs one shuffle and no pre-pass.
    """
    chunk = F.floor(F.col(order) / chunk_rows)
    next_too = (F.col(order) % chunk_rows) >= chunk_rows - rows
    targets = F.when(next_too, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return df.select("*", F.explode(targets).alias("_chunk")).withColumn(
        "_extra", F.col("_chunk") != chunk
    )
