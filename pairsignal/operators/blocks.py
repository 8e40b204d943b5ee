"""Ordered work on long recordings in bounded pieces.

A recording may hold a large share of all rows, so no window here runs over a whole recording.  Time is cut
into blocks, each window sees one block, and what crosses a block edge travels through a table with one row
per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.session import settle

BLOCK = 65536          # samples in one time block
SMALL_NUMBERS = 4_000_000  # numbers (8 bytes each) a broadcast may hold
ROW_NUMBERS = 16       # numbers in a plain metadata row
KEY_NUMBERS = 1024     # numbers in a key that holds a vector
CHANNELS = 256         # channels of a recording where its table does not tell
HEAVY_ROWS = 1_000_000  # rows of one key above which its join is spread over several tasks
HEAVY_CHUNKS = 256     # chunks of one key above which it is split over tasks
SALTS = 32             # ways a hot key is split when metadata is too large to broadcast


def block_of(t: str | Column = "t", size: int = BLOCK) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / F.lit(size)).cast("bigint")


def running_sums(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Sequence[str] = ("t",), block: str = "block"
) -> DataFrame:
    """Add inclusive running sums (``{new column: value}``) per ``keys`` along ``order``.

    ``block`` must grow with ``order``.  The per-block totals are pre-aggregated map-side; only the main branch
    shuffles rows, once, on ``(keys, block)``.
    """
    keys = list(keys)
    staged = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = staged.groupBy(*keys, block).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, block, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = staged.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    joined = summed.join(carry, [*keys, block])
    return joined.select(*df.columns, *[(F.col(f"_c_{n}") + F.col(f"_w_{n}")).alias(n) for n in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "t") -> DataFrame:
    """Row number from 0 per ``keys`` along ``order``; ``block`` is a coarse, growing function of ``order``."""
    staged = df.withColumn("_block", block)
    numbered = running_sums(staged, keys, {out: F.lit(1).cast("bigint")}, order, "_block")
    return numbered.withColumn(out, F.col(out) - 1).drop("_block")


def with_halo(df: DataFrame, size: int, left: int, right: int, t: str = "t") -> DataFrame:
    """Give each row its block and copy it into neighbour blocks that need it as context.

    A block gets ``left`` samples before its first and ``right`` samples after its last one; ``core`` marks the
    rows that belong to the block itself.
    """
    first = F.greatest(block_of(F.col(t) - right, size), F.lit(0).cast("bigint"))
    last = block_of(F.col(t) + left, size)
    spread = df.withColumn("block", F.explode(F.sequence(first, last)))
    return spread.withColumn("core", F.col("block") == block_of(t, size))


_counted: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_largest: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def row_count(table: DataFrame) -> int:
    """Rows of a metadata table, counted once per table object."""
    if table not in _counted:
        _counted[table] = table.count()
    return _counted[table]


def largest(table: DataFrame, column: str) -> int | None:
    """Largest value of a metadata column, looked up once per table object."""
    known = _largest.setdefault(table, {})
    if column not in known:
        known[column] = table.agg(F.max(column)).first()[0]
    return known[column]


def channel_count(recordings: DataFrame) -> int:
    """The most channels of any recording, looked up once per table."""
    return int(largest(recordings, "n_channels") or 1) if "n_channels" in recordings.columns else CHANNELS


def attach(
    rows: DataFrame,
    meta: DataFrame,
    keys: Sequence[str] | str,
    how: str = "inner",
    bound: DataFrame | None = None,
    numbers: int = ROW_NUMBERS,
    spread: str = "t",
    heavy: int = 0,
) -> DataFrame:
    """Join metadata with few rows per key onto sample rows.

    ``bound`` is a cheap table and ``numbers`` the most numbers ``meta`` holds per row of it; they prove the size
    before a broadcast.  Beyond the limit the key is salted, so a hot recording is still split over many tasks.  Wide
    ``meta`` is repeated only if a key has more than ``heavy`` rows, where that is given; the rows' keys are counted first.

    The size Spark expects of ``meta`` comes from compressed files, not from what is computed out of them, so beyond the
    limit the join is told not to broadcast.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if row_count(meta if bound is None else bound) * numbers <= SMALL_NUMBERS:
        return rows.join(F.broadcast(meta), keys, how)
    if heavy and not rows.groupBy(*keys).count().filter(F.col("count") > heavy).limit(1).count():
        return rows.join(meta.hint("merge"), keys, how)
    salted = meta.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(
        salted.hint("merge"), [*keys, "_salt"], how
    ).drop("_salt")


def spread_join(rows: DataFrame, meta: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Inner join in which a heavy key of ``rows`` is split over tasks and its ``meta`` rows are repeated for them.

    At most one key in ``HEAVY_ROWS`` rows is heavy, so the list of heavy keys is short; it is counted before use.
    """
    keys = list(keys)
    heavy = settle(
        rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / HEAVY_ROWS).cast("bigint").alias("_parts")).filter("_parts > 1")
    )
    if row_count(heavy) == 0:
        return rows.join(meta, keys)
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    split = attach(rows, heavy, keys, "left", numbers=KEY_NUMBERS, spread=spread).withColumn("_part", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    repeated = meta.join(heavy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return split.join(repeated, [*keys, "_part"]).drop("_part")


def attach_whole(whole: DataFrame, meta: DataFrame, keys: Sequence[str] | str, how: str = "inner", bound: DataFrame | None = None,
                 numbers: int = ROW_NUMBERS) -> DataFrame:
    """As ``attach`` for whole chunks: a key has few of them, so beyond the broadcast limit nothing is repeated."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    small = row_count(meta if bound is None else bound) * numbers <= SMALL_NUMBERS
    return whole.join(F.broadcast(meta) if small else meta.hint("merge"), keys, how)
