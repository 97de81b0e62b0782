"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, the source's target over its
size. Whole copies are certain; the fraction is an inclusion probability. The flight phase of the
cube method (Deville and Tillé 2004, in the form of Chauvet and Tillé 2006) moves three probabilities
at a time along the null space of the balancing constraints, here the number of documents and
their words, until one becomes 0 or 1. Blocks of a source fly apart from each other; what each
leaves undecided, two documents at most, flies again in fewer blocks until a single block
is left for each source, whose last two documents land.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, fresh_name, located, stage_table
from tickloom.plans import attach

# Fixed values of the mix: weights of the sources in order, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# Most documents of a source that one task flies, some 60 bytes each.
ROWS_PER_BLOCK = 2_000
SEED = 20261
ALMOST = 1e-9


def n_words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """The target of each source from a table (source, source_size), one row a source.

    Targets share the total by weight and stop at ``MOST_COPIES`` times the size; the excess goes to the others by
    weight. So a target is the smaller of its cap and a common level times its weight, and the level
    is where caps, taken in order of cap over weight, leave the rest of the total.
    """
    # These windows hold one row a source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    caps = sizes.withColumn("_weight", weight.cast("double")).withColumn("_cap", MOST_COPIES * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    # Levels rise as long as sources are capped and fall from the first that its share does not fill:
    # the highest is the common one.
    found = caps.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    share = F.col("_level") * F.col("_weight")
    capped = share > F.col("_cap")
    return found.select("source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def fly(chance: np.ndarray, size: np.ndarray, land: bool) -> np.ndarray:
    """One flight over documents in the given order; 0 or 1 for those decided, else a chance between.

    Three undecided documents always have a direction that keeps both totals; a document at 0 or 1 leaves and the
    next one enters. With ``land`` the last two are decided too: the first by its chance, the other so that the
    number of documents comes out nearest.
    """
    rng = np.random.default_rng([SEED, len(chance), int(size.sum()) & 0x7FFFFFFF])
    draws = rng.random(2 * len(chance) + 8).tolist()
    out = chance.astype(float).copy()
    chances, sizes = chance.tolist(), size.tolist()
    pool: list[int] = []
    drawn = 0
    for i in range(len(chances)):
        if not ALMOST < chances[i] < 1 - ALMOST:
            out[i] = round(chances[i])
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(u):
                u = (1, -1, 0)
            up = down = float("inf")
            for k, step in zip(pool, u):
                if step > 0:
                    up, down = min(up, (1 - chances[k]) / step), min(down, chances[k] / step)
                elif step < 0:
                    up, down = min(up, -chances[k] / step), min(down, (chances[k] - 1) / step)
            move = up if draws[drawn] * (up + down) < down else -down
            drawn += 1
            left = []
            for k, step in zip(pool, u):
                chances[k] += move * step
                if ALMOST < chances[k] < 1 - ALMOST:
                    left.append(k)
                else:
                    out[k] = round(chances[k])
            pool = left
    if land and pool:
        total = sum(chances[k] for k in pool)
        first, *other = pool
        out[first] = float(draws[drawn] < chances[first])
        if other:
            rest = total - out[first]
            out[other[0]] = float(draws[drawn + 1] < min(1.0, max(0.0, rest)))
        pool = []
    for k in pool:
        out[k] = chances[k]
    return out


def _flight(rows: DataFrame, land: bool) -> DataFrame:
    """Fly each (source, block); ``rows`` has key, source, size, order, chance and block."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("size", "ascending"), ("key", "ascending")])
        flown = fly(table.column("chance").to_numpy(), table.column("size").to_numpy(), land)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(flown))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("source", "block").applyInArrow(group, kinds)


def sample(rows: DataFrame, most: int = ROWS_PER_BLOCK) -> DataFrame:
    """Decide an extra copy for each row: columns ``key`` and ``extra`` (0 or 1).

    ``rows`` has ``key`` (unique), ``source``, ``size``, ``order`` (a hash of the content) and ``chance``, the same for
    all rows of a source. Groups with more than ``most`` rows are dealt into blocks by their order and key.
    """
    rows = stage_table(rows, "chances")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    decided: list[DataFrame] = []
    left = attach(rows, counts, ["source"], null_safe=True)
    largest = counts.agg(F.max("_n")).first()[0] or 0
    while True:
        last = largest <= most
        blocks = F.ceil(F.col("_n") / most)
        flown = _flight(left.withColumn("block", F.pmod(F.xxhash64("order", "key", F.lit(len(decided))), blocks).cast("int")), last)
        flown = stage_table(flown, "flight")
        decided.append(flown.filter("chance IN (0, 1)").select("key", F.col("chance").cast("int").alias("extra")))
        if last:
            break
        # Each block leaves two rows at most, so the counts need no new pass.
        largest = 2 * -(-largest // most)
        left = flown.filter("chance NOT IN (0, 1)").withColumn("_n", 2 * blocks).drop("block")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, keys: list[str], copies: str = "copies") -> DataFrame:
    """The columns ``keys`` and how often each row is taken; without the text among them also size, source_size and target.

    Rows are told apart by file and row number, so equal rows and equal document ids are all decided one by one, and a
    rerun task gives the same rows. Null sources are one source,
    the last. A source without words has target 0 and no copies. An empty table gives an empty table.
    """
    internal = [f"_k{i}" for i in range(len(keys))]
    rows = located(docs).select(
        *[F.col(k).alias(i) for k, i in zip(keys, internal)],
        F.struct("__file", "__row").alias("key"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "source", "text").alias("order"),
    )
    narrow = stage_table(rows.select("key", "source", "size", "order", *[i for k, i in zip(keys, internal) if k != "text"]), "sizes")
    wanted = stage_table(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rated = attach(narrow, wanted, ["source"], null_safe=True).withColumn("_whole", F.floor(rate + ALMOST))
    extra = sample(rated.select("key", "source", "size", "order", F.greatest(rate - F.col("_whole"), F.lit(0.0)).alias("chance")))
    number = (F.col("_whole") + F.col("extra")).cast("long").alias(copies)
    out = [F.col(i).alias(k) for k, i in zip(keys, internal)]
    if "text" not in keys:
        return rated.join(extra, "key").select(*out, "size", "source_size", "target", number)
    # Texts are read again from the documents, beside the narrow decisions.
    decided = rated.join(extra, "key").select("key", "_whole", "extra")
    return rows.select("key", *internal).join(decided, "key").select(*out, number)


def take(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, each row as often as the mix takes it."""
    copies = fresh_name(docs, "copies")
    mixed = mix(docs, docs.columns, copies).filter(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return mixed.select(*docs.columns, each.alias(copies)).drop(copies)
