"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key, the MD5 of a seed, its id and its text.  The
key's leading bits deal a source into slots, equal ranges of the key, so that a
large source is many slots and no slot needs a sample of the keys.  A running
sum inside each slot and one over the totals of the slots give every document
the words before it in its source's order.  A source's budget takes whole
epochs of the source and, of the last epoch, the words up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.tables import texts, unused
from larder.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLOT_ROWS = 100_000  # rows aimed at in one slot
KEY_BITS = 60


def budgets(totals: DataFrame, share: float, epochs: int, weights=WEIGHTS) -> DataFrame:
    """``target`` of every source; ``totals`` has one row ``source, source_size`` each.

    Sources in ascending order, null last, weigh ``weights``, repeated.  Targets
    share ``share`` of all words by weight and stop at ``epochs`` times the
    source's words; what is over is shared again by weight.  The result of that
    is one level: sources sorted by words per weight are full up to a place, and
    from there the words left are shared by the weight left.  The windows run
    over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"),
                             F.col("source").asc_nulls_last())
    rows = by_room.rowsBetween
    every = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    spare = F.col("budget") - F.coalesce(F.col("full"), F.lit(0))
    fits = F.col("cap") * F.col("left") <= F.col("weight") * spare
    level = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        totals.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.sum("cap").over(rows(Window.unboundedPreceding, -1)))
        .withColumn("left", F.sum("weight").over(rows(0, Window.unboundedFollowing)))
        .withColumn("fits", fits)
        .withColumn("spare", F.min(
            F.when(~F.col("fits"), F.struct(-F.col("left"), spare))).over(level))
        .withColumn("target", F.when(F.col("fits"), F.col("cap").cast("double")).otherwise(
            F.col("weight") * F.col("spare.col2") / -F.col("spare.col1")))
        .select("source", "source_size", "target"))


def row_mark(seed: int, doc_id: Column, text: Column) -> Column:
    """The MD5 of seed, id and text; rows alike in both share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")),
                             F.coalesce(text, F.lit(""))))


def random_key(mark: Column) -> Column:
    """The first 60 bits of ``mark``."""
    return F.conv(F.substring(mark, 1, KEY_BITS // 4), 16, 10).cast("long")


def slot_bits(rows: int, slot_rows: int = SLOT_ROWS) -> int:
    """Leading bits of the key that cut ``rows`` into slots of ``slot_rows``."""
    return min(24, max(0, (max(rows, 1) - 1) // slot_rows).bit_length())


def plan_mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, weights=WEIGHTS,
             seed: int = 0, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs``: doc_id, text, source.  Returns one row per row of ``docs``:
    doc_id, source, mark (the MD5 whose first bits are the key), size (words; null or
    empty text: 0), source_size, target and taken.  A source's taken words add up to its target
    without the fraction of a word, and no document gives more than ``epochs``
    times its words.

    Null sources are one source.  A null id or text counts as empty in the key.
    Rows alike in id and text share a key and follow one another; repeated rows
    each count.  Of an empty table the result is empty.  The order depends on
    the rows only, so reruns agree.
    """
    rows = materialise(
        texts(docs, "source").select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_mark(seed, F.col("doc_id"), F.col("text")).alias("mark")), "mix-rows")
    rows = rows.withColumn("draw", random_key(F.col("mark")))
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = slot_bits(largest, slot_rows)
    rows = rows.withColumn("slot", F.shiftright("draw", KEY_BITS - bits))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("source").alias("of"), F.col("slot").alias("at"),
        F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("slot_before"))
    shares = budgets(totals, share, epochs, weights)
    slots = slots.join(shares, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "slot").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(
        slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = budget - whole * F.col("source_size")
    start = F.col("slot_before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - start))
    return placed.select("doc_id", "source", "mark", "size", "source_size", "target",
                         (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, weights=WEIGHTS,
        seed: int = 0, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document comes once for each epoch that takes words of it.  The one that a
    budget cuts comes with its first words in that epoch, joined by one space
    and with the right n_chars where ``docs`` has that column; the others come
    as they are.  Documents without words are not taken.  Rows alike in id and text
    come as copies of one of them, as often as all of them are taken.  All columns are
    kept, whatever their names.
    """
    columns = docs.columns
    mark, size, taken, epoch = (unused(docs, c) for c in ("_mark", "_size", "_taken", "_epoch"))
    plan = plan_mix(docs, share, epochs, weights, seed, slot_rows)
    plan = plan.where("taken > 0").groupBy(F.col("mark").alias(mark)).agg(
        F.first("size").alias(size), F.sum("taken").alias(taken))
    one_each = docs.withColumn(mark, row_mark(seed, docs["doc_id"], docs["text"])
                               ).dropDuplicates([mark])
    joined = one_each.join(plan, mark)
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int")))
    words = F.least(F.col(size), F.col(taken) - (F.col(epoch) - 1) * F.col(size))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1),
                               words.cast("int")), " ")
    out = joined.withColumn(epoch, times).withColumn(
        "text", F.when(words < F.col(size), cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
