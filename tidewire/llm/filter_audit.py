"""Filter interaction audit by Walsh-Hadamard sums.

Five filters judge every whole text; the filters that a document fails are a
mask of five bits.  For each part and each label (all documents, good ones,
toxic ones) the 32 signed sums

    S(s) = sum over documents of (-1) ** popcount(mask AND s)

are aggregated, which any number of tasks can do apart and add up.  The
transform is its own inverse but for a factor of 32, so the counts of all 32
masks follow exactly in whole numbers.  Every order of the filters, and the
Shapley value of a filter, are sums over these 32 cells: a document that fails k
filters is removed by a given one of them in ``120 / k`` of the 120 orders.

Copies of a text fail the same of the filters A to D and differ in E only, so
documents meet by the SHA-256 of their text as counts per part: a group of
copies, however large, leaves a task as one row.

Defined cases: a null text is empty (no words: fails A only); a null lang is the
part ``''``; whole repeats of a row count as often as they stand, and none makes
another fail E, since their ids are equal; a row with a null doc_id never fails E,
makes none fail it, and has no label; an id with several labels is good (toxic)
if any of them says so; other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words; distinct words and capitals in hundredths
SYMBOLS = r"[#$%&*|]"
LABELS = ("every", "good", "toxic")


def failed(text: Column, words: Column) -> Column:
    """Mask of the filters A to D that a text fails; bit i is the filter of letter i."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    tests = (
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * LEAST_DISTINCT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        text.rlike(SYMBOLS),
    )
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def _sign(both: Column) -> Column:
    """-1 where an odd number of bits are set, else 1."""
    return 1 - 2 * (F.bit_count(both) % 2)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, every, good, toxic): numbers of documents; several rows may share a part and mask."""
    text = F.coalesce("text", F.lit(""))
    digests = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
        .withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .select("doc_id", "part", F.sha2("text", 256).alias("key"), failed(F.col("text"), F.col("words")).alias("mask"))
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    rows = digests.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    counts = [F.col("n").alias("every"), *((F.coalesce(name, F.lit(0)) * F.col("n")).alias(name) for name in LABELS[1:])]
    rows = rows.select("doc_id", "part", "key", "mask", F.struct(*counts).alias("c"))
    # Per text and part: all documents, those without an id, and those of the smallest id.
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy("key", "part", "mask").agg(
        F.min("doc_id").alias("least"),
        F.min_by("c", "doc_id").alias("first"),
        *(F.sum(f"c.{x}").alias(x) for x in LABELS),
        *(F.coalesce(F.sum(F.when(~known, F.col(f"c.{x}"))), F.lit(0)).alias(f"{x}_unnamed") for x in LABELS),
    )
    leads = F.coalesce(F.col("least") == F.min("least").over(Window.partitionBy("key")), F.lit(False))
    groups = groups.withColumn("leads", leads)
    fresh = [(F.col(f"{x}_unnamed") + F.when(F.col("leads"), F.col(f"first.{x}")).otherwise(0)).alias(x) for x in LABELS]
    parts = groups.select("part", "mask", F.array(F.struct(F.lit(0).alias("e"), *fresh), F.struct(F.lit(1 << FILTERS.index("E")).alias("e"), *((F.col(x) - y).alias(x) for x, y in zip(LABELS, fresh, strict=True)))).alias("two"))
    return parts.select("part", "mask", F.explode("two").alias("x")).select("part", (F.col("mask") + F.col("x.e")).alias("mask"), *(f"x.{c}" for c in LABELS))


def cells(counts: DataFrame) -> DataFrame:
    """(part, every, good, toxic): for each label the array of exact counts by mask, through the 32 signed sums."""
    each = counts.select("part", "mask", F.explode(F.create_map(*(x for name in LABELS for x in (F.lit(name), F.col(name))))).alias("label", "n"))
    sums = each.groupBy("part", "label").agg(F.array(*(F.sum(F.col("n") * _sign(F.col("mask").bitwiseAND(F.lit(s)))) for s in range(MASKS))).alias("sums"))

    def cell(m: Column) -> Column:
        signed = F.transform("sums", lambda v, s: v * _sign(s.bitwiseAND(m)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b), MASKS.bit_length() - 1)

    exact = sums.select("part", F.struct("label", F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), cell).alias("counts")).alias("x"))
    by_label = exact.groupBy("part").agg(F.map_from_entries(F.collect_list("x")).alias("x"))
    return by_label.select("part", *(F.col("x")[name].alias(name) for name in LABELS))


def _sum_where(name: str, test) -> Column:
    """Sum of a label's cells whose mask passes ``test``."""
    picked = F.transform(F.col(name), lambda v, m: F.when(test(m), v).otherwise(F.lit(0)))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    steps = cells(masks(docs, labels)).select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    powers = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - ord("A")).cast("int"))
    steps = steps.withColumn("powers", powers).withColumn("bit", F.element_at("powers", F.col("step")))
    steps = steps.withColumn("before", F.aggregate(F.slice("powers", 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    bit, before = F.col("bit"), F.col("before")

    def has(m: Column, bits: Column) -> Column:
        return m.bitwiseAND(bits) != 0

    def here(m: Column) -> Column:
        return has(m, bit) & ~has(m, before)

    share = F.transform(F.col("every"), lambda v, m: F.when(has(m, bit), v * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        _sum_where("every", lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"),
        _sum_where("every", here).alias("removed"),
        _sum_where("every", lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        F.element_at("every", bit + 1).alias("unique_fails"),
        _sum_where("good", here).alias("good_lost"),
        _sum_where("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )
