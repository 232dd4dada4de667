"""Mix sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, scaled by its quality weight (Efraimidis and
Spirakis): the smaller the key, the earlier the document is taken. Within a source the keys are
sorted and the sizes summed up to the source's token budget. Budgets above the size of a source
take whole epochs first; only what is left is selected by key.

The sum up to the budget needs no sort of a whole source: sizes are summed per key range, the
range that holds the budget's end is found from these sums, and only its documents are sorted.
Each source ends with one row: its epochs and the key at which the selection stops. A document's
share follows from its own key and that row, so texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseline.llm.common import WORDS, stored, whole_row


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: str, size: Column) -> Column:
    """Share of letter runs of two and more among the words, within 0.1 and 1."""
    runs = F.coalesce(F.regexp_count(F.col(text), F.lit(r"\p{L}{2,}")), F.lit(0))
    share = F.least(F.lit(1.0), runs / F.greatest(size, F.lit(1)))
    return F.greatest(F.lit(0.1), share)


def sample_key(key: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the md5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(2**52)) / weight


def source_targets(
    sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)
) -> DataFrame:
    """Targets of sources (source, source_size, docs): one row per source.

    Sources by code point, null last, get the weights in turn and share ``share`` times all sizes.
    A target stops at ``cap`` times the source's size and the excess goes to the others by
    weight until none is above: sources are ordered by the level at which they fill up, so the
    final level is found in one pass.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumns({"_w": weight, "_cap": F.col("source_size") * cap})
    by_fill = every.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    full = F.coalesce(
        F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
    )
    left = F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(every) * share
    rows = rows.withColumns(
        {"_level": (total - full) / left, "_at": F.row_number().over(by_fill)}
    )
    free = F.col("_cap") > F.col("_w") * F.col("_level")
    # The first source that does not fill up sets the level for all that follow.
    first = F.min(F.when(free, F.struct("_at", "_level"))).over(every)
    rows = rows.withColumn("_final", first["_level"])
    target = F.when(
        F.col("_final").isNotNull() & (F.col("_cap") > F.col("_w") * F.col("_final")),
        F.col("_w") * F.col("_final"),
    ).otherwise(F.col("_cap"))
    return rows.select("source", "source_size", "docs", target.alias("target"))


def keyed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None
) -> DataFrame:
    """doc_id, source, size and key of every row."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("_text"),
        word_count(text_col).alias("size"),
        (F.lit(None).cast("double") if weight is None else weight).alias("weight"),
    )
    own = quality_weight("_text", F.col("size")) if weight is None else _bounded(F.col("weight"))
    key = sample_key(F.col("doc_id"), own, seed)
    return sized.select("doc_id", "source", "size", key.alias("key"))


def _bounded(weight: Column) -> Column:
    """A given weight within 0.1 and 1; that of a missing one is 0.1."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(weight.cast("double"), F.lit(0.1))))


def source_cuts(rows: DataFrame, **shares) -> DataFrame:
    """One row per source of keyed rows: size, target, epochs and the end of the selection.

    ``cut_key`` is the key at which the rest of the budget ends, ``cut_left`` the words still
    to be taken there and ``cut_size`` the words of the rows with that key (repeated rows tie).
    """
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    targets = source_targets(sizes, **shares)
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest",
        F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"),
    )
    targets = stored(targets, "targets")
    # Rows of a key are one; keys are dealt into ranges of the source's own, whatever their distribution.
    keys = rows.groupBy("source", "key").agg(F.sum("size").alias("size"))
    placed = keys.repartitionByRange("source", "key").withColumn("range", F.spark_partition_id())
    placed = stored(placed, "ranges")
    up_to = W.partitionBy("source").orderBy("range")
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    last = (
        sums.alias("b")
        .join(targets.alias("t"), same)
        .filter("b.before < t.rest and t.rest <= b.before + b.words")
        .select("b.source", "b.range", "b.before", "t.rest")
    )
    same = F.col("p.source").eqNullSafe(F.col("l.source"))
    ties = (
        placed.alias("p")
        .join(last.alias("l"), same & (F.col("p.range") == F.col("l.range")))
        .select("p.source", "p.key", "l.before", "l.rest", F.col("p.size").alias("cut_size"))
    )
    up_to = W.partitionBy("source").orderBy("key")
    ties = ties.withColumn(
        "start", F.col("before") + F.sum("cut_size").over(up_to) - F.col("cut_size")
    ).filter("start < rest and rest <= start + cut_size")
    cuts = ties.select(
        F.col("source").alias("cut_source"),
        F.col("key").alias("cut_key"),
        (F.col("rest") - F.col("start")).alias("cut_left"),
        "cut_size",
    )
    return targets.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_left", "cut_size"
    )


def extra_words(size: Column, key: Column, prefix: str = "") -> Column:
    """Words of the last, partial epoch that a row gives, beside a row of ``source_cuts``."""
    cut_key, left, words = (F.col(f"{prefix}cut_{c}") for c in ("key", "left", "size"))
    return (
        F.when(cut_key.isNull(), 0)
        .when(key < cut_key, size)
        .when(key == cut_key, F.floor(size * left / words))
        .otherwise(0)
        .cast("long")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    weight: Column | None = None,
    **shares,
) -> DataFrame:
    """How much of every document the mix takes.

    Returns one row per input row: doc_id, source, size (words), source_size, target (of its
    source), epochs (whole copies) and taken (words, copies counted). Null and empty texts have
    size 0 and are never taken; a null source is a source of its own; rows that tie on the key
    (the same id repeated) share the end of the budget in proportion to their size; an empty
    table gives no rows. ``weight`` is a quality weight of the rows, such as a model's score; without one it is the
    share of letter runs among the words. Input columns other than the three named ones are ignored.
    """
    rows = stored(keyed(docs, id_col, text_col, source_col, seed, weight), "mixing")
    cuts = stored(source_cuts(rows, **shares), "cuts")
    same = F.col("r.source").eqNullSafe(F.col("c.source"))
    both = rows.alias("r").join(cuts.alias("c"), same)
    size, key = F.col("r.size"), F.col("r.key")
    taken = F.col("epochs") * size + extra_words(size, key)
    return both.select(
        "doc_id", "r.source", "size", "source_size", "target", "epochs", taken.alias("taken")
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    weight: Column | None = None,
    **shares,
) -> DataFrame:
    """The mix itself: the input's columns, whole copies repeated and the last one cut.

    A document at the end of its source's budget keeps its first words only, with the blanks before
    them. Other columns stay as they are, whatever their names; documents without words are not in the mix. Null sources, ids and
    repeated rows count as in ``mix``; an empty table gives no rows.
    """
    rows = stored(keyed(docs, id_col, text_col, source_col, seed, weight), "mixing")
    # One row per source, stored so that its real size decides the join and no text is shuffled.
    cuts = stored(source_cuts(rows, **shares), "cuts").withColumnRenamed("source", "cut_of")
    size = word_count(text_col)
    own = quality_weight(text_col, size) if weight is None else _bounded(weight)
    # The input's columns in one, so that no name can clash.
    given = docs.select(
        whole_row(docs),
        F.col(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        sample_key(F.col(id_col), own, seed).alias("key"),
    )
    rows = given.join(cuts, F.col("source").eqNullSafe(F.col("cut_of")))
    extra = extra_words(F.col("size"), F.col("key"))
    copies = F.array_repeat(F.col("size"), F.col("epochs").cast("int"))
    last = F.when(extra > 0, F.array(extra)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("words", F.explode(F.concat(copies, last))).filter(F.col("words") > 0)
    pieces = F.regexp_extract_all(
        F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)
    )
    cut = F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))
    return rows.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
