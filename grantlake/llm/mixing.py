"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import WORD, broadcast_if_small, cut, running_totals, unused

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
PASSES = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """The place of a document in its source's shuffled order."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))


def text_mark(text: Column) -> Column:
    """Tells rows of one source and doc_id apart, null ids among them."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def document_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"),
        text_mark(F.col("text")).alias("mark"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, int]:
    """`source, source_size, rank, start, weight, target` and the size of everything.

    Sources take the weights in turn, by code point, null last. Together they share 1.5 times all words; a target
    stops at `PASSES` times its source, and what is above goes to the others by weight. That is one water level:
    in the order of (limit / weight), the first source that the level does not fill settles it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_totals(
        by_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1), "start": F.col("source_size")}
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = PASSES * F.col("source_size")
    weighed = cut(placed.withColumns({"weight": weight.cast("long"), "limit": limit}))
    total, weight_sum = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    ratio = F.col("limit") / F.col("weight")
    levels = running_totals(
        weighed.withColumn("ratio", ratio),
        [F.col("ratio"), F.col("rank")],
        {"filled": F.col("limit"), "filled_weight": F.col("weight")},
    )
    level = (3 * total - 2 * F.col("filled")) / (2 * (weight_sum - F.col("filled_weight")))
    settled = levels.withColumn("level", level).where(F.col("level") <= F.col("ratio"))
    found = settled.agg(F.min_by("level", F.struct("ratio", "rank")).alias("level")).first()
    target = F.least(F.col("limit").cast("double"), F.lit(found["level"] or 0.0) * F.col("weight"))
    return weighed.withColumn("target", target).drop("limit"), total


def ordered_documents(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Every document that has words, with its source's columns and `before`, the words of its source before it.

    Rows equal in source, doc_id and text follow each other in any order, each with a place of its own.
    """
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("mark")]
    ordered = running_totals(sizes.where("size > 0"), order, {"words_before": F.col("size")})
    known = broadcast_if_small(sources.withColumnRenamed("source", "_source"), n_sources)
    placed = ordered.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return cut(placed.withColumn("before", F.col("words_before") - F.col("start")).drop("words_before", "start"))


def queue(ordered: DataFrame) -> DataFrame:
    """Every document's passes in global order: virtual `finish` time and words `queued` before it.

    A pass of a document finishes at its source's words so far, divided by the weight. Empty documents do not queue.
    """
    passes = ordered.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(PASSES)])))
    words = F.col("before") + F.col("size") + F.col("pass") * F.col("source_size")
    finished = passes.withColumn("finish", words / F.col("weight"))
    return running_totals(finished, [F.col(c) for c in ("finish", "rank", "pass", "before")], {"queued": F.col("size")})


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, int]:
    """One row per source: size, target, and `last`, the last queue entry of it before the budget ends; the ordered
    documents; and the number of sources.

    Within a source the queue runs by pass, then by the documents' order, so the truncated queue is a prefix of each source.
    """
    sources, total = source_targets(sizes, weights)
    n_sources = sources.count()
    ordered = ordered_documents(sizes, sources, n_sources)
    within = queue(ordered).where(2 * (F.col("queued") + F.col("size")) <= 3 * total)
    entry = F.struct("pass", "before", "key", "doc_id", "mark")
    last = within.groupBy(F.col("source").alias("_source")).agg(F.max(entry).alias("last"))
    plan = sources.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
    return cut(plan.select("source", "source_size", "weight", "target", "last")), ordered, n_sources


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`doc_id, source, size, source_size, target, copies` for every row of `sizes` (see `document_sizes`).

    Null or blank texts have size 0 and are never taken. Every row is taken for itself: rows that share a doc_id, null ids
    too, are told apart by their text, and rows equal in that as well are taken one after the other. Without any words
    all targets are 0. Null doc_ids share one key.
    """
    plan, ordered, n_sources = mixing_plan(sizes, weights)
    known = broadcast_if_small(plan.select(F.col("source").alias("_source"), "source_size", "target", "last"), n_sources)
    rows = ordered.select("doc_id", "source", "size", "before").unionByName(
        sizes.where("size = 0").select("doc_id", "source", "size", F.lit(None).cast("long").alias("before"))
    )
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("last.pass").cast("int") + F.when(F.col("before") <= F.col("last.before"), 1).otherwise(0)
    n_copies = F.when((F.col("size") > 0) & F.col("last").isNotNull(), taken).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", n_copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The documents of the mix with all their columns; one taken twice is there twice. Texts are not shuffled.

    Where the last entry of a source is one of several equal rows, as many of those are taken as come up to it.
    """
    plan, ordered, n_sources = mixing_plan(cut(document_sizes(docs, seed)), weights)
    # How many rows that equal the last one are reached: their places up to it.
    known = broadcast_if_small(plan.select(F.col("source").alias("_source"), "last"), n_sources)
    same = ordered.join(known, F.col("source").eqNullSafe(F.col("_source")))
    equal = F.col("key").eqNullSafe(F.col("last.key")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("mark") == F.col("last.mark"))
    reached = same.where(equal & (F.col("before") <= F.col("last.before"))).groupBy(F.col("source").alias("_reached")).agg(F.count("*").alias("n"))
    ends = cut(plan.join(reached, F.col("source").eqNullSafe(F.col("_reached")), "left").select("source", "last", "n"))
    own = {name: unused(docs, name) for name in ("mix_source", "mix_last", "mix_n", "mix_copies", "mix_row", "mix_place")}
    source, last, n, copies, row, place = own.values()
    ends = ends.select(F.col("source").alias(source), F.col("last").alias(last), F.col("n").alias(n))
    joined = docs.join(broadcast_if_small(ends, n_sources), docs["source"].eqNullSafe(F.col(source)))
    here = F.struct(shuffle_key(docs["doc_id"], seed).alias("key"), docs["doc_id"].alias("doc_id"), text_mark(docs["text"]).alias("mark"))
    end = F.struct(F.col(last)["key"].alias("key"), F.col(last)["doc_id"].alias("doc_id"), F.col(last)["mark"].alias("mark"))
    some = (word_count(docs["text"]) > 0) & F.col(last).isNotNull()
    whole = joined.withColumn(copies, F.when(some, F.col(last)["pass"].cast("int")).otherwise(0)).withColumn(row, F.when(some, here.eqNullSafe(end)))
    before = whole.where(~F.coalesce(F.col(row), F.lit(False))).withColumn(copies, F.col(copies) + F.when(some & (here < end), 1).otherwise(0))
    at_end = cut(whole.where(F.col(row)).withColumn(place, F.monotonically_increasing_id()))
    numbered = running_totals(at_end, [F.col(source).asc_nulls_last(), F.col(place)], {unused(docs, "mix_total"): F.lit(1)})
    total = numbered.columns[-1]
    by_source = numbered.groupBy(F.col(source).alias("_first")).agg(F.min(total).alias("_start"))
    counted = numbered.join(broadcast_if_small(by_source, n_sources), F.col(source).eqNullSafe(F.col("_first")))
    ending = counted.withColumn(copies, F.col(copies) + F.when(F.col(total) - F.col("_start") < F.col(n), 1).otherwise(0))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return before.select(*columns, copies).unionByName(ending.select(*columns, copies)).select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(row)).drop(row)
