"""A stored word index: postings by term and block of records, and exact top-k by max-score pruning.

Records are numbered from the longest to the shortest and dealt to blocks, so that high counts of a term crowd in few blocks;
blocks are dealt in turn to a fixed number of parts. A question first gets a threshold that k records are known to reach, from the
counts of its terms and from the block of the longest records. It then meets the postings of the parts whose maxima can reach it.
In a part the postings of blocks, of runs of records and at last of single records are looked at only while their maxima reach
the best so far. So nothing is shuffled by question and block or record: questions go to a fixed number of parts, postings go
there once, and at most k hits of a question come back from each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grantlake.functions.text import tokens
from grantlake.operators.rank import DEFAULT_TOP_K, candidate_schema, check_k, top_per_question, with_ord
from grantlake.operators.retrieve import AskedTerms, _keyword_scorer, term_frequencies
from grantlake.session import bound_batches, new_folder, stored

# Records of one block.
BLOCK_RECORDS = 1024
# Highest counts kept of each term; a ranking of more than so many records prunes by scored blocks alone.
KEPT_COUNTS = 32
# Parts the blocks are dealt to. Every question may travel to all of them, so their number does not follow the input.
PARTS = 48
# Groups of questions that are compared with the block of the longest records.
FIRST_GROUPS = 8
# Cells the asked terms are hashed to; terms of other cells are asked by no question and are not shuffled.
TERM_CELLS = 1 << 20
# Question terms a task holds at once; more questions meet the postings in several groups.
MAX_ASKED_TERMS = 8_000_000

POSTINGS = "term string, block long, max_tf long, slots array<int>, counts array<int>"


class KeywordIndex:
    """The tables of an index in one folder: `records`, `postings`, `terms`. They are never changed once written."""

    def __init__(self, spark: SparkSession, folder: str, block_records: int = BLOCK_RECORDS) -> None:
        self.block_records = block_records
        self.records, self.postings, self.terms = (spark.read.parquet(f"{folder}/{name}") for name in ("records", "postings", "terms"))

    @classmethod
    def build(cls, records: DataFrame, folder: str | None = None, block_records: int = BLOCK_RECORDS) -> KeywordIndex:
        """Index `records(record_id, [ord,] text)`. A null text has no words; records may share keys."""
        spark = records.sparkSession
        folder = folder or new_folder(spark, "index")
        texts = with_ord(records).select("record_id", F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
        sized = texts.withColumn("length", F.length("text"))
        ordered = sized.repartitionByRange(F.desc("length"), F.xxhash64("record_id", "ord"))
        numbered = ordered.sortWithinPartitions(F.desc("length")).withColumn("record", F.monotonically_increasing_id())
        # Written once, because numbers given in a partition must not be given anew by a repeated task.
        forward = stored(numbered.drop("length"), f"{folder}/texts")
        # `tie` orders records as `ord` and `record_id` do.
        tie = F.monotonically_increasing_id().alias("tie")
        stored(forward.select("record", "record_id", "ord").orderBy("ord", "record_id").select("*", tie), f"{folder}/records")
        worded = bound_batches(forward.select("record", "text")).select("record", tokens(F.col("text")).alias("words"))
        postings = stored(worded.mapInArrow(_block_postings(block_records), POSTINGS), f"{folder}/postings")
        # Both groupings below are by term, in one shuffle. A maximum and its part make one number.
        highest = F.slice(F.sort_array("counts", False), 1, KEPT_COUNTS).alias("tops")
        by_block = postings.select("term", _part().alias("part"), "max_tf", highest).repartition("term")
        tops = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, KEPT_COUNTS)
        by_part = by_block.groupBy("term", "part").agg(F.max("max_tf").alias("high"), tops.alias("tops"))
        terms = by_part.groupBy("term").agg(tops.alias("tops"), F.collect_list(F.col("high") * PARTS + F.col("part")).alias("highs"))
        stored(terms, f"{folder}/terms")
        return cls(spark, folder, block_records)

    def topk(self, questions: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
        """Hits as of `keyword_topk`, for `questions(question_id, question)`: the same rows, by the stored postings."""
        check_k(k)
        asked = stored(term_frequencies(questions.where(F.col("question_id").isNotNull()), "question_id", "question"))
        cells = asked.select(_cell()).distinct()
        weights = stored(self._weights(asked, k, cells))
        words = F.array_join(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))), " ").alias("words")
        worded = stored(weights.groupBy("question_id", "n_terms").agg(words, F.count(F.lit(1)).alias("n_known")))
        floors = self._first_floors(worded, k, cells)
        bounds = self._bounds(weights).join(floors, "question_id", "left").withColumn("least", F.greatest("threshold", F.coalesce("floor", F.lit(0.0))))
        able = bounds.where(F.col("bound") >= F.col("least")).join(worded, "question_id")
        n_groups = max(1, -(-(worded.agg(F.sum("n_known")).first()[0] or 0) // MAX_ASKED_TERMS))
        group = F.pmod(F.xxhash64("question_id"), F.lit(n_groups)).cast("int").alias("group")
        sent = able.select("part", group, "question_id", "words", "n_terms", "least")
        found = _met(sent, self._entries(n_groups, cells), ["part", "group"], _part_scorer(k, self.block_records), candidate_schema(questions))
        hits = top_per_question(found, k).withColumn("record", F.col("record_id").cast("long")).drop("record_id", "ord")
        return hits.join(self.records, "record").select("question_id", "rank", "record_id", "ord", "score")

    def _weights(self, asked: DataFrame, k: int, cells: DataFrame | None = None) -> DataFrame:
        """Question terms that the index has, with the question's threshold and whether a term may open parts.

        k records have the k-th highest count of a term, so the question's k-th best overlap is not below its weight. The
        terms with the smallest bounds, which do not reach the threshold even together, open nothing.
        """
        bound = F.col("tf") * F.col("tops")[0].cast("long")
        kth = F.coalesce(F.try_element_at("tops", F.lit(k)), F.lit(0)) if 0 < k <= KEPT_COUNTS else F.lit(0)
        own = Window.partitionBy("question_id")
        rising = own.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Words that the index lacks count as words of the question.
        terms = self.terms if cells is None else _of_cells(self.terms, cells)
        known = asked.join(terms, "term", "left").select("question_id", "term", "tf", "highs", bound.alias("bound"), (F.col("tf") * kth).alias("kth"))
        limited = known.withColumns({"n_terms": F.count(F.lit(1)).over(own), "threshold": F.max("kth").over(own), "together": F.sum("bound").over(rising)})
        found = limited.where(F.col("highs").isNotNull())
        return found.select("question_id", "n_terms", "term", "tf", "highs", "threshold", (F.col("together") >= F.col("threshold")).alias("opens"))

    def _bounds(self, weights: DataFrame) -> DataFrame:
        """Parts that can hold a winner of a question, with the most a record of the part can reach."""
        maxima = weights.select("question_id", "threshold", "opens", "tf", F.explode("highs").alias("high")).withColumn("part", F.expr(f"int(high % {PARTS})"))
        bound = F.sum(F.col("tf") * F.expr(f"high div {PARTS}")).alias("bound")
        by_part = maxima.groupBy("question_id", "part").agg(bound, F.bool_or("opens").alias("opens"), F.max("threshold").alias("threshold"))
        return by_part.where(F.col("opens") & (F.col("bound") >= F.col("threshold"))).drop("opens")

    def _first_floors(self, worded: DataFrame, k: int, cells: DataFrame) -> DataFrame:
        """Per question the k-th best overlap in the block of the longest records, which k records are known to reach."""
        first = self.postings.agg(F.min("block")).first()[0]
        block = _of_cells(self.postings.where(F.col("block") == F.lit(first)), cells).select("term", "block", "slots", "counts")
        groups = F.explode(F.sequence(F.lit(0), F.lit(FIRST_GROUPS - 1))).alias("group")
        group = F.pmod(F.xxhash64("question_id"), F.lit(FIRST_GROUPS)).cast("int").alias("group")
        asked = worded.select(group, "question_id", "words", "n_terms")
        schema = T.StructType([worded.schema["question_id"], T.StructField("floor", T.DoubleType())])
        return _met(asked, block.select(groups, "*"), ["group"], _floor_scorer(k, self.block_records), schema)

    def _entries(self, n_groups: int, cells: DataFrame) -> DataFrame:
        """Postings of all blocks with terms that may be asked, and for each record a row without a term, which holds its `tie`; once for each group of questions."""
        block = F.expr(f"record div {self.block_records}")
        slot = (F.col("record") - block * self.block_records).cast("int")
        none = F.lit(None)
        postings = _of_cells(self.postings, cells).select("block", "term", "slots", "counts", none.cast("long").alias("tie"))
        ties = self.records.select(block.alias("block"), none.cast("string").alias("term"), F.array(slot).alias("slots"), none.cast("array<int>").alias("counts"), "tie")
        both = postings.unionByName(ties)
        return both.select(_part().alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), "*")


def _part() -> Column:
    return F.pmod("block", F.lit(PARTS)).cast("int")


def _cell() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(TERM_CELLS)).alias("cell")


def _of_cells(terms: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows whose term may be asked: none that is asked is lost. At most `TERM_CELLS` numbers travel to every task."""
    return terms.join(F.broadcast(cells), _cell() == cells["cell"], "left_semi")


def _met(questions: DataFrame, entries: DataFrame, keys: list[str], scorer, schema: T.StructType) -> DataFrame:
    return questions.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(scorer, schema)


def _block_postings(block_records: int):
    """Records with their words in, a row for each term of a block out; a block that lies in two batches gives two rows of a term."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, record = batch.column("words"), batch.column("record").to_numpy()
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            n_docs, n_terms = len(words), len(coded.dictionary)
            blocks, block = np.unique(record // block_records, return_inverse=True)
            doc = np.repeat(np.arange(n_docs), pc.list_value_length(words).to_numpy())
            entry, count = np.unique((block[doc] * n_terms + coded.indices.to_numpy()) * n_docs + doc, return_counts=True)
            row, doc = entry // n_docs, entry % n_docs
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            offsets = pa.array(np.r_[first, len(row)].astype(np.int32))
            slots = pa.ListArray.from_arrays(offsets, pa.array((record % block_records)[doc].astype(np.int32)))
            counts = pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))
            columns = [coded.dictionary.take(pa.array(row[first] % n_terms)), pa.array(blocks[row[first] // n_terms]), pa.array(np.maximum.reduceat(count, first)), slots, counts]
            yield pa.RecordBatch.from_arrays(columns, ["term", "block", "max_tf", "slots", "counts"])

    return build


def _asked(questions: pa.Table) -> AskedTerms:
    """The words of questions that come as a row each, in the order of the rows."""
    ids = questions["question_id"].combine_chunks()
    words = pc.split_pattern(questions["words"].combine_chunks(), " ")
    coded = words.flatten().dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    pair, tf = np.unique(pc.list_parent_indices(words).to_numpy() * n_terms + coded.indices.to_numpy(), return_counts=True)
    terms = {"question_id": ids.take(pa.array(pair // n_terms)), "term": coded.dictionary.take(pa.array(pair % n_terms)), "tf": pa.array(tf)}
    asked = AskedTerms(pa.table(terms))
    asked.distinct = questions["n_terms"].to_numpy()
    return asked


def _counted(asked: AskedTerms, entries: pa.Table, block_records: int, ties: bool) -> Iterator[tuple]:
    """The records of each block with the counts of words that are asked for, from the longest records on."""
    entries = entries.combine_chunks()
    entries = entries.take(pa.array(np.argsort(entries["block"].to_numpy(), kind="stable")))
    block = entries["block"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
    for start, end in zip(cuts[:-1], cuts[1:]):
        of_block = entries.slice(start, end - start).combine_chunks()
        rows = of_block.filter(pc.is_valid(of_block["term"])).combine_chunks()
        term = pc.index_in(rows["term"], value_set=asked.vocabulary)
        rows, term = rows.filter(pc.is_valid(term)), term.drop_null().to_numpy().astype(np.int32)
        size = pc.list_value_length(rows["slots"]).to_numpy()
        slot, count = (pc.list_flatten(rows[name]).to_numpy() for name in ("slots", "counts"))
        if ties:
            named = of_block.filter(pc.is_null(of_block["term"]))
            slots, tie = pc.list_flatten(named["slots"]).to_numpy(), named["tie"].to_numpy()
            order = np.argsort(slots)
            slots, tie = slots[order], tie[order]
        else:
            slots = np.unique(slot)
            tie = np.zeros(len(slots), np.int64)
        ids = pa.array(block[start] * block_records + slots.astype(np.int64)).cast(pa.string())
        yield ids, tie, np.searchsorted(slots, slot), np.repeat(term, size), count.astype(np.int64)


def _part_scorer(k: int, block_records: int):
    """A task of the ranking: the questions of a group that a part may serve, against its postings."""

    def score(questions: pa.Table, entries: pa.Table) -> pa.Table:
        asked = _asked(questions)
        scorer = _keyword_scorer(asked, k, least=questions["least"].to_numpy(), counted=True)
        found = list(scorer(_counted(asked, entries, block_records, True)))
        names = ["question_id", "record_id", "ord", "score"]
        types = [asked.ids.type, pa.string(), pa.int64(), pa.float64()]
        return pa.Table.from_batches(found, pa.schema(list(zip(names, types))))

    return score


def _floor_scorer(k: int, block_records: int):
    def score(questions: pa.Table, entries: pa.Table) -> pa.Table:
        asked = _asked(questions)
        scorer = _keyword_scorer(asked, k, floors=True, counted=True)
        (floors,) = scorer(_counted(asked, entries, block_records, False))
        return pa.table({"question_id": asked.ids.take(floors["question"]), "floor": floors["overlap"]})

    return score


def keyword_index_topk(questions: DataFrame, records: DataFrame, k: int = DEFAULT_TOP_K, folder: str | None = None) -> DataFrame:
    """Build the index of `records` and rank `questions` by it."""
    return KeywordIndex.build(records, folder).topk(questions, k)
