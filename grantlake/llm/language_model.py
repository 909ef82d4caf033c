"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, one per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantlake.llm.common import broadcast_if_small, cut, document_key, filed
from grantlake.session import bound_batches

# Tokens are UTF-8 bytes, A-Z in lower case, white space runs as one space; grams of up to ORDER bytes fill an integer.
ORDER = 5
PAD = b"\n" * (ORDER - 1)
ALPHABET = 256
# Text of one scoring block, and of one array pass over it.
BLOCK_BYTES, SLICE_BYTES = 16 * 1024 * 1024, 1024 * 1024
# A document is rejected above this quantile of its language's trusted documents, each scored by a model that was fitted
# on the other folds.
UPPER, FOLDS = 0.99, 2
# Log-perplexities are counted in steps of this, so that quantiles are exact sums of counts.
STEP = 0.002


def language() -> Column:
    return F.coalesce("lang", F.lit("")).alias("lang")


def normal_bytes(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def gram_keys(values: np.ndarray, order: int) -> np.ndarray:
    """The gram of `order` bytes that ends at each place from ORDER - 1 on, with the order in the top byte."""
    n = len(values) - ORDER + 1
    keys = np.zeros(n, np.int64)
    for i in range(ORDER - order, ORDER):
        keys = keys << 8 | values[i : i + n]
    return keys | order << 56


def padded(texts: list[bytes]) -> np.ndarray:
    """The texts in one array, each after a padding; places of different texts do not mix."""
    return np.frombuffer(b"".join(PAD + t for t in texts), np.uint8).astype(np.int64)


def own_places(texts: list[bytes]) -> np.ndarray:
    """Which grams of `padded` texts end in a text's own byte."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + len(PAD))
    own = np.ones(int(ends[-1]), bool)
    for start in ends - lengths - len(PAD):
        own[start : start + len(PAD)] = False
    return own[len(PAD) :]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + len(PAD)
        if size >= SLICE_BYTES:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest grams by language, over some megabytes of text at a time."""
    texts: dict[str, list[bytes]] = {}
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, own in texts.items():
            for _, part in _slices(own):
                keys, counts = np.unique(gram_keys(padded(part), ORDER)[own_places(part)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        texts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            if text and (normal := normal_bytes(text)):
                texts.setdefault(lang, []).append(normal)
                size += len(normal)
        if size >= 4 * SLICE_BYTES:
            yield from counted()
            size = 0
    yield from counted()


def _shorter(gram: Column, order: int) -> Column:
    """The gram without its first byte."""
    return gram.bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).bitwiseOR(F.lit(order - 1 << 56))


def _context(gram: Column, order: int) -> Column:
    """The gram without its last byte."""
    return F.shiftright(gram.bitwiseAND(F.lit((1 << 8 * order) - 1)), 8).bitwiseOR(F.lit(order - 1 << 56))


def _discounts(grams: DataFrame) -> DataFrame:
    """`lang, d1, d2, d3`: discounts of counts 1, 2 and more, from how many grams have counts 1 to 4."""
    ones = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def discount(i: int) -> Column:
        found = F.lit(float(i)) - (i + 1) * y * F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.0))
        return F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), found)).alias(f"d{i}")

    return grams.groupBy("lang").agg(*ones).select("lang", *[discount(i) for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """`lang, gram, logp, logb` for all grams of orders 0 to ORDER that occur, from the counts of the longest.

    logp is the log-probability of the gram's last byte after the others, logb the log-weight that is left for a shorter
    context where the gram is a context. Shorter grams count the different bytes before them. All counts stay sharded
    by gram or context; nothing is collected.
    """
    by_order = {ORDER: counts}
    for order in range(ORDER, 1, -1):
        longer = by_order[order]
        by_order[order - 1] = filed(longer.select("lang", _shorter(F.col("gram"), order).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    lower, tables = None, []
    for order in range(1, ORDER + 1):
        grams = by_order[order].join(F.broadcast(_discounts(by_order[order])), "lang")
        cut_off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = grams.select("lang", "gram", _context(F.col("gram"), order).alias("context"), "n", cut_off.alias("d"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        share = rows.join(contexts, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if lower is None:
            below = share.withColumn("p_lower", F.lit(1.0 / ALPHABET))
        else:
            suffix = share.withColumn("suffix", _shorter(F.col("gram"), order))
            below = suffix.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower")), ["lang", "suffix"])
        p = F.col("own") + F.col("left") / F.col("total") * F.col("p_lower")
        lower = filed(below.select("lang", "gram", p.alias("p")), "grams")
        tables.append((lower, contexts.select("lang", F.col("context").alias("gram"), F.log(F.col("left") / F.col("total")).alias("logb"))))
    found = tables[0][1].select("lang", "gram", F.lit(None).cast("double").alias("logp"), "logb")
    for order, (probabilities, _) in enumerate(tables, 1):
        logp = probabilities.select("lang", "gram", F.log("p").alias("logp"))
        own = logp.join(tables[order][1], ["lang", "gram"], "full") if order < ORDER else logp.withColumn("logb", F.lit(None).cast("double"))
        found = found.unionByName(own)
    return filed(found, "model")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic, by every label they have."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    ids = cut(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id"))
    return docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_semi")


def fit(trusted: DataFrame) -> DataFrame:
    rows = bound_batches(trusted.select(language(), "text")).mapInArrow(_count_grams, "lang string, gram long, n long")
    return kneser_ney(filed(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"))


def _texts(frame: pd.DataFrame) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in frame["packed"]]


def _requests(frame: pd.DataFrame) -> pd.DataFrame:
    """The distinct grams of all orders of one block."""
    found = np.empty(0, np.int64)
    for _, part in _slices(_texts(frame)):
        values = padded(part)
        found = np.union1d(found, gram_keys(values, ORDER)[own_places(part)])
    keys = [found]
    for order in range(ORDER - 1, 0, -1):
        # Suffixes are backed off to, prefixes are their contexts.
        above = keys[-1] & (1 << 8 * (order + 1)) - 1
        keys.append(np.unique(np.concatenate([above & (1 << 8 * order) - 1, above >> 8])) | order << 56)
    keys.append(np.zeros(1, np.int64))
    gram = np.concatenate(keys)
    return pd.DataFrame({"block": frame["block"].iloc[0], "lang": frame["lang"].iloc[0], "gram": gram})


def log_probabilities(values: np.ndarray, grams: np.ndarray, logp: np.ndarray, logb: np.ndarray) -> np.ndarray:
    """The log-probability of the byte at each place; `grams` are sorted, values absent from them are NaN."""
    result = np.zeros(len(values) - ORDER + 1)
    at = np.arange(len(result))
    for order in range(ORDER, 0, -1):
        keys = gram_keys(values, order)[at] if order == ORDER else (keys & (1 << 8 * order) - 1) | order << 56
        places = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        known = (grams[places] == keys) & ~np.isnan(logp[places])
        result[at[known]] += logp[places[known]]
        at, keys = at[~known], keys[~known]
        if not len(at):
            return result
        contexts = (keys & (1 << 8 * order) - 1) >> 8 | order - 1 << 56
        places = np.minimum(np.searchsorted(grams, contexts), len(grams) - 1)
        found = (grams[places] == contexts) & ~np.isnan(logb[places])
        result[at[found]] += logb[places[found]]
    result[at] -= np.log(ALPHABET)
    return result


def _score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Mean negative log-probability of each document of a block."""
    own = left[["key_id", "key_text"]].reset_index(drop=True)
    own["score"] = np.nan
    if len(left) and len(right):
        right = right.sort_values("gram")
        grams, logp, logb = (right[c].to_numpy() for c in ("gram", "logp", "logb"))
        scores = []
        for _, part in _slices(_texts(left)):
            total = log_probabilities(padded(part), grams, logp.astype(float), logb.astype(float)) * own_places(part)
            lengths = np.array([len(t) for t in part])
            # A text's grams lie between the padding before it and the one of the next.
            starts = np.concatenate([[0], np.cumsum(lengths + len(PAD))[:-1]])
            scores.append(-np.add.reduceat(total, starts) / lengths)
        own["score"] = np.concatenate(scores)
    return own


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [normal_bytes(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        some = pa.array([bool(t) for t in texts], pa.bool_())
        columns = [*batch.drop_columns(["text"]).columns, pa.array([pack(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "key_id", "key_text", "block", "packed"]).filter(some)


def document_scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """`lang, key_id, key_text, score`: log-perplexity of every distinct document that has text.

    Documents are dealt to blocks of one language; a block asks the sharded model for its distinct grams once, so what
    is joined grows with the number of blocks, not of words. The packed texts are shuffled once for both uses.
    """
    sizes = docs.groupBy(language()).agg(F.sum(F.octet_length("text")).alias("size"))
    blocks = cut(sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / BLOCK_BYTES)).cast("long").alias("blocks")))
    keys = [c.alias(k) for k, c in document_key().items()]
    keyed = docs.select("text", language(), *keys).join(broadcast_if_small(blocks, blocks.count()), "lang")
    block = F.xxhash64("lang", F.pmod(F.xxhash64("key_id", "key_text"), "blocks")).alias("block")
    schema = "lang string, key_id long, key_text long, block long, packed binary"
    packed = bound_batches(keyed.select("text", "lang", "key_id", "key_text", block)).mapInArrow(_pack, schema)
    asked = packed.groupBy("block").applyInPandas(_requests, "block long, lang string, gram long")
    answers = asked.join(model, ["lang", "gram"]).select("block", "gram", F.col("logp").cast("float"), F.col("logb").cast("float"))
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score, "key_id long, key_text long, score double")
    return scored.groupBy("key_id", "key_text").agg(F.min("score").alias("score"))


def held_out_scores(trusted: DataFrame) -> DataFrame:
    """`lang, score`: log-perplexity of every distinct trusted document under a model of the folds it is not in.

    Equal texts are in one fold. The models of all folds are fitted and asked at once, as languages of their own.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    rows = trusted.where("text IS NOT NULL").select("doc_id", "text", language(), fold.alias("fold"))

    def named(fold: Column) -> Column:
        return F.concat(fold.cast("string"), F.lit("|"), F.col("lang"))

    others = rows.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("out != fold")
    model = fit(others.select(named(F.col("out")).alias("lang"), "text"))
    scored = document_scores(rows.select("doc_id", "text", named(F.col("fold")).alias("lang")), model)
    keys = [c.alias(k) for k, c in document_key().items()]
    # A fold without others has no model: its scores would be those of an empty one.
    fitted = others.select("lang", F.col("out").alias("fold")).distinct()
    own = rows.join(F.broadcast(fitted), ["lang", "fold"], "left_semi").select("lang", *keys).distinct()
    return own.join(scored, ["key_id", "key_text"]).select("lang", "score")


def thresholds(scores: DataFrame) -> DataFrame:
    """`lang, limit` from the counted steps of held-out log-perplexities: their upper quantile."""
    steps = scores.where("score IS NOT NULL").groupBy("lang", F.floor(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    by_step = Window.partitionBy("lang").orderBy("step")
    shares = steps.withColumn("share", F.sum("n").over(by_step) / F.sum("n").over(Window.partitionBy("lang")))
    return shares.where(F.col("share") >= UPPER).groupBy("lang").agg((F.min("step") + 1).alias("step")).select("lang", (F.col("step") * STEP).alias("limit"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, lang, perplexity, limit, kept` for every row of `docs`.

    Trusted text is that of all documents labelled good and not toxic. A document without text, or in a language without
    trusted text, has no perplexity and stays; so does one in a language whose trusted text is in one fold, which has
    no limit. A null lang is a language of its own. Repeated rows are judged alike.
    """
    trusted = trusted_documents(docs, labels)
    model = fit(trusted)
    keys = [c.alias(k) for k, c in document_key().items()]
    rows = cut(docs.select("doc_id", "lang", language().alias("_lang"), *keys))
    scored = cut(rows.join(document_scores(docs, model), ["key_id", "key_text"], "left"))
    limits = thresholds(held_out_scores(trusted))
    judged = scored.join(limits.withColumnRenamed("lang", "_lang"), "_lang", "left")
    kept = F.coalesce(F.col("score") <= F.col("limit"), F.lit(True)).alias("kept")
    return judged.select("doc_id", "lang", F.exp("score").alias("perplexity"), F.exp("limit").alias("limit"), kept)
