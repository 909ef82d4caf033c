"""Document fingerprints by consistent weighted sampling of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import cut, document_key, running_totals

SAMPLES = 24
SPACES = r"[\x20\x09-\x0D]+"
KEY = ["key_id", "key_text"]


def _uniforms(bits: Column, n: int, width: int = 21) -> list[Column]:
    """Numbers between 0 and 1 from separate bits of a hash."""
    mask = (1 << width) - 1
    return [(F.shiftrightunsigned(bits, i * width).bitwiseAND(F.lit(mask)) + 0.5) / float(1 << width) for i in range(n)]


def sample(term: Column, log_weight: Column, index: int) -> Column:
    """The draw of a weighted term for one sample; the smallest of a document is its sample.

    r and c are gamma(2, 1), b is uniform, all fixed by the term. With t = floor(log w / r + b) and log y = r (t - b),
    the draw is log a = log c - log y - r. It is returned as one integer: log a in the high bits, a hash of (term, t) in
    the low 32, so that equal integers are equal samples.
    """
    r1, r2, b = _uniforms(F.xxhash64(term, F.lit(2 * index)), 3)
    c1, c2 = _uniforms(F.xxhash64(term, F.lit(2 * index + 1)), 2)
    r = -F.log(r1 * r2)
    t = F.floor(log_weight / r + b)
    log_a = F.log(-F.log(c1 * c2)) - r * (t - b) - r
    scaled = F.floor((log_a + 256.0) * float(1 << 21)).cast("long")
    return F.shiftleft(scaled, 32) + F.hash(term, t).cast("long") + F.lit(1 << 31)


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys, sketch`: an array of 32-bit samples for every row of `texts` (unique keys, `text`) that has words.

    A word weighs as often as it occurs. Two sketches agree in a place with the probability of the texts' generalised
    Jaccard similarity: the sum of smaller weights over the sum of larger ones.
    """
    words = texts.select(*keys, F.explode(F.split("text", SPACES)).alias("word")).where("word != ''")
    weighed = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").count()
    log_weight = F.log(F.col("count").cast("double"))
    draws = [F.min(sample(F.col("term"), log_weight, i)).alias(f"s{i}") for i in range(samples)]
    low = [F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(samples)]
    return weighed.groupBy(*keys).agg(*draws).select(*keys, F.array(*low).alias("sketch"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; two texts without words are alike, one without words is like no other."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).otherwise(F.coalesce(equal / F.size(a), F.lit(0.0)))


def printed(sketch: Column) -> Column:
    """Eight hexadecimal digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit(""))


def edited_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct documents with `text, edited`; and `doc_id, n_rows` and the next one's key (`next_id, next_text`) of each.

    Next is by falling doc_id (null last; equal ids by text hash), and the first after the last. In the edited text
    the last third of the characters gives way to as many of the next document's first ones, or all.
    Texts are shuffled once; only the asked-for beginnings travel a second time.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(k) for k, c in document_key().items()])
    narrow = keyed.select("doc_id", F.length("text").alias("n_chars"), *KEY).groupBy(*KEY)
    known = narrow.agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("n_rows"))
    placed = cut(running_totals(known, [F.col("doc_id").desc_nulls_last(), F.col("key_text")], {"place": F.lit(1)}))
    n = placed.count()
    asking = placed.select(
        F.col("key_id").alias("asker_id"), F.col("key_text").alias("asker_text"), "doc_id", "n_rows",
        F.floor(F.col("n_chars") / 3).cast("int").alias("asked"), ((F.col("place") + 1) % max(n, 1)).alias("place"),
    )
    following = cut(asking.join(placed.select("place", *KEY), "place"))
    # Every use needs these columns alone, so that one shuffle of the texts serves all.
    once = keyed.select(*KEY, "text").groupBy(*KEY).agg(F.first("text").alias("text"))
    begun = once.join(following.select(*KEY, "asker_id", "asker_text", "asked"), KEY).select(
        F.col("asker_id").alias("key_id"), F.col("asker_text").alias("key_text"),
        F.substring(F.col("text"), F.lit(1), F.col("asked")).alias("begin"),
    )
    length = F.length("text")
    kept = F.substring(F.col("text"), F.lit(1), length - F.floor(length / 3).cast("int"))
    joined = once.join(begun, KEY)
    edited = joined.select(*KEY, "text", F.concat(kept, "begin").alias("edited"))
    nexts = following.select(
        F.col("asker_id").alias("key_id"), F.col("asker_text").alias("key_text"),
        "doc_id", "n_rows", F.col("key_id").alias("next_id"), F.col("key_text").alias("next_text"),
    )
    return edited, nexts


def compared_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch` for every row of `docs`.

    Null texts count as empty; sketches of texts without words are null. Repeated rows (doc_id and text) count as one
    document when looking for the next one, and each is returned. A single document is its own next.
    """
    edited, nexts = edited_documents(docs)
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))]))
    texts = edited.select(*KEY, both.alias("one")).select(*KEY, "one.kind", "one.text")
    sketches = fingerprints(texts, [*KEY, "kind"], samples).groupBy(*KEY)
    pair = sketches.agg(*[F.max(F.when(F.col("kind") == i, F.col("sketch"))).alias(c) for i, c in enumerate(("sketch", "edited_sketch"))])
    facts = edited.select(
        *KEY, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    found = cut(facts.join(pair, KEY, "left"))
    other = found.select(F.col("key_id").alias("next_id"), F.col("key_text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    joined = found.join(nexts, KEY).join(other, ["next_id", "next_text"])
    repeated = joined.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return repeated.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
