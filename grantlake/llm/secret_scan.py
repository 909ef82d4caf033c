"""Secret scans: base patterns, and ownership counts over the corpus that tell examples from live credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import cut, document_key

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Whole runs; shorter ones cannot hold a later match that is long enough.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
# Other runs that look generated: this long, with letters and digits, of many different characters.
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
GENERIC_LEAST_DISTINCT = 10
KINDS = ("assign", "access", "hex", "generic")
# A value in the texts of so many owners, or in so many repositories of whatever owners, is a widely copied example;
# any other, of one or two owners in few repositories, looks live.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
BLOCK = 256
KEY = ["key_id", "key_text"]


def _running(lengths: Column) -> Column:
    """Sums up to and with each element. Arrays grow inside blocks, so long ones take no quadratic time."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / BLOCK).cast("int") - 1)

    def block(b: Column) -> Column:
        return F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))

    def add(state: Column, x: Column) -> Column:
        total = state["at"] + x
        return F.struct(total.alias("at"), F.concat(state["out"], F.array(total)).alias("out"))

    def sums(values: Column, start: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.aggregate(values, F.struct(start.alias("at"), empty.alias("out")), add)["out"]

    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda n, x: n + x))
    ends = F.concat(F.array(F.lit(0).cast("long")), sums(totals, F.lit(0).cast("long")))
    return F.flatten(F.transform(blocks, lambda b: sums(block(b), ends[b])))


def spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, value) in code points; empty for most texts at once."""
    rank = F.lit(KINDS.index(kind))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    gap_lengths = F.transform(gaps, lambda g: F.length(g).cast("long"))
    lengths = F.zip_with(gap_lengths, found, lambda gap, m: gap + F.length(m))
    ends = F.zip_with(_running(lengths), found, lambda end, m: F.struct(end.alias("end"), F.length(m).alias("n")))
    all_spans = F.zip_with(
        ends, values,
        lambda e, v: F.struct((e["end"] - e["n"]).alias("start"), rank.alias("kind"), e["end"].alias("end"), v.alias("value")),
    )
    return F.when(F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False)), all_spans).otherwise(F.filter(_none(), lambda s: s["end"] < 0))


def _none() -> Column:
    one = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("end"), F.lit("").alias("value"))
    return F.array(one)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """`key_id, key_text, doc_id, owner, base, generic`: every document's spans with their values."""
    text = F.coalesce("text", F.lit(""))
    assigned = F.filter(spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(assigned, spans(text, ACCESS, "access"), spans(text, HEX, "hex")))

    def generated(s: Column) -> Column:
        mixed = F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))
        return mixed & (F.size(F.array_distinct(F.split(s["value"], ""))) >= GENERIC_LEAST_DISTINCT)

    generic = F.filter(spans(text, GENERIC, "generic"), generated)
    keys = [c.alias(k) for k, c in document_key().items()]
    return docs.select(*keys, "doc_id", F.col(owner).alias("owner"), base.alias("base"), generic.alias("generic"))


def ownership(found: DataFrame) -> DataFrame:
    """`value_hash, n_owners, n_repositories`: in how many owners' and documents' texts each candidate value is.

    Documents stand for repositories. Counting goes from (value, owner, document) over (value, owner) to the value, so a
    value that is everywhere is reduced before every shuffle.
    """
    seen = found.select(
        F.coalesce("owner", F.lit("")).alias("owner"), *KEY, F.explode(F.array_union(F.transform("base", _hash), F.transform("generic", _hash))).alias("value_hash"),
    )
    by_owner = seen.groupBy("value_hash", "owner", *KEY).count().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _hash(span: Column) -> Column:
    return F.sha2(span["value"], 256)


def scan_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """`doc_id, base, added, n_live, n_examples` for every row of `docs`; spans are (start, kind, end, value).

    Base spans are found in every text. Generated-looking runs beside them are added if they look live: fewer than
    EXAMPLE_OWNERS owners and fewer than EXAMPLE_REPOSITORIES documents have them. All other values are examples. n_live and n_examples count the document's distinct values of either kind. Null
    texts are empty; a null owner is the empty one; repeated rows count once and are returned each.
    """
    found = cut(candidates(docs, owner))
    owners = ownership(found)
    uses = found.select(*KEY, F.explode(F.array_distinct(F.concat(F.transform("base", _hash), F.transform("generic", _hash)))).alias("value_hash"))
    judged = uses.distinct().join(owners, "value_hash").groupBy(*KEY)
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES)
    facts = judged.agg(F.collect_set(F.when(live, F.col("value_hash"))).alias("live"), F.count_if(~live).alias("n_examples"))
    joined = found.join(facts, KEY, "left")
    own = F.coalesce("live", F.array().cast("array<string>"))
    known = F.transform("base", lambda s: s["value"])
    added = F.filter("generic", lambda s: F.array_contains(own, _hash(s)) & ~F.array_contains(known, s["value"]))
    return joined.select("doc_id", "base", added.alias("added"), F.size(own).cast("long").alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def printed(found: Column) -> Column:
    """kind:start:end, comma-joined, by start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
