"""One query per operator, each over a whole table with production parameters; and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm import (
    collocations, fingerprints, language_model, linedup, mixing, neardup, packing, pagetext, periodic_runs, quality, secret_scan, toxicity,
)
from grantlake.llm.archive import Archive
from grantlake.llm.common import cut, table

QUERIES: dict[str, Callable] = {}


def query(build: Callable) -> Callable:
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    judged = quality.quality_rules(docs.select("doc_id", "text"), trees)
    columns = [*quality.COUNTS, "base_failed", "kept", "score"]
    return judged.select("doc_id", *[F.col(f"_{c}").alias(c) for c in columns])


@query
def op2_mixing(spark, sf_dir) -> DataFrame:
    mixed = mixing.mix(cut(mixing.document_sizes(table(spark, sf_dir, "documents"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op3_secrets(spark, sf_dir) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    # A second parameter of a lambda would be the place in the array, so the kind is no default of one.
    counts = [
        F.size(F.filter(kinds, lambda kind: kind == F.lit(secret_scan.KINDS.index(name)))).cast("long").alias(f"n_{name}")
        for name in secret_scan.KINDS[:3]
    ]
    base = F.sha2(secret_scan.printed(F.col("base")), 256).alias("base_sha256")
    spans = secret_scan.printed(F.concat("base", "added")).alias("spans")
    return found.select("doc_id", *counts, base, spans, "n_live", "n_examples")


@query
def op4_language_model(spark, sf_dir) -> DataFrame:
    return language_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_page_text(spark, sf_dir) -> DataFrame:
    texts = pagetext.main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_packing(spark, sf_dir) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


@query
def op7_near_duplicates(spark, sf_dir) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = linedup.removed_lines(docs)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")
    lines = F.coalesce("lines", F.array().cast("array<int>")).alias("removed_lines")
    return docs.select("doc_id", n_lines).join(removed, "doc_id", "left").select("doc_id", "n_lines", lines)


@query
def op9_fingerprints(spark, sf_dir) -> DataFrame:
    found = fingerprints.compared_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.printed(F.col("sketch")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@query
def op10_warc(spark, sf_dir) -> DataFrame:
    archive = Archive.write(table(spark, sf_dir, "pages"))
    read = archive.read(archive.keys())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op12_periodic_runs(spark, sf_dir) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_repeated_tails(table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(periodic_runs.printed_runs(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_collocations(spark, sf_dir) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES = {
    "op2_mixing": r"""
WITH sizes AS (
    SELECT row_number() OVER () AS row, doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS key,
        md5(coalesce(text, '')) AS mark, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM sizes GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, 2 * source_size AS bound,
        (2 * source_size) / weight AS ratio, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights
    FROM totals
), levels AS (
    SELECT *, (3 * total - 2 * coalesce(sum(bound) OVER w, 0)::BIGINT)
        / (2 * (weights - coalesce(sum(weight) OVER w, 0)::BIGINT)) AS level
    FROM weighed WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
    SELECT coalesce(first(level ORDER BY ratio, rank) FILTER (level <= ratio), 0.0) AS level FROM levels
), targets AS (
    SELECT source, source_size, rank, weight, total, least(bound::DOUBLE, settled.level * weight) AS target
    FROM weighed, settled
), entries AS (
    SELECT s.row, s.size, pass, t.*, row_number() OVER (PARTITION BY s.source, pass ORDER BY s.key, s.doc_id NULLS FIRST, s.mark, s.row) AS place,
        (sum(s.size) OVER (PARTITION BY s.source, pass ORDER BY s.key, s.doc_id NULLS FIRST, s.mark, s.row ROWS UNBOUNDED PRECEDING)::BIGINT
            + pass * t.source_size) / t.weight AS finish
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(pass)
    WHERE s.size > 0
), queued AS (
    SELECT row, size, total,
        sum(size) OVER (ORDER BY finish, rank, pass, place ROWS UNBOUNDED PRECEDING)::BIGINT AS words
    FROM entries
), taken AS (
    SELECT row, sum(size)::BIGINT AS taken FROM queued WHERE 2 * words <= 3 * total GROUP BY row
)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON s.row = k.row
""",
    "op13_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), begins AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), counts AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
    FROM begins, (VALUES (1), (2), (3), (4)) s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE size > 1 AND f >= 30
), cuts AS (
    SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f::HUGEINT + r.f))::BIGINT AS score
    FROM cuts c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
    SELECT DISTINCT lang, phrase, a AS longer, array_to_string(w[i : i + n - 1], ' ') AS inner_phrase
    FROM candidates, (VALUES (2), (3)) s(n), (VALUES (1), (2), (3)) p(i) WHERE n < size AND i + n - 1 <= size
), covered AS (
    SELECT lang, inner_phrase AS phrase, max(longer) AS longer FROM held GROUP BY ALL
)
SELECT l.lang, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank, l.phrase, a, l, r, n, score
FROM lowest l JOIN totals USING (lang) LEFT JOIN covered c ON c.lang = l.lang AND c.phrase = l.phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
""",
}
