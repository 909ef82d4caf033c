"""Reference SQL for the registered queries, in DuckDB's dialect over the same tables."""

from __future__ import annotations

# Fixed values, spelled out here so that the SQL does not depend on the code it checks.
ELIGIBILITY_WORDS = (
    "grant", "grants", "eligible", "eligibility", "qualify", "qualifies", "funding", "application", "fund", "program", "scheme",
)
COMPLIANCE_WORDS = (
    "tax", "taxes", "ato", "compliance", "pay", "wage", "wages", "award", "fair work", "super", "superannuation", "obligation",
    "obligations", "employee", "employer", "payroll",
)
TOPIC_WORDS = {
    "gst": ("gst", "goods and services tax"),
    "payg": ("payg", "pay as you go"),
    "superannuation": ("super", "superannuation"),
    "record_keeping": ("record keeping", "records you need to keep", "recordkeeping"),
}
CASCADE_WORDS = (
    ("award_pay", ("award", "pay rate", "wage", "employee", "hire")),
    ("tax", ("tax", "gst", "payg", "ato", "super")),
)
CASCADE_DEFAULT = "grants"
NO_GRANTS = (
    "I could not find any grants matching your question. Try rephrasing with your industry, location, or business size."
)
NO_GUIDANCE = (
    "I could not find compliance guidance matching your question. "
    "Try mentioning the award, industry, or obligation you're asking about."
)
DISCLAIMER = (
    "This is general guidance, not tax or legal advice - confirm specifics with the ATO or Fair Work Commission before acting."
)
FETCHED_AT = "2026-11-02T00:00:00.000000+00:00"
RECORD_SITE = "https://records.example.org/"
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def record_key(source: str, key: str) -> str:
    return f"{source} || '#' || substr(sha256({source} || ':' || coalesce({key}, '')), 1, 24)"


def strip(column: str) -> str:
    return f"trim({column}, {text(WHITESPACE)})"


WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

CLASSIFY = (
    f"CASE WHEN {any_word('lower(text)', ELIGIBILITY_WORDS)} AND NOT {any_word('lower(text)', COMPLIANCE_WORDS)} "
    f"THEN 'eligibility' WHEN {any_word('lower(text)', COMPLIANCE_WORDS)} AND NOT "
    f"{any_word('lower(text)', ELIGIBILITY_WORDS)} THEN 'compliance' ELSE 'mixed' END"
)
AGENTS = (
    "CASE {} WHEN 'eligibility' THEN 'retrieval_agent,eligibility_agent' "
    "WHEN 'compliance' THEN 'retrieval_agent,compliance_agent' "
    "ELSE 'retrieval_agent,eligibility_agent,compliance_agent' END"
)

FIELDS = f"""
fields AS (
  SELECT doc_id, source, lang, n_chars,
    upper(lang) || ' notice ' || doc_id AS title,
    text AS description,
    CASE WHEN lang <> 'fr' THEN 'Readers of ' || lang END AS eligibility,
    CASE WHEN n_chars >= 1000 THEN '$' || n_chars ELSE '' END AS amount,
    CASE lang WHEN 'en' THEN '31 December 2026' WHEN 'de' THEN '2027-03-15' END AS deadline,
    CASE WHEN lang = 'es' THEN '' ELSE lang END AS category,
    CASE WHEN n_chars < 2000 THEN source END AS state_or_territory,
    {text(RECORD_SITE)} || doc_id AS url
  FROM documents
)"""
RECORDS = f"""{FIELDS},
records AS (
  SELECT *, {record_key("source", "url")} AS record_id,
    concat_ws(' ', title, nullif(description, ''), nullif(eligibility, ''), nullif(category, ''),
              nullif(state_or_territory, '')) AS record_text
  FROM fields
)"""
QUESTIONS = """
questions AS (
  SELECT conv_id || '-' || turn AS question_id, text FROM conversations WHERE role = 'user'
)"""
HITS = f"""{RECORDS},{QUESTIONS},
question_words AS (
  SELECT question_id, term, count(*) AS q_count, count(*) OVER (PARTITION BY question_id) AS n_distinct
  FROM (SELECT question_id, unnest({WORDS.format("text")}) AS term FROM questions) GROUP BY question_id, term
),
record_words AS (
  SELECT doc_id, term, count(*) AS t_count
  FROM (SELECT doc_id, unnest({WORDS.format("record_text")}) AS term FROM records) GROUP BY doc_id, term
),
scored AS (
  SELECT question_id, doc_id, sum(q_count * t_count)::DOUBLE / any_value(n_distinct) AS score
  FROM question_words JOIN record_words USING (term) GROUP BY question_id, doc_id
),
hits AS (
  SELECT question_id, rank, doc_id AS ord, score, r.* FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored
  ) JOIN records r USING (doc_id) WHERE rank <= 5
)"""
ANSWERS = f"""{HITS},
per_question AS (
  SELECT question_id,
    'Based on the grants I found, ' || any_value(title) FILTER (rank = 1) || ' looks most relevant.'
      || coalesce(' Eligibility: ' || any_value(nullif(eligibility, '')) FILTER (rank = 1) || '.', '')
      || coalesce(' Deadline: ' || any_value(nullif(deadline, '')) FILTER (rank = 1) || '.', '')
      || coalesce(' Amount: ' || any_value(nullif(amount, '')) FILTER (rank = 1) || '.', '')
      || coalesce(' Other potentially relevant grants: '
           || string_agg(title, ', ' ORDER BY rank) FILTER (rank > 1) || '.', '') AS eligibility_answer,
    'For compliance obligations, ' || any_value(title) FILTER (rank = 1) || ' is the most relevant guidance I found.'
      || coalesce(' ' || any_value(nullif(description, '')) FILTER (rank = 1), '')
      || coalesce(' Other relevant guidance: '
           || string_agg(title, ', ' ORDER BY rank) FILTER (rank > 1) || '.', '')
      || ' ' || {text(DISCLAIMER)} AS compliance_answer,
    string_agg('- ' || title || ' (source: ' || source || '): eligibility='
      || coalesce(nullif(eligibility, ''), 'not specified') || ', deadline='
      || coalesce(nullif(deadline, ''), 'not specified') || ', amount='
      || coalesce(nullif(amount, ''), 'not specified'), chr(10) ORDER BY rank) AS eligibility_context,
    string_agg('- ' || title || ' (source: ' || source || '): ' || coalesce(description, 'None'),
      chr(10) ORDER BY rank) AS compliance_context,
    count(*) AS n_citations
  FROM hits GROUP BY question_id
),
classified AS (
  SELECT q.question_id, q.text, {CLASSIFY.replace("lower(text)", "lower(q.text)")} AS classification, p.* EXCLUDE (question_id)
  FROM questions q LEFT JOIN per_question p ON p.question_id = q.question_id
)"""
PROMPT = "'Context:' || chr(10) || {} || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Answer:'"

HIDDEN = (
    "regexp_replace(regexp_replace(regexp_replace(html, '<!--[\\s\\S]*?-->', '<!>', 'g'), "
    "'(?i)<script\\b[^>]*>[\\s\\S]*?</script\\s*>', '<!>', 'g'), '(?i)<style\\b[^>]*>[\\s\\S]*?</style\\s*>', '<!>', 'g')"
)


# The references that the pages hold, spelled out independently of the decoder.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "middot": "·", "amp": "&"}


def decoded(column: str) -> str:
    for name, char in [(n, c) for n, c in ENTITIES.items() if n != "amp"] + [("amp", "&")]:
        column = f"replace({column}, '&{name};', {text(char)})"
    return column


def fragments(html: str, separator: str) -> str:
    parts = f"string_split_regex({html}, '<[a-zA-Z/!][^>]*>')"
    return f"array_to_string([f FOR f IN [{strip(decoded('x'))} FOR x IN {parts}] IF f <> ''], {separator})"


HREFS = f"[h FOR h IN regexp_extract_all({HIDDEN}, '<a href=\"([^\"]*)\"', 1) IF h <> '']"


def links(hrefs: str, source: str, url: str, keep: str = "true", cap: int | None = None) -> str:
    """Distinct sorted links per page; ``url`` resolves ``h``, ``keep`` filters ``link``."""
    limit = "" if cap is None else f" WHERE link_ord <= {cap}"
    return f"""
    SELECT page_id, link_ord, link FROM (
      SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS link_ord
      FROM (SELECT DISTINCT page_id, {url} AS link FROM (
        SELECT page_id, url AS page_url, unnest({hrefs}) AS h FROM {source})) WHERE {keep}){limit}"""


def normalized(source: str, key: str, url: str, raw: str | None = None, **columns: str) -> str:
    names = ("title", "description", "eligibility", "amount", "deadline", "category", "state_or_territory")
    picked = ", ".join(f"({columns.get(n, 'NULL')})::VARCHAR AS {n}" for n in names)
    return (
        f"SELECT doc_id, {record_key(text(source), key)} AS record_id, {text(source)} AS source, {picked}, "
        f"{url} AS url, {text(FETCHED_AT)} AS ingested_at, {raw or 'NULL'} AS raw FROM fields"
    )


LINK = "CASE WHEN lang <> 'es' THEN url END"


def json_object(**values: str) -> str:
    """A JSON object without null members, keys sorted."""
    members = [f"CASE WHEN ({v}) IS NOT NULL THEN '\"{k.replace('_SPACE_', ' ')}\":' || to_json({v}) END" for k, v in sorted(values.items())]
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


NORMALIZED = {
    "grantconnect": normalized(
        "grantconnect", "url", "url",
        title="title", description="description",
        eligibility="coalesce(CASE WHEN lang <> 'en' THEN eligibility END, 'applicants in ' || source)",
        amount="amount", deadline="deadline", category="category", state_or_territory="state_or_territory",
        raw="'{\"category\":' || to_json(category) || coalesce(',\"closing_date\":' || to_json(deadline), '')"
            " || ',\"description\":' || to_json(description) || ',\"estimated_value\":' || to_json(amount)"
            " || ',\"raw_fields\":' || " + json_object(
                eligibility="CASE WHEN lang = 'en' THEN '' ELSE eligibility END",
                eligible_SPACE_applicants="'applicants in ' || source", state="state_or_territory",
            ) + " || ',\"title\":' || to_json(title) || ',\"url\":' || to_json(url) || '}'",
    ),
    "data_gov_au": normalized(
        "data_gov_au",
        "coalesce(CASE WHEN lang <> 'de' THEN doc_id::VARCHAR END, CASE WHEN n_chars >= 1000 THEN 'https://data.gov.au/dataset/set-' || doc_id END)",
        "CASE WHEN n_chars >= 1000 THEN 'https://data.gov.au/dataset/set-' || doc_id END",
        title="title", description="description", category="CASE WHEN lang <> 'fr' THEN lang END",
        state_or_territory="source",
        raw="'{' || coalesce('\"id\":' || to_json(CASE WHEN lang <> 'de' THEN doc_id::VARCHAR END) || ',', '')"
            " || coalesce('\"name\":' || to_json(CASE WHEN n_chars >= 1000 THEN 'set-' || doc_id END) || ',', '')"
            " || '\"notes\":' || to_json(description) || ',\"organization\":{\"title\":' || to_json(source) || '},\"tags\":'"
            " || CASE WHEN lang = 'fr' THEN '[]' ELSE '[{\"name\":' || to_json(lang) || '},{\"name\":\"second\"}]' END"
            " || ',\"title\":' || to_json(title) || '}'",
    ),
    "business_gov_au": normalized(
        "business_gov_au", f"CASE WHEN n_chars < 1000 THEN url ELSE {LINK} END",
        f"CASE WHEN n_chars < 1000 THEN url ELSE {LINK} END",
        title="title", description="nullif(description, '')", eligibility="eligibility",
        amount="CASE WHEN amount <> '' THEN amount ELSE 'see page' END", deadline="deadline", category="category",
        state_or_territory="state_or_territory",
        raw=json_object(
            url="CASE WHEN n_chars < 1000 THEN url ELSE '' END", link=LINK, title="title",
            description="CASE WHEN lang = 'en' THEN description ELSE '' END",
            summary="CASE WHEN lang <> 'en' THEN description END", who_can_apply="eligibility", amount="amount",
            funding_amount="'see page'", closing_date="deadline", category="category", location="state_or_territory",
        ),
    ),
    "ato": normalized(
        "ato", LINK, LINK, title="title", description="nullif(description, '')",
        category="CASE WHEN category <> '' THEN category ELSE 'general' END",
        raw=json_object(
            url=LINK, title="title", summary="CASE WHEN n_chars >= 1000 THEN description END", content="description",
            category="category", topic="'general'",
        ),
    ),
    "fair_work_mapd": normalized(
        "fair_work_mapd", LINK, LINK,
        title="CASE WHEN n_chars >= 1000 THEN 'award ' || doc_id ELSE title END",
        description="nullif(description, '')", eligibility="eligibility", amount="nullif(amount, '')",
        category="CASE WHEN lang = 'en' THEN 'clerks' ELSE 'modern_award' END",
        raw=json_object(
            link=LINK, title="CASE WHEN n_chars >= 1000 THEN '' ELSE title END", award_name="'award ' || doc_id",
            summary="description", pay_rate="amount", conditions="eligibility",
            classification="CASE WHEN lang = 'en' THEN 'clerks' ELSE '' END",
        ),
    ),
}
ALL_NORMALIZED = " UNION ALL ".join(NORMALIZED.values())

CENTROIDS = """
centroids AS (
  SELECT label, list(mean ORDER BY pos) AS mean FROM (
    SELECT label, pos, avg(value::DOUBLE) AS mean FROM (
      SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label
)"""

TOPICS = "array_to_string([t FOR t IN [{}] IF t IS NOT NULL], ',')"


def topics(column: str) -> str:
    cases = [f"CASE WHEN {any_word(f'lower({column})', words)} THEN {text(t)} END" for t, words in sorted(TOPIC_WORDS.items())]
    return TOPICS.format(", ".join(cases))


GUIDE_EXTRA = "CASE WHEN lang = 'de' THEN ' with payg and super' ELSE '' END"
CHUNK_SIZE, CHUNK_STEP = 200, 160

LETTERS = ", ".join(f"length({{0}}) - length(replace({{0}}, '{x}', ''))" for x in "aeinot")
EMBEDDED_HITS = f"""{RECORDS},{QUESTIONS},
record_vectors AS (SELECT doc_id, [{LETTERS.format("record_text")}]::DOUBLE[] AS v FROM records),
question_vectors AS (SELECT question_id, [{LETTERS.format("text")}]::DOUBLE[] AS q FROM questions),
scored AS (
  SELECT question_id, doc_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score
  FROM record_vectors, question_vectors WHERE list_dot_product(v, q) > 0
),
hits AS (
  SELECT question_id, rank, doc_id AS ord, score, r.* FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scored
  ) JOIN records r USING (doc_id) WHERE rank <= 5
)"""

ORACLES: dict[str, str] = {
    "record_ids": f"SELECT doc_id, {record_key('source', 'nullif(lang, ' + text('es') + ')')} AS record_id FROM documents",
    "record_text_snippet": f"WITH {RECORDS} SELECT record_id, record_text, nullif(substr(description, 1, 280), '') AS snippet FROM records",
    "tokenize_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "keyword_score_pairs": f"""
      WITH q AS (SELECT conv_id, turn + 1 AS turn, unnest({WORDS.format('text')}) AS term FROM conversations),
      qc AS (SELECT conv_id, turn, term, count(*) AS n, count(*) OVER (PARTITION BY conv_id, turn) AS n_distinct FROM q GROUP BY conv_id, turn, term),
      t AS (SELECT conv_id, turn, unnest({WORDS.format('text')}) AS term FROM conversations),
      tc AS (SELECT conv_id, turn, term, count(*) AS n FROM t GROUP BY ALL),
      s AS (SELECT conv_id, turn, sum(qc.n * tc.n)::DOUBLE / any_value(n_distinct) AS score FROM qc JOIN tc USING (conv_id, turn, term) GROUP BY ALL)
      SELECT c.conv_id, c.turn, coalesce(s.score, 0.0) AS score
      FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn
      LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn""",
    "keyword_retrieve_topk": f"WITH {HITS} SELECT question_id, rank, record_id, ord, score FROM hits",
    "keyword_index_topk": f"WITH {HITS} SELECT question_id, rank, record_id, ord, score FROM hits",
    "cosine_retrieve_topk": f"""
      WITH {CENTROIDS}
      SELECT question_id, rank, record_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM (
          SELECT c.label AS question_id, vec_id, vec_id::VARCHAR AS record_id,
                 list_cosine_similarity(c.mean, e.embedding::DOUBLE[]) AS score
          FROM centroids c, embeddings e) WHERE score > 0) WHERE rank <= 5""",
    "cosine_score_pairs": f"""
      WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS score
      FROM embeddings JOIN centroids USING (label)""",
    "classify_question": f"SELECT conv_id, turn, {CLASSIFY} AS classification FROM conversations",
    "route_agents": f"SELECT conv_id, turn, {AGENTS.format(CLASSIFY)} AS agents_used FROM conversations",
    "keyword_cascade": "SELECT doc_id, CASE "
    + " ".join(f"WHEN {any_word('lower(text)', words)} THEN {text(name)}" for name, words in CASCADE_WORDS)
    + f" ELSE {text(CASCADE_DEFAULT)} END AS label FROM documents",
    "topic_labels": f"SELECT doc_id, {topics('text')} AS topics FROM documents",
    "answer_questions_table": f"""
      WITH {ANSWERS}
      SELECT question_id, classification,
        concat_ws(chr(10) || chr(10),
          CASE WHEN classification <> 'compliance' THEN coalesce(eligibility_answer, {text(NO_GRANTS)}) END,
          CASE WHEN classification <> 'eligibility' THEN coalesce(compliance_answer, {text(NO_GUIDANCE)}) END) AS answer,
        coalesce(n_citations, 0) AS n_citations, {AGENTS.format("classification")} AS agents_used, false AS is_mock
      FROM classified""",
    "answers_without_hits": """
      SELECT concat_ws('-', conv_id, turn) AS question_id, 'mixed' AS classification,
        'I could not find any grants matching your question. Try rephrasing with your industry, location, or business size.'
        || chr(10) || chr(10) ||
        'I could not find compliance guidance matching your question. '
        || 'Try mentioning the award, industry, or obligation you''re asking about.' AS answer,
        0 AS n_citations, false AS is_mock
      FROM conversations WHERE role = 'user'""",
    "citations": f"""
      WITH {HITS} SELECT question_id, rank, record_id, title, url, source, nullif(substr(description, 1, 280), '') AS snippet
      FROM hits""",
    "prompt_context": f"""
      WITH {ANSWERS} SELECT question_id, eligibility_context, compliance_context,
        {PROMPT.format("eligibility_context")} AS eligibility_prompt, {PROMPT.format("compliance_context")} AS compliance_prompt
      FROM classified WHERE n_citations > 0""",
    "generated_answers": f"""
      WITH {ANSWERS}
      SELECT question_id, concat_ws(chr(10) || chr(10),
          CASE WHEN classification <> 'compliance' THEN coalesce(length(text) || '/' || (1 + (length(eligibility_context) - length(replace(eligibility_context, chr(10) || '- ', ''))) // 3), {text(NO_GRANTS)}) END,
          CASE WHEN classification <> 'eligibility' THEN coalesce(length(text) || '/' || (1 + (length(compliance_context) - length(replace(compliance_context, chr(10) || '- ', ''))) // 3), {text(NO_GUIDANCE)}) END) AS answer
      FROM classified""",
    "raw_envelope_roundtrip": f"SELECT doc_id, text, lang, source, {text(FETCHED_AT)} AS fetched_at FROM documents",
    **{f"normalize_{s}": f"WITH {FIELDS} {sql}" for s, sql in NORMALIZED.items()},
    "normalize_dispatch": f"WITH {FIELDS}, n AS ({ALL_NORMALIZED}) SELECT * EXCLUDE (raw) FROM n",
    "processed_json": f"""
      WITH {FIELDS}, n AS ({ALL_NORMALIZED})
      SELECT record_id, source, title, amount, deadline, category, url, ingested_at,
        json_extract_string(raw, '$.title') AS raw_title FROM n""",
    "typed_fields": f"""
      WITH {RECORDS} SELECT record_id, CASE WHEN n_chars >= 1000 THEN n_chars::DOUBLE END AS amount_value,
        CASE lang WHEN 'en' THEN '2026-12-31' WHEN 'de' THEN '2027-03-15' END AS deadline_date FROM records""",
    "upsert_last_wins": """
      SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view') DESC, event_id DESC) AS r
        FROM events) WHERE r = 1""",
    "key_collision_report": f"WITH {FIELDS}, n AS ({NORMALIZED['ato']}) SELECT record_id, count(*) AS n_rows FROM n GROUP BY record_id HAVING count(*) > 1",
    "changed_records": f"""
      WITH {FIELDS}, n AS ({NORMALIZED['grantconnect']})
      SELECT record_id, 'New: ' || title AS title FROM n WHERE length(description) >= 1000""",
    "first_wins_dedup": """
      SELECT package_id, term_ord, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY term_ord, page, pos) AS r FROM (
          SELECT CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS package_id, event_id AS pos,
            CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS term_ord, ts::DATE AS page
          FROM events) WHERE package_id IS NOT NULL) WHERE r = 1""",
    "ckan_flatten": f"""
      WITH found AS (
        SELECT 0 AS term_ord, * FROM documents WHERE lang <> 'en' UNION ALL SELECT 1 AS term_ord, * FROM documents),
      placed AS (
        SELECT *, doc_id // 100 * 100 AS start,
          row_number() OVER (PARTITION BY term_ord, doc_id // 100 ORDER BY doc_id) - 1 AS pos,
          count(*) OVER (PARTITION BY term_ord, doc_id // 100) AS page_rows FROM found),
      kept AS (
        SELECT *, min(CASE WHEN page_rows < 100 THEN start END) OVER (PARTITION BY term_ord) AS cut FROM placed),
      firsts AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term_ord, start, pos) AS r
        FROM kept WHERE cut IS NULL OR start <= cut)
      SELECT {record_key("'data_gov_au'", "doc_id::VARCHAR")} AS record_id, 'Dataset ' || doc_id AS title, text AS description,
        lang AS category, source AS state_or_territory, 'https://data.gov.au/dataset/set-' || doc_id AS url,
        doc_id::VARCHAR AS package_id, term_ord, start, pos FROM firsts WHERE r = 1""",
    "run_report": "SELECT source, count(*) AS n_records, 'ok (' || count(*) || ' records)' AS status FROM documents GROUP BY source",
    "status_filter": "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://m\\.')",
    "paging_cutoff": f"""
      WITH listing AS (
        SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS source, page_id AS page_no,
          len([h FOR h IN {HREFS} IF starts_with(h, '/th')]) AS n_links FROM pages),
      cuts AS (SELECT *, min(CASE WHEN n_links = 0 THEN page_no END) OVER (PARTITION BY source) AS cut FROM listing)
      SELECT source, page_no, n_links FROM cuts WHERE cut IS NULL OR page_no < cut""",
    "page_title": f"SELECT page_id, nullif({fragments(f'regexp_extract({HIDDEN}, ' + text('(?is)<h1[^>]*>(.*?)</h1>') + ', 1)', text(''))}, '') AS title FROM pages",
    "page_text_lines": f"SELECT page_id, {fragments(HIDDEN, 'chr(10)')} AS text FROM pages",
    "page_links_resolved": links(HREFS, "pages", "regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || h"),
    "page_description": f"""
      SELECT doc_id AS page_id, lang || ':' || {strip("text")} AS description FROM documents""",
    "page_description_of_leaves": f"""
      SELECT doc_id AS page_id, {strip("text")} AS description FROM documents WHERE lang <> 'es' AND {strip("text")} <> ''""",
    "links_grant_listing": links(
        f"[h FOR h IN {HREFS} IF starts_with(h, '/th')]", "pages", "'https://www.grants.gov.au/Go/Show?GoUuid=' || substr(h, 2)"
    ),
    "links_program_listing": links(
        f"[h FOR h IN {HREFS} IF starts_with(h, '/th')]", "pages", "'https://business.gov.au/grants-and-programs' || h"
    ),
    "links_guidance_hub": links(
        f"[h FOR h IN {HREFS} IF starts_with(h, '/th')]",
        "pages",
        "'https://www.ato.gov.au/businesses-and-organisations/small-business' || h",
        cap=3,
    ),
    "links_award_search": links(
        f"list_concat({HREFS}, CASE WHEN contains({HIDDEN}, '<footer>') THEN ['/files/' || page_id || '.pdf?x=1'] ELSE [] END)",
        "pages",
        "'https://www.fwc.gov.au' || h",
    ),
    "labelled_page_fields": """
      SELECT p_partkey AS page_id, f.label, f.value FROM (SELECT p_partkey, unnest([
        {'label': 'agency', 'value': p_name},
        {'label': 'eligibility', 'value': p_type || 'only'},
        {'label': 'who can apply', 'value': p_type || 'only'},
        {'label': 'total funding', 'value': '$' || p_size},
        {'label': 'close date', 'value': p_size || ' May 2027'},
        {'label': 'segment', 'value': p_type}]) AS f FROM part)""",
    "grant_page_payloads": """
      SELECT p_partkey AS page_id, 'https://grants.example.org/' || p_partkey AS url, 'Part' || p_partkey AS title,
        'A' || p_name || 'of ' || p_type AS description, p_name AS agency, p_type AS category,
        p_size || ' May 2027' AS closing_date, '$' || p_size AS estimated_value FROM part""",
    "program_page_payloads": """
      SELECT p_partkey AS page_id, 'https://grants.example.org/' || p_partkey AS url, 'Part' || p_partkey AS title,
        'A' || p_name || 'of ' || p_type AS description, p_type || 'only' AS eligibility,
        p_size || ' May 2027' AS closing_date, NULL::VARCHAR AS what_you_get FROM part""",
    "page_sections": f"""
      SELECT doc_id AS page_id, s.heading, s.body FROM (SELECT doc_id, unnest([
        {{'heading': 'Overview', 'body': 'Last word'}},
        {{'heading': 'GST andsuper', 'body': 'Written in ' || lang || {GUIDE_EXTRA} || ' Length ' || n_chars}}]) AS s FROM documents)""",
    "guidance_topics": f"""
      SELECT doc_id AS page_id, 'Guide ' || doc_id AS title, 2 AS n_sections,
        {topics("('Guide ' || doc_id || ' Last word Written in ' || lang || " + GUIDE_EXTRA + ")")} AS topics FROM documents""",
    "guidance_page_payloads": """
      SELECT doc_id AS page_id, 'https://guides.example.org/' || doc_id AS url, 'Guide ' || doc_id AS title,
        'Last word' AS overview, CASE WHEN lang = 'de' THEN '["payg","superannuation"]' ELSE '[]' END AS topics FROM documents""",
    "pay_rates": """
      SELECT p_partkey AS page_id, r.pos, r.classification, r.amount, r.period FROM (SELECT p_partkey, unnest([
        {'pos': 0, 'classification': p_name, 'amount': round(p_retailprice, 2)::DOUBLE, 'period': 'hour'},
        {'pos': 1, 'classification': 'Level ' || p_size, 'amount': (p_size || '.5')::DOUBLE, 'period': 'week'},
        {'pos': 2, 'classification': 'senior)', 'amount': p_size::DOUBLE, 'period': 'annum'}]) AS r FROM part)""",
    "award_page_payloads": """
      SELECT p_partkey AS page_id,
        'https://awards.example.org/' || p_partkey || CASE WHEN pdf THEN '.PDF' ELSE '' END AS url,
        CASE WHEN NOT pdf THEN 'Award ' || p_partkey END AS title,
        CASE WHEN pdf THEN 'pdf' ELSE 'html' END AS document_type,
        'Rates from July. ' || p_name || ' $' || p_retailprice::DECIMAL(12, 2) || ' per hour' || chr(10)
          || 'Level ' || p_size || ' - $' || p_size || '.5 PER  week; Casual: $1,234.50 per hour' || chr(10)
          || p_brand || chr(10) || '(senior):$' || p_size || ' per annum' AS raw_text_excerpt
      FROM (SELECT *, p_type IN ('ECONOMY', 'SMALL', 'STANDARD') AS pdf FROM part)""",
    "embedding_cache_fill": """
      SELECT vec_id::VARCHAR AS record_id, len(embedding) AS n_values, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings
      UNION ALL
      SELECT doc_id::VARCHAR, 2, length(text)::DOUBLE FROM documents ANTI JOIN embeddings ON vec_id = doc_id""",
    "record_chunks": f"""
      WITH w AS (SELECT doc_id::VARCHAR AS record_id, [x FOR x IN string_split_regex(text, '\\s+') IF x <> ''] AS words FROM documents),
      c AS (SELECT record_id, words, unnest(range(greatest(len(words) - {CHUNK_SIZE - CHUNK_STEP} - 1, 0) // {CHUNK_STEP} + 1)) AS chunk_no
            FROM w WHERE len(words) > 0)
      SELECT record_id, chunk_no, array_to_string(words[chunk_no * {CHUNK_STEP} + 1 : chunk_no * {CHUNK_STEP} + {CHUNK_SIZE}], ' ') AS chunk FROM c""",
    "answers_with_shared_ids": f"""
      WITH {HITS}, shared AS (
        SELECT doc_id, {record_key("source", "NULL")} AS shared_id, title, url, sha256(concat_ws(chr(31), source, title, description,
          coalesce(eligibility, ''), amount, coalesce(deadline, ''), url)) AS mark FROM records),
      ranked AS (
        SELECT question_id, shared_id, title, url, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, shared_id, mark) AS rank
        FROM scored JOIN shared USING (doc_id))
      SELECT question_id, rank, shared_id AS record_id, title, url FROM ranked WHERE rank <= 5""",
    "chunk_retrieve_topk": f"""
      WITH {QUESTIONS},
      w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '\\s+') IF x <> ''] AS words FROM documents),
      c AS (SELECT doc_id, words, unnest(range(greatest(len(words) - {CHUNK_SIZE - CHUNK_STEP} - 1, 0) // {CHUNK_STEP} + 1)) AS chunk_no
            FROM w WHERE len(words) > 0),
      qw AS (
        SELECT question_id, term, count(*) AS q_count, count(*) OVER (PARTITION BY question_id) AS n_distinct
        FROM (SELECT question_id, unnest({WORDS.format("text")}) AS term FROM questions) GROUP BY question_id, term),
      cw AS (
        SELECT doc_id, chunk_no, term, count(*) AS t_count FROM (
          SELECT doc_id, chunk_no, unnest({WORDS.format(f"array_to_string(words[chunk_no * {CHUNK_STEP} + 1 : chunk_no * {CHUNK_STEP} + {CHUNK_SIZE}], ' ')")}) AS term
          FROM c) GROUP BY ALL),
      s AS (
        SELECT question_id, doc_id, chunk_no, sum(q_count * t_count)::DOUBLE / any_value(n_distinct) AS score
        FROM qw JOIN cw USING (term) GROUP BY ALL),
      best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY score DESC, chunk_no) = 1)
      SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id::VARCHAR AS record_id,
        doc_id AS ord, score, chunk_no FROM best QUALIFY rank <= 5""",
    "cosine_guards": f"""
      WITH {CENTROIDS} SELECT vec_id, CASE label % 4 WHEN 3 THEN round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) ELSE 0.0 END AS score
      FROM embeddings JOIN centroids USING (label)""",
    "raw_zone_files": f"""
      WITH {FIELDS}, n AS ({NORMALIZED["ato"]})
      SELECT CASE WHEN lang = 'fr' THEN {record_key("'ato'", "NULL")} ELSE record_id END AS record_id,
        CASE WHEN lang <> 'fr' THEN n.title END AS title, CASE WHEN lang <> 'fr' THEN n.url END AS url, ingested_at
      FROM n JOIN fields USING (doc_id)""",
    "job_report": f"""
      WITH {FIELDS}, n AS ({ALL_NORMALIZED}), counts AS (
        SELECT source, count(*) AS n_records, count(DISTINCT record_id) AS n_current FROM n GROUP BY source)
      SELECT source, '2026-11-02' AS run_date, stage, 'ok (' || n_records || ' records)' AS status, n_records, n_current, n_records AS n_processed
      FROM counts, (VALUES ('ingest'), ('process')) v(stage)""",
    "snapshot_upsert": f"""
      WITH {FIELDS}, n AS ({NORMALIZED["grantconnect"]})
      SELECT record_id, CASE WHEN length(description) >= 1000 THEN 'Crawl 2: ' ELSE '' END || title AS title, url FROM n""",
}
ORACLES["answer_questions_embedding"] = ORACLES["answer_questions_table"].replace(HITS, EMBEDDED_HITS)
ORACLES["award_documents_of_both_kinds"] = f"""
  SELECT page_id, url, title, 'html' AS document_type, nullif(substr(text, 1, 2000), '') AS raw_text_excerpt
  FROM pages JOIN ({ORACLES["page_title"]}) USING (page_id) JOIN ({ORACLES["page_text_lines"]}) USING (page_id)
  UNION ALL
  SELECT doc_id, 'https://awards.example.org/' || doc_id || '.PDF', NULL, 'pdf', nullif(substr(text, 1, 2000), '') FROM documents"""
CRAWL = """
  links AS (
    SELECT p_partkey // 25 AS page_no, p_partkey AS key FROM part
    UNION ALL SELECT p_partkey // 25 + 1, p_partkey FROM part WHERE p_partkey % 25 = 0)"""
ORACLES["crawl_order"] = f"""
  WITH {CRAWL}, named AS (SELECT page_no, 'https://www.grants.gov.au/Go/Show?GoUuid=' || key AS url FROM links)
  SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY url) AS position, url FROM named"""
ORACLES["ingest_grantconnect"] = f"""
  WITH {CRAWL}
  SELECT 'https://www.grants.gov.au/Go/Show?GoUuid=' || key AS url, 'Part' || key AS title, p_name AS agency, p_type AS category,
    p_size || ' May 2027' AS closing_date, '$' || p_size AS estimated_value
  FROM links JOIN part ON p_partkey = key WHERE key % 7 <> 0"""
ORACLES["ingest_ato"] = """
  SELECT 'https://www.ato.gov.au/businesses-and-organisations/small-business/' || doc_id AS url, 'Guide ' || doc_id AS title,
    'Last word' AS overview, CASE WHEN lang = 'de' THEN '["payg","superannuation"]' ELSE '[]' END AS topics
  FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id::VARCHAR) <= 10"""
