"""Column functions against small plain-Python counterparts."""

import hashlib
import random
import re
from collections import Counter
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from grantlake.functions import labels, payload
from grantlake.functions.html import decode_entities, fragments, page_text, title
from grantlake.functions.ids import record_id
from grantlake.functions.payrates import pay_rates
from grantlake.functions.text import excerpt, record_text, snippet, strip, tokens
from grantlake.functions.typed import amount_value, deadline_date
from grantlake.functions.urls import resolve
from grantlake.functions.vectors import cosine_similarity


def column(spark, values, expression, ddl="value string"):
    rows = [(i, v) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, f"i int, {ddl}").select("i", expression(F.col("value")).alias("out"))
    return [row.out for row in sorted(found.collect())]


def test_record_id(spark):
    keys = ["https://x/1", "", None, "ключ"]
    found = column(spark, keys, lambda c: record_id(F.lit("ato"), c))
    expected = ["ato#" + hashlib.sha256(f"ato:{k or ''}".encode()).hexdigest()[:24] for k in keys]
    assert found == expected
    assert found[1] == found[2]


def test_strip_and_tokens_match_python(spark):
    rng = random.Random(7)
    alphabet = "aB9 \t\n\x1c\x85  éİK_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    assert column(spark, texts, tokens) == [re.findall("[a-z0-9]+", t.lower()) for t in texts]


def test_record_text_skips_missing_parts(spark):
    row = spark.createDataFrame(
        [("T", "", None, "c", "")],
        "title string, description string, eligibility string, category string, state_or_territory string",
    )
    assert row.select(record_text()).first()[0] == "T c"


def test_snippet_and_excerpt_count_characters(spark):
    assert column(spark, ["é😀" * 200, "", None], snippet) == [("é😀" * 200)[:280], None, None]
    assert column(spark, ["x" * 2001, ""], excerpt) == ["x" * 2000, None]


@pytest.mark.parametrize(
    "question, expected",
    [
        ("Which grants am I eligible for", "eligibility"),
        ("What wage must be paid under Fair Work", "compliance"),
        ("Is there a grant, and which tax rules apply", "mixed"),
        ("Tell me about shops in Hobart", "mixed"),
        ("Can I get a refund", "eligibility"),
        ("Grants for a firm with 4 employees", "mixed"),
        ("", "mixed"),
    ],
)
def test_question_class(spark, question, expected):
    assert column(spark, [question], labels.question_class) == [expected]


def test_shorter_words_decide_for_longer_ones(spark):
    words = labels.COMPLIANCE_WORDS + labels.ELIGIBILITY_WORDS
    for side in (labels.COMPLIANCE_WORDS, labels.ELIGIBILITY_WORDS):
        found = column(spark, words, lambda c: labels.contains_any(c, side))
        assert found == [any(w in word for w in side) for word in words]


def test_topics_and_cascade(spark):
    text = "Registering for GST, recordkeeping and Super"
    assert column(spark, [text], labels.topic_labels) == [["gst", "record_keeping", "superannuation"]]
    found = column(spark, ["hire and tax", "payg", "shops"], labels.first_label)
    assert found == ["award_pay", "tax", "grants"]


def test_truthiness_of_payload_values(spark):
    values = ['""', "0", "0.0", "-0.0", "0e5", "false", "[]", "{}", "null", '"0"', "[null]", "true", "7", '"null"', '"[]"']
    rows = [(i, f'{{"v": {v}}}') for i, v in enumerate(values)] + [(len(values), "{}")]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("p"))
    found = [r.v for r in sorted(df.select("i", payload.truthy(F.col("p"), "$.v").alias("v")).collect())]
    assert found == [None] * 9 + ["0", "[null]", "true", "7", "null", "[]", None]


def test_entities_and_fragments(spark):
    texts = ["a &amp;lt; b", "&#39;x&#x2019;&#128512;", "&copy;&nbsp;", "&unknown; &amp", "plain"]
    expected = ["a &lt; b", "'x’\U0001f600", "©\xa0", "&unknown; &", "plain"]
    assert column(spark, texts, decode_entities) == expected
    html = '<p title="a>b">x &lt; y<!-- c -->z</p><script>var t="</p>q";</script>&nbsp;<b> w</b> 3 < 4'
    from grantlake.functions.html import visible

    assert column(spark, [html], lambda c: fragments(visible(c))) == [["x < y", "z", "w", "3", "<", "4"]]


def test_title_and_text(spark):
    pages = ["<h1> A <b>B</b></h1><h1>C</h1>", "<H1 class=x></H1>", "<p>none</p>", "<h1>open<p>x"]
    assert column(spark, pages, title) == ["AB", None, None, "openx"]
    assert column(spark, ["<title>T</title><p>a<b>b</b></p>"], page_text) == ["T\na\nb"]


def test_resolve_like_urljoin(spark):
    base = "https://www.example.org"
    hrefs = [
        "/a/b", "a", "a/../b", "/x/./y/../z?q=1#f", "../up", "//cdn.example.net/p", "http://other/x", "?page=2", "#top",
        "mailto:me@x.org", " /lead", "/a/b/..", "x.pdf?y=/../z", "javascript:go()",
    ]
    assert column(spark, hrefs, lambda c: resolve(c, F.lit(base))) == [urljoin(base, h) for h in hrefs]


RATE = re.compile(
    r"([A-Za-z][A-Za-z0-9 /()&\-]*?)\s*[-:]?\s*\$(\d+(?:\.\d{1,2})?)\s*per\s*(hour|week|annum|year)", re.IGNORECASE
)


def plain_rates(text):
    return [(c.strip(), float(a), p.lower()) for c, a, p in RATE.findall(text)]


def test_pay_rates(spark):
    fixed = [
        "Level 1 $24.10 per hour\nLevel 2: $25 per hour\nCasual $30.5 PER HOUR\nGrade 3 - $900.10 per week",
        "no rates here",
        "",
        "Level 4 $26.00 per hour",
        "Adult $1,234.50 per hour",
        "a $3 per years b $4 per hour",
    ]
    rng = random.Random(11)
    pieces = ["Level 3", " ", "-", ":", "$", "12.5", "per", "hour", "week", "\n", ".", "(b)", "9 ", " ", "x/y & z", " per hour", "$7 per week", "$12.5 per hour"]
    texts = fixed + ["".join(rng.choice(pieces) for _ in range(rng.randint(5, 60))) for _ in range(400)]
    found = [[tuple(r) for r in rates] for rates in column(spark, texts, pay_rates)]
    assert found == [plain_rates(t) for t in texts]
    assert sum(map(len, found)) > 30


def test_long_text_without_a_rate_is_linear(spark):
    assert column(spark, ["word " * 40_000 + "$"], pay_rates) == [[]]


def test_typed_fields(spark):
    assert [str(d) for d in column(spark, ["31 December 2026", "2026-11-30", "15 March 2027", "soon", None], deadline_date)] == [
        "2026-12-31", "2026-11-30", "2027-03-15", "None", "None",
    ]
    amounts = column(spark, ["$50,000", "Up to $10,000", "$25.41 per hour", "free", ""], amount_value)
    assert [None if a is None else float(a) for a in amounts] == [50000.0, 10000.0, 25.41, None, None]


def test_cosine_guards(spark):
    pairs = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<float>, b array<float>")
    found = [r.s for r in sorted(df.select("i", F.round(cosine_similarity(F.col("a"), F.col("b")), 9).alias("s")).collect())]
    assert found == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_counter_is_what_tokens_feed(spark):
    text = "Tax tax GST"
    assert Counter(column(spark, [text], tokens)[0]) == Counter({"tax": 2, "gst": 1})
