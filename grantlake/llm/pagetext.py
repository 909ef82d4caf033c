"""Main text of pages: lines in their place, differenced against the page with the nearest URL of the same host."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import broadcast_if_small, cut, filed, running_totals
from grantlake.session import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br td th".split()
)
# Elements that never hold main text (a form: unless most of it), and words of class, id and role that say so.
JUNK_TAGS = frozenset(
    "head script style noscript template svg math iframe object canvas audio video nav footer aside form button select "
    "textarea input dialog menu".split()
)
JUNK_WORDS = frozenset(
    "ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification popup modal newsletter subscribe subscription sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus reply replies share sharing social "
    "related recommended widget login signup search contentinfo complementary alert".split()
)
MAIN_TAGS = frozenset(("article", "main"))
# Where a line stands.
OUTSIDE, INSIDE, HEADLINE = 0, 1, 2
# Start tags that end an open paragraph-like element of these.
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr"}
# A pair that shares more of a page's own words than this holds copies, which say nothing about boilerplate.
COPY_SHARE = 0.8
KEY = ["key_id", "key_text"]


class Lines(HTMLParser):
    """The blocks of a page in order as (pieces, place); junk elements are left out. The place is OUTSIDE or INSIDE the article
    or main element, or HEADLINE for an h1 inside.

    A class, id or role with a junk word and a form only mark what is below them: a piece of text is (mark, text), and
    `kept_lines` decides, once the whole page is read, which marks hold. Mark 0 is none.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, in junk, in main, innermost mark
        self.lines: list[tuple[list[tuple[int, str]], int]] = []
        self.text: list[tuple[int, str]] = []
        self.above = [0]  # the mark around each mark
        self.in_main = False

    def flush(self) -> None:
        if self.text:
            headline = self.in_main and any(x[0] == "h1" for x in self.open)
            self.lines.append((self.text, HEADLINE if headline else INSIDE if self.in_main else OUTSIDE))
            self.text = []

    def state(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, 0)

    def pop_to(self, at: int) -> None:
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "td", "th"):
            self.text.append((0, " "))
        if tag not in INLINE:
            self.flush()
        if tag == "body":
            self.open = [x for x in self.open if x[0] not in ("head", "title")]
        if tag in CLOSED_BY or tag in ("div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"):
            ends = CLOSED_BY.get(tag, "p").split()
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ends:
                    self.pop_to(at)
                    break
                if name not in INLINE:
                    break
        if tag in VOID:
            return
        junk, main, mark = self.state()
        if tag in MAIN_TAGS and not junk:
            main = True
        elif tag != "form" and tag in JUNK_TAGS or tag == "header" and not main:
            junk = True
        if not junk and tag not in ("html", "body") and (attrs or tag == "form"):
            values = dict(attrs)
            said = " ".join(values.get(name) or "" for name in ("class", "id", "role")).lower()
            words = "".join(c if c.isalnum() else " " for c in said).split()
            junk = "hidden" in values and tag not in MAIN_TAGS
            # An article below a mark may be a comment or the like, which its own words say.
            if not junk and (tag == "form" or not JUNK_WORDS.isdisjoint(words)) and (tag not in MAIN_TAGS or mark):
                self.above.append(mark)
                mark = len(self.above) - 1
        self.open.append((tag, junk, main, mark))
        self.in_main = main

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                break
            if tag in INLINE and self.open[at][0] not in INLINE:
                break
        self.in_main = self.state()[1]

    def handle_data(self, data: str) -> None:
        junk, _, mark = self.state()
        if not junk:
            self.text.append((mark, data))

    def kept_lines(self) -> list[tuple[str, int]]:
        """The lines without text below marks that hold.

        A mark does not hold if most of the page's article words are below it; on a page without any, most of all words.
        """
        dropped = [False] * len(self.above)
        if len(self.above) > 1:
            below = [[0] * len(self.above) for _ in range(2)]
            for pieces, main in self.lines:
                for mark, text in pieces:
                    below[main != OUTSIDE][mark] += len(text.split())
            counted = below[1] if any(below[1]) else below[0]
            # A mark comes after the one around it.
            for mark in range(len(self.above) - 1, 0, -1):
                counted[self.above[mark]] += counted[mark]
            for mark in range(1, len(self.above)):
                dropped[mark] = dropped[self.above[mark]] or 2 * counted[mark] <= counted[0]
        lines = ((" ".join("".join([text for mark, text in pieces if not dropped[mark]]).split()), main) for pieces, main in self.lines)
        return [line for line in lines if line[0]]


def page_lines(html: str | None) -> list[tuple[str, int]]:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.kept_lines()


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes in `a` of a longest common subsequence of both."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner = _common(a[low : len(a) - high], b[low : len(b) - high])
    return [*range(low), *[low + i for i in inner], *range(len(a) - high, len(a))]


def _common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of `a` and each prefix of `b`; one operation on a number of len(b) bits a line of `a`."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    free = whole
    for x in a:
        found = free & places.get(x, 0)
        free = (free + found | free - found) & whole
    bits = np.unpackbits(np.frombuffer(free.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int]) -> list[int]:
    """Halves `a`, and splits `b` where the halves have most in common with its parts; takes memory in proportion to the lines."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    half = len(a) // 2
    split = int((_common_lengths(a[:half], b) + _common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _common(a[:half], b[:split]) + [half + i for i in _common(a[half:], b[split:])]


def _listed(pages: DataFrame, with_text: bool) -> DataFrame:
    """Each page's key and line hashes with weights (words), or its packed lines."""
    schema = "page_id long, url string, key_id long, key_text long, "
    schema += "lines binary, main array<tinyint>" if with_text else "hashes array<long>, words array<int>, main array<tinyint>"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
                found = [page_lines(html) for html in part.column("html").to_pylist()]
                own = [part.column(c) for c in ("page_id", "url", "key_id", "key_text")]
                if with_text:
                    packed = [zlib.compress("\n".join(text for text, _ in lines).encode(), 6) for lines in found]
                    own.append(pa.array(packed, pa.binary()))
                else:
                    hashes = [[xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in lines] for lines in found]
                    own += [pa.array(hashes, pa.list_(pa.int64())), pa.array([[text.count(" ") + 1 for text, _ in lines] for lines in found], pa.list_(pa.int32()))]
                own.append(pa.array([[m for _, m in lines] for lines in found], pa.list_(pa.int8())))
                yield pa.RecordBatch.from_arrays(own, [f.split()[0] for f in schema.split(", ")])

    key_id = F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("key_id")
    key_text = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")), F.col("page_id").isNull(), F.col("url").isNull())
    page_id = F.col("page_id").cast("long").alias("page_id")
    return bound_batches(pages.select(page_id, "url", "html", key_id, key_text.alias("key_text"))).mapInArrow(listed, schema)


def frequent_lines(classes: DataFrame) -> DataFrame:
    """`host, frequent`: the line hashes that more than half of a host's different pages have, three of them at least."""
    sizes = classes.groupBy("host").agg(F.count("*").alias("n_pages"))
    each = classes.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = each.where("n > 2").join(broadcast_if_small(sizes, sizes.count()), "host").where("2 * n > n_pages")
    return often.groupBy("host").agg(F.collect_list("line").alias("frequent"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """`key_id, key_text, shared`: the indexes of each page's lines that its nearest page has in the same order.

    Pages are ordered by host, path and page_id over all partitions; neighbours of a host with equal lines are one run.
    Of the two runs beside it in its host, a run is compared first with the one whose path agrees longer with its own (the
    earlier one if equal); without another run in the host `shared` is null.
    """
    listed = _listed(pages, False)
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    arrays = ["hashes", "words", "main"]
    once = listed.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("page_id", "url", *arrays)])
    named = filed(once.select(*KEY, "page_id", host.alias("host"), path.alias("path"), F.xxhash64("hashes", "main").alias("lines"), *arrays), "lines")
    classes = filed(named.groupBy("host", "lines").agg(*[F.first(c).alias(c) for c in arrays]), "lines")
    order = [F.col("host"), F.col("path"), F.col("page_id").asc_nulls_last(), F.col("key_text")]
    placed = cut(running_totals(named.drop(*arrays), order, {"place": F.lit(1)}))
    earlier = placed.select((F.col("place") + 1).alias("place"), F.struct("host", "lines").alias("earlier"))
    starts = placed.join(earlier, "place", "left").withColumn("starts", (~F.col("earlier").eqNullSafe(F.struct("host", "lines"))).cast("int"))
    numbered = running_totals(starts.drop("earlier"), [F.col("place")], {"run": F.col("starts")})
    placed = cut(numbered.withColumn("run", F.col("run") + F.col("starts")).drop("starts"))
    ends = [F.min_by("path", "place").alias("first_path"), F.max_by("path", "place").alias("last_path")]
    runs = filed(placed.groupBy("run").agg(F.first("host").alias("host"), F.first("lines").alias("lines"), *ends).join(classes, ["host", "lines"]), "lines")
    frequent = cut(frequent_lines(classes))
    n_frequent = frequent.agg(F.count("*") + F.coalesce(F.sum(F.size("frequent")), F.lit(0))).first()[0]
    beside = [
        runs.select((F.col("run") + step).alias("run"), F.struct("host", F.col(path).alias("path"), "hashes").alias(name))
        for step, path, name in ((1, "last_path", "before"), (-1, "first_path", "after"))
    ]
    rows = runs.join(beside[0], "run", "left").join(beside[1], "run", "left").join(broadcast_if_small(frequent, n_frequent), "host", "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [_shared(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(shared, pa.list_(pa.int32()))], ["run", "shared"])

    found = bound_batches(rows.drop("lines")).mapInArrow(compare, "run long, shared array<int>")
    return placed.select(*KEY, "run").join(found, "run").drop("run")


def _agreement(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _shared(row: dict) -> list[int] | None:
    """The indexes of a page's lines that go, null where its host has no other page to compare with."""
    beside = [(row[name], path) for name, path in (("before", row["first_path"]), ("after", row["last_path"]))]
    beside = [(other, path) for other, path in beside if other and other["host"] == row["host"]]
    if not beside:
        return None
    hashes, words, main = row["hashes"], row["words"], row["main"]
    frequent, article = set(row["frequent"] or ()), any(main)
    usual = [h in frequent for h in hashes]
    nearest = sorted(beside, key=lambda x: -_agreement(x[0]["path"], x[1]))
    if article:
        common: set[int] = set()
        for other, _ in nearest:
            common.update(common_lines(hashes, other["hashes"]))
        return _gone_around_article(words, main, usual, common)
    own = [0 if u else n for n, u in zip(words, usual)]
    certain: list[int] = []
    for other, _ in nearest:
        common_here = common_lines(hashes, other["hashes"])
        if sum(own[i] for i in common_here) <= COPY_SHARE * sum(own):
            return common_here
        certain = certain or [i for i in common_here if usual[i]]
    return certain


def _gone_around_article(words: list[int], main: list[int], usual: list[bool], common: set[int]) -> list[int]:
    """Of a page with an article: the lines outside, and those at its ends that both a neighbour and most of the host's pages have.

    A line between two that are the article's own stays, and so does the headline. Lines outside stay, but for shared ones,
    only if those nothing else has are more words than the article: it is then not where the page's text is.
    """
    inside = [i for i, m in enumerate(main) if m]
    outside = [i for i, m in enumerate(main) if not m]
    body = sum(words[i] for i in inside)
    if sum(words[i] for i in inside if usual[i]) > COPY_SHARE * body:
        # Hardly a word is the article's own: copies of one article fill the host, which are no template.
        usual = [False] * len(main)
    own = [i for i in inside if not (usual[i] and i in common) or main[i] == HEADLINE]
    text = [i for i in own if main[i] != HEADLINE] or own
    ends = [i for i in inside if i not in set(own) and not text[0] < i < text[-1]] if text else []
    if sum(words[i] for i in outside if not usual[i] and i not in common) > body:
        outside = [i for i in outside if i in common]
    return sorted(outside + ends)


def main_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text` for every row of `pages`.

    Lines are blocks in page order, with white space made single spaces; those in menus, forms, adverts and the like are
    left out. On a page without an article or main element what the nearest page shares is deleted and nothing else; where the
    pages beside are copies, only what most of the host's different pages have. On a page with one, `_gone_around_article`
    says what goes. On a page without another one in its host, the article's lines are the text. Null html is empty.
    Repeated rows are one page when pairing, and each is returned.
    """
    joined = _listed(pages, True).join(shared_lines(pages), KEY)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lines", "main", "shared")]
            texts = []
            for packed, main, shared in zip(*columns):
                lines = zlib.decompress(packed).decode().split("\n")
                if shared is None:
                    # No page to compare with: structure is all there is.
                    shared = [i for i, m in enumerate(main) if not m] if any(main) else []
                gone = set(shared)
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return bound_batches(joined).mapInArrow(assemble, "page_id long, url string, text string")
