"""Page, card and link queries."""

from pyspark.sql import functions as F

from ..operators import pages as pg
from ..sources.tables import wide_table
from .cleaning import page_text
from .registry import PAGE_SPACE, entities, key60, model_input, preview, query

WORD_LINK = r"^/(\w+)$"
# The stored pages use their own markup; the same operators run on them with these selectors.
ANSWERS = {
    "title": "h1", "detail": "footer", "items": "article", "text": "p", "author": "h1", "votes": "h1",
    "comments": "footer",
}
CARDS = {"cards": ["article", ".ad"], "question": ["h2", "h1"], "page_question": ["title"], "preview": [".none", "p"]}


def strip(x):
    return f"regexp_replace({x}, '^{PAGE_SPACE}+|{PAGE_SPACE}+$', '', 'g')"


def bare(x):
    return entities(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')")


PARTS = r"""parts AS (SELECT page_id, url, html, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS h1,
  regexp_extract(html, '(?is)<article>.*?<p>(.*?)(?:<p>|</article>)', 1) AS first_p, regexp_extract(html, '(?is)<footer>(.*?)</footer>', 1) AS footer,
  regexp_extract(html, '(?is)<article>(.*)</article>', 1) AS article,
  regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)"""


@query("extract_answers", f"""WITH {PARTS}, t AS (SELECT *, {strip(bare('h1'))} AS question, {strip(bare('first_p'))} AS answer FROM parts)
SELECT page_id, question, {strip(bare('footer'))} AS question_detail, answer AS answer_full,
  CASE WHEN length(answer) > 200 THEN substring(answer, 1, 200) || '...' ELSE answer END AS answer_truncated, question AS author,
  coalesce(TRY_CAST(replace(regexp_extract(question, '[0-9,]+'), ',', '') AS BIGINT), 0) AS votes, 'zhihu' AS platform, url
FROM t WHERE question <> '' AND length(answer) >= 10""")
def extract_answers(spark, sf):
    found = pg.extract_answers(wide_table(spark, sf, "pages"), F.lit(""), ANSWERS)
    return found.select(
        "page_id", "question", "question_detail", "answer_full", "answer_truncated", "author", "votes", "platform", "url"
    )


@query("extract_cards", f"""WITH {PARTS}, t AS (SELECT page_id, url, {page_text('h1')} AS h1, {page_text('title')} AS title, {page_text('first_p')} AS p FROM parts),
c AS (SELECT page_id, url, 1 AS position, CASE WHEN length(h1) >= 4 THEN h1 ELSE title END AS question, {preview('p')} AS answer_preview FROM t WHERE length(p) >= 20)
SELECT *, {model_input('question', 'answer_preview')} AS model_input FROM c""")
def extract_cards(spark, sf):
    return pg.extract_cards(wide_table(spark, sf, "pages"), CARDS)


@query("broken_pages", "SELECT page_id, url, 'no page' AS error FROM pages WHERE html IS NULL")
def broken_pages(spark, sf):
    return pg.broken_pages(wide_table(spark, sf, "pages"))


@query("filter_post_like", f"""WITH {PARTS}, c AS (SELECT page_id, article AS inside FROM parts UNION ALL SELECT page_id, ad FROM parts
  UNION ALL SELECT page_id, footer FROM parts), t AS (SELECT page_id, {page_text('inside')} AS text, lower(inside) AS markup FROM c)
SELECT page_id, text FROM t WHERE length(text) >= 10 AND (regexp_matches(markup, '点赞|like|收藏|collect|评论|comment|分享|share|作者|author')
  OR (length(text) > 20 AND contains(markup, '<img')))""")
def filter_post_like(spark, sf):
    cards = pg.card_elements(wide_table(spark, sf, "pages"), ["article", ".ad", "footer"])
    return pg.filter_post_like(cards).select("page_id", "text")


@query("extract_detail_text", f"""WITH {PARTS}, t AS (SELECT page_id, {page_text('footer')} AS footer, {page_text('article')} AS article FROM parts)
SELECT page_id, CASE WHEN length(footer) > 50 THEN footer ELSE article END AS text FROM t""")
def extract_detail_text(spark, sf):
    found = pg.extract_detail_text(wide_table(spark, sf, "pages"), False, [".none", "footer", "article"])
    return found.select("page_id", "text")


LINKS = rf"""anchors AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS position FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a\s*>') AS l FROM pages)),
links AS (SELECT page_id, position, regexp_extract(regexp_extract(a, '(?is)href="([^"]*)"', 1), '{WORD_LINK}', 1) AS link_id,
  substring({strip(bare('a'))}, 1, 200) AS title FROM anchors),
firsts AS (SELECT * FROM links WHERE link_id <> '' QUALIFY row_number() OVER (PARTITION BY page_id, link_id ORDER BY position) = 1)"""


def links(spark, sf):
    return pg.extract_links(wide_table(spark, sf, "pages"), WORD_LINK, "https://example.com/")


@query("extract_links", f"WITH {LINKS} SELECT page_id, link_id, position, 'https://example.com/' || link_id AS url, title FROM firsts")
def extract_links(spark, sf):
    return links(spark, sf)


@query("build_link_frontier", f"""WITH {LINKS}, f AS (SELECT link_id, title, page_id, position FROM firsts
  QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY page_id, position) = 1)
SELECT link_id, 'https://example.com/' || link_id AS url, title FROM f
ORDER BY {key60("'42|' || link_id")}""")
def build_link_frontier(spark, sf):
    return pg.build_link_frontier(links(spark, sf))


