"""Answers, cards, detail texts and links from stored pages (page_id, url, html)."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.regions import find_regions
from .ordering import first_per_key, hash_key
from .stages import computed, filter_computed


def _strip(c: Column) -> Column:
    return F.regexp_replace(
        F.coalesce(c, F.lit("")), rf"\A[{fv.PAGE_SPACE}]+|[{fv.PAGE_SPACE}]+\z", ""
    )


def _parsed(pages: DataFrame, regions: Column, keep: list[str] | None = None) -> DataFrame:
    """The pages' columns with their regions ``r``. A page is parsed once; filters on other columns reach the scan."""
    return computed(pages.select("page_id", "url", *(keep or []), "html"), {"r": regions}).drop("html")


def _first(regions: Column) -> Column:
    return F.try_element_at(regions, F.lit(1))


def extract_answers(pages: DataFrame, collected_at: Column, selectors=None) -> DataFrame:
    """Raw answers of question pages. Pages without a title give none; texts under 10 characters go."""
    s = fv.ANSWER_PAGE if selectors is None else selectors
    regions = find_regions(
        F.col("html"), {"title": [s["title"]], "detail": [s["detail"]]}, [s["items"]],
        {name: [s[name]] for name in ("text", "author", "votes", "comments")},
    )
    text = lambda field: _strip(_first(F.col(field))["text"])
    found = (
        _parsed(pages, regions)
        .select(
            "page_id", "url",
            text("r.page.title").alias("question"),
            text("r.page.detail").alias("question_detail"),
            F.posexplode("r.items").alias("position", "item"),
        )
        .filter(F.col("question") != "")
    )
    author = _first(F.col("item.author"))
    named = _strip(F.coalesce(F.nullif(author["text"], F.lit("")), author["content"]))
    long_enough = _first(F.col("item.text")).isNotNull() & (F.length("answer_full") >= fv.MIN_RAW_ANSWER_CHARS)
    return (
        filter_computed(found.withColumn("answer_full", text("item.text")), long_enough, ["answer_full"])
        .select(
            "page_id", "position", "question", "question_detail", "answer_full",
            tx.truncate_legacy(F.col("answer_full")).alias("answer_truncated"),
            F.when(author.isNull(), F.lit(fv.ANONYMOUS_AUTHOR)).otherwise(named).alias("author"),
            tx.parse_count(text("item.votes")).alias("votes"),
            tx.parse_comment_count(text("item.comments")).alias("comment_count"),
            F.lit(fv.DEFAULT_PLATFORM).alias("platform"),
            "url",
            collected_at.cast("string").alias("collected_at"),
        )
    )


def first_long_enough(candidates: Column, n: int) -> Column:
    return F.try_element_at(F.filter(candidates, lambda c: F.length(c) >= n), F.lit(1))


def extract_cards(pages: DataFrame, selectors=None, keep: list[str] | None = None) -> DataFrame:
    """Candidate cards with question and preview; ``keep`` names more columns of the pages to go with them.

    question: the first selector whose text has 4 characters, else the page title; preview: the first
    selector whose visible text has 20. Cards without a preview of 20 characters go.
    """
    s = fv.CARD_PAGE if selectors is None else selectors
    regions = find_regions(
        F.col("html"), {"question": s["page_question"]}, s["cards"], {"question": s["question"], "preview": s["preview"]}
    )
    texts = lambda field, part: F.transform(F.col(field), lambda r: tx.page_space(r[part]))
    own = ["page_id", "url", *(keep or [])]
    found = _parsed(pages, regions, keep).select(
        *own, _first(F.col("r.page.question"))["text"].alias("title"), F.posexplode("r.items").alias("position", "card"),
    )
    preview = tx.build_preview(first_long_enough(texts("card.preview", "visible"), 20))
    question = F.coalesce(first_long_enough(texts("card.question", "text"), 4), tx.page_space(F.col("title")))
    return (
        found.select(*own, "position", question.alias("question"), preview.alias("answer_preview"))
        .transform(lambda d: filter_computed(d, F.length("answer_preview") >= 20, ["question", "answer_preview"]))
        .withColumn("model_input", tx.build_model_input(F.col("question"), F.col("answer_preview")))
    )


def card_elements(pages: DataFrame, selectors=None) -> DataFrame:
    """The second platform's candidate elements with visible text and lower-cased markup."""
    regions = find_regions(F.col("html"), scope=fv.POST_CARDS if selectors is None else selectors, element=True)
    return _parsed(pages, regions).select("page_id", "url", F.posexplode("r.items").alias("position", "card")).select(
        "page_id", "url", "position", tx.page_space(F.col("card.self.visible")).alias("text"),
        F.col("card.self.markup").alias("markup"),
    )


def filter_post_like(cards: DataFrame, text: str = "text", markup: str = "markup") -> DataFrame:
    """Cards of 10 characters that carry a signal word, or of more than 20 that carry a picture."""
    html = F.lower(markup)
    signal = html.rlike("|".join(fv.POST_SIGNALS)) | ((F.length(text) > 20) & html.contains("<img"))
    return filter_computed(cards, (F.length(text) >= 10) & signal, [text, markup])


def broken_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, error) of the pages that give no answers, cards or texts because they are null or can't be parsed."""
    parsed = _parsed(pages.withColumn("_none", F.col("html").isNull()), find_regions(F.col("html"), {"body": ["body"]}), ["_none"])
    error = F.when(F.col("_none"), F.lit("no page")).otherwise(F.col("r.error"))
    return parsed.select("page_id", "url", error.alias("error")).filter(F.col("error").isNotNull())


def is_detail_page(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    return path.contains("/explore/") | query.contains("noteId")


def extract_detail_text(pages: DataFrame, detail_only: bool = True, selectors=None) -> DataFrame:
    """The first content region of more than 50 characters, else the whole body; null for a page that is null or broken."""
    chosen = fv.DETAIL_REGIONS if selectors is None else selectors
    regions = find_regions(F.col("html"), {"region": chosen, "body": ["body"]})
    wanted = pages.filter(is_detail_page(F.col("url"))) if detail_only else pages
    texts = F.transform(F.col("p.region"), lambda r: tx.page_space(r["visible"]))
    body = tx.page_space(_first(F.col("p.body"))["visible"])
    return _parsed(wanted, regions).select("page_id", "url", F.col("r.page").alias("p")).select(
        "page_id", "url", F.when(F.col("p").isNotNull(), F.coalesce(first_long_enough(texts, 51), body)).alias("text")
    )


def extract_links(
    pages: DataFrame, pattern: str = fv.QUESTION_LINK, prefix: str = fv.QUESTION_URL,
    title_chars: int = fv.LINK_TITLE_CHARS,
) -> DataFrame:
    """Links whose address matches, the first per id and page. The pattern's group is the id.

    Repeats are dropped inside the page's own array after sorting it by (id, position): no shuffle.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href\s*=[^>]*>.*?</a\s*>"), 0)
    quoted = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    address = lambda a: F.concat(*[F.regexp_extract(a, quoted, i) for i in (1, 2, 3)])
    link = F.transform(
        anchors,
        lambda a, i: F.struct(
            F.regexp_extract(address(a), pattern, 1).alias("link_id"),
            i.alias("position"),
            a.alias("anchor"),
        ),
    )
    ordered = F.array_sort(F.filter(link, lambda x: x["link_id"] != ""))
    first = F.filter(
        F.col("links"),
        lambda x, i: (i == 0) | (F.get(F.col("links"), i - 1)["link_id"] != x["link_id"]),
    )
    title = F.regexp_replace("l.anchor", "(?s)<[^>]*>", "")
    return (
        pages.select("page_id", ordered.alias("links"))
        .select("page_id", F.explode(first).alias("l"))
        .select(
            "page_id", "l.link_id", "l.position",
            F.concat(F.lit(prefix), F.col("l.link_id")).alias("url"),
            F.substring(_strip(tx.decode_entities(title)), 1, title_chars).alias("title"),
        )
    )


def build_link_frontier(links: DataFrame, cap: int | None = None, seed=42) -> DataFrame:
    """Links of all pages, the first title per id, in seeded order; with ``cap`` that many ids by first sight."""
    seen = links.withColumn("_seen", F.struct("page_id", "position"))
    firsts = first_per_key(seen, ["link_id"], "_seen")
    return (
        (firsts if cap is None else firsts.orderBy("_seen", "link_id").limit(cap))
        .orderBy(hash_key(seed, F.col("link_id")), "link_id")
        .select("link_id", "url", "title")
    )
