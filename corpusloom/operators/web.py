"""Stored web pages: links, text, chunks, context."""

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.folds import append_if, collecting_fold
from corpusloom.functions.rows import explode_once
from corpusloom.functions.text import bind, count_tokens, line_breaks_to_space
from corpusloom.operators.graph import within_depth
from corpusloom.operators.search import pack_context

CHUNK_TOKENS = 500  # fixed value: tokens per passage
NEEDS_SCRIPT = "You need to enable JavaScript to run this app."  # fixed value


def unescape(text: Column) -> Column:
    """Named and numeric character references as characters."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (f"&{n};", chr(c))])

    def numeric(token: Column) -> Column:
        hexa = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        deci = F.regexp_extract(token, r"^&#([0-9]{1,7});$", 1)
        digits = F.when(hexa != "", hexa).when(deci != "", F.hex(deci.cast("int")))
        return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    pieces = F.regexp_extract_all(text, F.lit(r"&#?\w{1,31};|[^&]+|&"), F.lit(0))
    decoded = F.transform(
        pieces,
        lambda t: F.when(t.startswith("&#") & t.endswith(";"), F.coalesce(numeric(t), t))
        .when(t.startswith("&"), F.coalesce(F.try_element_at(names, t), t))
        .otherwise(t),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def _visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, r"<!--[\s\S]*?-->", ""), r"(?i)<(script|style)\b[\s\S]*?</\1\s*>", "")


def hyperlinks(html: Column) -> Column:
    """Array of the href of every anchor outside comments, scripts and styles."""
    found = F.regexp_extract_all(
        _visible(html), F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1)
    )
    return F.transform(found, lambda h: unescape(F.regexp_replace(h, r"""^["']|["']$""", "")))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """W1 as rows: one per anchor."""
    carried = [c for c in pages.columns if c != html]
    return explode_once(pages, carried, hyperlinks(F.col(html)), "_at", "link").drop("_at")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def clean_link(link: Column, domain: Column) -> Column:
    """Absolute form of a link inside the domain; NULL for links out of it and for fragments and mail."""
    relative = F.concat(
        F.lit("https://"),
        domain,
        F.lit("/"),
        F.when(link.startswith("/"), F.substr(link, F.lit(2), F.length(link))).otherwise(link),
    )
    full = (
        F.when(link.rlike(r"^http[s]*://."), F.when(host_of(link) == domain, link))
        .when(link.startswith("#") | link.startswith("mailto:"), F.lit(None))
        .otherwise(relative)
    )
    return F.regexp_replace(full, "/$", "")


def domain_links(links: DataFrame, domain: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct links of the same domain per ``keys``."""
    return (
        links.select(*keys, clean_link(F.col("link"), domain).alias("link"))
        .filter(F.col("link").isNotNull())
        .distinct()
    )


def reachable_pages(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(source, url): pages reached from each ``source`` over links(src, dst), each once, the start included."""
    found = within_depth(links, starts, None).select("source", F.col("node").alias("url"))
    own = starts.select("source", F.col("source").alias("url"))
    return found.unionByName(own).distinct()


def html_to_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags, character references resolved."""
    return bind(F.regexp_replace(_visible(html), r"<[^>]*>", ""), unescape)


def needs_javascript(text: Column) -> Column:
    """The page only says that it needs a script engine."""
    return F.contains(text, F.lit(NEEDS_SCRIPT))


def clean_newlines(text: Column) -> Column:
    """W5."""
    return line_breaks_to_space(text)


def title_from_name(name: Column) -> Column:
    """File name without its first 11 and last 4 signs, dashes and underscores as spaces, no update mark."""
    core = F.substr(name, F.lit(12), F.greatest(F.length(name) - 15, F.lit(0)))
    return F.replace(F.translate(core, "-_", "  "), F.lit("#update"), F.lit(""))


def titled_text(name: Column, text: Column) -> Column:
    """Title, a stop, and the text on one line."""
    return F.concat(title_from_name(name), F.lit(". "), line_breaks_to_space(text))


def sentence_chunks(text: Column, max_tokens: int = CHUNK_TOKENS, strict: bool = False) -> Column:
    """Array of passages made of whole sentences within the budget; a sentence above the budget is left out.

    ``strict`` also loses the unfinished last passage and shows an empty one as a lone stop.
    """
    spans = "array<struct<first:int,n:int>>"
    zero = {n: F.lit(0) for n in ("i", "first", "n", "used")}

    def span(acc: Column) -> Column:
        return F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n")))

    def step(acc: Column, sentence: Column) -> Column:
        return bind(
            count_tokens(sentence),
            lambda cost: bind(
                acc["used"] + cost > max_tokens,
                lambda over: F.struct(
                    (acc["i"] + 1).alias("i"),
                    F.when(cost > max_tokens, acc["i"] + 1)
                    .when(over, acc["i"])
                    .otherwise(acc["first"])
                    .alias("first"),
                    (
                        F.when(over, F.lit(0)).otherwise(acc["n"])
                        + F.when(cost > max_tokens, F.lit(0)).otherwise(F.lit(1))
                    ).alias("n"),
                    (
                        F.when(over, F.lit(0)).otherwise(acc["used"])
                        + F.when(cost > max_tokens, F.lit(0)).otherwise(cost + 1)
                    ).alias("used"),
                    append_if(over & (F.lit(strict) | (acc["n"] > 0)), acc, span(acc))["done"].alias("done"),
                ),
            ),
        )

    def finish(acc: Column, done: Column) -> Column:
        return done if strict else F.when(acc["n"] > 0, F.concat(done, span(acc))).otherwise(done)

    def build(sentences: Column) -> Column:
        texts = F.transform(
            collecting_fold(sentences, zero, spans, step, finish),
            lambda s: F.array_join(F.slice(sentences, s["first"] + 1, s["n"]), ". "),
        )
        return F.transform(
            texts, lambda t: F.concat(t, F.lit(".")) if strict else F.concat(F.regexp_replace(t, r"\.$", ""), F.lit("."))
        )

    return bind(F.split(text, r"\. "), build)


def shorten(
    docs: DataFrame, max_tokens: int = CHUNK_TOKENS, text: str = "text", strict: bool = False
) -> DataFrame:
    """Passages of every document that is not NULL, tokens counted again; short documents pass whole."""
    carried = [c for c in docs.columns if c not in (text, "n_tokens")]
    passages = F.when(
        count_tokens(F.col(text)) > max_tokens, sentence_chunks(F.col(text), max_tokens, strict)
    ).otherwise(F.array(text))
    rows = explode_once(docs.filter(F.col(text).isNotNull()), carried, passages, "chunk", text)
    return rows.withColumn("n_tokens", count_tokens(F.col(text)))


# own wording of the question around a packed context
CONTEXT_PROMPT = (
    "Answer from the context; say \"I don't know\" when it does not tell.\n\nContext: %s\n\n---\n\nQuestion: %s\nAnswer:"
)


def context_prompt(
    ranked: DataFrame, questions: DataFrame, query_key: str = "query_id", key: str = "doc_id", max_len: int = 1800
) -> DataFrame:
    """Prompt per question from its ranked rows; a question without rows gets an empty context."""
    packed = pack_context(ranked, query_key, key, max_len=max_len)
    return (
        questions.select(query_key, "question")
        .join(packed, query_key, "left")
        .select(
            query_key,
            F.format_string(CONTEXT_PROMPT, F.coalesce("context", F.lit("")), F.col("question")).alias("prompt"),
        )
    )
