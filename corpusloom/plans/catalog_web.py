"""Registered queries: stored web pages."""

from pyspark.sql import functions as F

from corpusloom.functions.rows import explode_once
from corpusloom.operators import web as ops
from corpusloom.plans.catalog_search import PACKED, ranked_documents
from corpusloom.plans.derived import TOKEN_RE
from corpusloom.plans.registry import query, table

MAX_TOKENS = 60
# Every page also gets anchors that a reader never sees.
_UNSEEN = ("<!-- <a href=\"/unseen\">x</a> -->", "<script>var a = '<a href=\"/unseen\">x</a>';</script>")
_LINKS = r"""select url, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'),
    '<script[\s\S]*?</script>|<style[\s\S]*?</style>', '', 'g'), '<a[^>]*href="([^"]*)"', 1)) as link from pages"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _links(spark, sf_dir):
    html = F.concat(F.lit(_UNSEEN[0]), "html", F.lit(_UNSEEN[1])).alias("html")
    return ops.page_links(table(spark, sf_dir, "pages").select("url", html))


@query(_LINKS)
def hyperlinks(spark, sf_dir):
    return _links(spark, sf_dir)


_DOMAIN = f"""select distinct url, regexp_replace('https://' || {_HOST} || '/' || substr(link, 2), '/$', '') as link
    from ({_LINKS})"""


@query(_DOMAIN)
def domain_links(spark, sf_dir):
    return ops.domain_links(_links(spark, sf_dir), ops.host_of(F.col("url")), ("url",))


@query(
    f"""with recursive l as ({_DOMAIN}), r(source, url) as (select min(url), min(url) from pages group by {_HOST} union
    select r.source, l.link from r join l on l.url = r.url) select source, url from r"""
)
def reachable_pages(spark, sf_dir):
    links = ops.domain_links(_links(spark, sf_dir), ops.host_of(F.col("url")), ("url",))
    pages = table(spark, sf_dir, "pages")
    starts = pages.groupBy(ops.host_of(F.col("url"))).agg(F.min("url").alias("source")).select("source")
    return ops.reachable_pages(links.select(F.col("url").alias("src"), F.col("link").alias("dst")), starts)


_TEXT = r"""replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<!--[\s\S]*?-->', '', 'g'), '<script[\s\S]*?</script>', '', 'g'), '<style[\s\S]*?</style>', '', 'g'), '<[^>]*>', '', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')"""


@query(f"select page_id, {_TEXT} as text, contains(html, 'You need to enable JavaScript to run this app.') as needs_script from pages")
def html_to_text(spark, sf_dir):
    text = ops.html_to_text(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return rows.withColumn("needs_script", ops.needs_javascript(F.col("text")))


_CLEAN = r"replace(replace(replace(replace({}, chr(10), ' '), '\n', ' '), '  ', ' '), '  ', ' ')"


@query(f"select doc_id, {_CLEAN.format('text')} as text from documents")
def clean_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ops.clean_newlines(F.col("text")).alias("text"))


@query(
    f"""with n as (select page_id, replace(substr(url, 9), '/', '_') || '#update.txt' as name, {_TEXT} as text from pages),
    t as (select page_id, replace(replace(replace(substr(name, 12, length(name) - 15), '-', ' '), '_', ' '), '#update', '')
      as title, {_CLEAN.format('text')} as text from n)
    select page_id, title, title || '. ' || text as text from t"""
)
def page_titles(spark, sf_dir):
    name = F.concat(F.translate(F.expr("substr(url, 9)"), "/", "_"), F.lit("#update.txt"))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), ops.html_to_text(F.col("html")).alias("text"))
    return rows.select(
        "page_id", ops.title_from_name(F.col("name")).alias("title"), ops.titled_text(F.col("name"), F.col("text")).alias("text")
    )


_COUNT = f"len(regexp_extract_all({{}}, '{TOKEN_RE}'))"
_CHUNKED = f"""with recursive x as (select doc_id, string_split(text, '. ') as ss from documents),
    p as (select doc_id, unnest(range(1, len(ss) + 1)) as i, unnest(ss) as s from x),
    q as (select doc_id, i, s, {_COUNT.format('s')} as n from p),
    r(doc_id, i, used, cid) as (
      select doc_id, 0::bigint, 0::bigint, 0 from x union all
      select q.doc_id, q.i, (case when r.used + q.n > {MAX_TOKENS} then 0 else r.used end)
        + (case when q.n > {MAX_TOKENS} then 0 else q.n + 1 end), r.cid + (r.used + q.n > {MAX_TOKENS})::int
      from r join q on q.doc_id = r.doc_id and q.i = r.i + 1),
    g as (select doc_id, cid, regexp_replace(string_agg(s, '. ' order by i), '[.]$', '') || '.' as text
      from r join q using (doc_id, i) where n <= {MAX_TOKENS} group by 1, 2),
    c as (select doc_id, (row_number() over (partition by doc_id order by cid) - 1)::int as chunk, text from g)"""


@query(_CHUNKED + " select * from c")
def sentence_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return explode_once(docs, ["doc_id"], ops.sentence_chunks(F.col("text"), MAX_TOKENS), "chunk", "text")


@query(
    _CHUNKED
    + f""", w as (select doc_id, {_COUNT.format('text')} > {MAX_TOKENS} as long, text from documents),
    o as (select doc_id, 0 as chunk, text from w where not long union all
      select doc_id, chunk, c.text from c join w using (doc_id) where long)
    select doc_id, chunk, text, {_COUNT.format('text')}::int as n_tokens from o"""
)
def shorten(spark, sf_dir):
    return ops.shorten(table(spark, sf_dir, "documents").select("doc_id", "text"), MAX_TOKENS)


_HEAD, _MIDDLE, _TAIL = ("'" + p.replace("'", "''") + "'" for p in ops.CONTEXT_PROMPT.split("%s"))


@query(
    PACKED
    + f""" select query_id, {_HEAD} || coalesce(context, '') || {_MIDDLE} || 'about ' || query_id || {_TAIL} as prompt
    from (select distinct query_id from d) left join p using (query_id)"""
)
def context_prompt(spark, sf_dir):
    ranked = ranked_documents(spark, sf_dir)
    questions = ranked.select("query_id").distinct().withColumn("question", F.concat(F.lit("about "), "query_id"))
    return ops.context_prompt(ranked, questions)
