"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions import urls
from quarrylight.functions.text import normalize_title
from quarrylight.operators.similar import similar_titles
from quarrylight.plans.common import any_of, below, table
from quarrylight.sources.html import content_hash, hrefs_of, parse_html, title_of
from quarrylight.sources.search import paid_seeds

HOST = r"lower(regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)', 2))"
PATH = r"lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1))"
QUERY = r"regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1)"
#: Domains with a configured trust, the most specific last.
DOMAINS = {"example.org": 70, "example.net": 55, "spam-farm.example.org": 20, "cheap-pills.example.com": 10}


def page_url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


_tracking = ", ".join(repr(k) for k in rules.TRACKING_KEYS)
PAGE_URL = rf"""WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, {HOST} AS h,
regexp_replace(coalesce(nullif(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), ''), '/'), '/{{2,}}', '/', 'g') AS path,
array_to_string(list_sort(list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_tracking}) AND NOT starts_with(lower(x), 'utm_'))), '&') AS q FROM pages)
SELECT page_id, coalesce(nullif(s, ''), 'https') || '://' || h || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normalized FROM p"""


def page_host_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust in a page's host: its longest suffix in a table of domains, by an equi-join
    on suffixes (the table is configuration, a few rows)."""
    known = spark.createDataFrame([(d, t) for d, t in DOMAINS.items()], "suffix string, trust int")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))
    each = pages.select("page_id", "host", F.posexplode(urls.suffixes(F.col("host"))).alias("at", "suffix"))
    found = each.join(F.broadcast(known), "suffix").groupBy("page_id").agg(F.min_by("trust", "at").alias("trust"))
    return pages.join(found, "page_id", "left").select("page_id", "host", F.coalesce("trust", F.lit(rules.AUTHORITY["third_party"])).alias("trust"))


PAGE_AUTHORITY = f"SELECT page_id, {HOST} AS host, CASE " + " ".join(f"WHEN {below(HOST, (d,))} THEN {DOMAINS[d]}" for d in sorted(DOMAINS, key=len, reverse=True)) + " ELSE 50 END AS trust FROM pages"


def page_url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page under three addresses that its own is turned into."""
    turned = F.explode(F.array(F.col("url"), F.regexp_replace("url", "/(en|fr|de|es)/", "/news/2024/05/"), F.regexp_replace("url", "page=", "q="), F.regexp_replace("url", "/(en|fr|de|es)/", "/register/")))
    p = table(spark, sf_dir, "pages").select("page_id", turned.alias("url")).distinct()
    return p.select("page_id", "url", urls.is_registration_url(F.col("url")).alias("registration"), urls.is_listing_url(F.col("url")).alias("listing"), urls.is_news_url(F.col("url")).alias("news"))


PAGE_FLAGS = rf"""WITH u AS (SELECT DISTINCT page_id, unnest([url, regexp_replace(url, '/(en|fr|de|es)/', '/news/2024/05/', 'g'), replace(url, 'page=', 'q='), regexp_replace(url, '/(en|fr|de|es)/', '/register/', 'g')]) AS url FROM pages),
p AS (SELECT page_id, url, CASE WHEN ends_with({PATH}, '/') THEN {PATH} ELSE {PATH} || '/' END AS path, {QUERY} AS q FROM u)
SELECT page_id, url, {any_of('lower(url)', rules.REGISTRATION_MARKERS)} AS registration,
{any_of('path', rules.LISTING_MARKERS)} OR regexp_matches(lower(q), '(^|&)(q|query|search)=[^&]') AS listing, {any_of('path', rules.NEWS_MARKERS)} OR regexp_matches(path, '{rules.DATED_PATH}') AS news FROM p"""
HOSTS = ("www.facebook.com/groups", "facebook.com/login", "m.facebook.com", "bit.ly", "forms.gle", "devpost.com", "youtu.be", "l.instagram.com", "messenger.com", "kaggle.com")


def page_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How links of the pages may be shown, some moved to well-known hosts."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    moved = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace(F.col("url"), F.lit("^(https?://)[^/]*"), F.concat(F.lit("$1"), host)))
    p = table(spark, sf_dir, "pages").select("page_id", moved.alias("url"))
    return p.select("page_id", "url", urls.link_trust(F.col("url"), DOMAINS).alias("trust"))


_facebook = "(h = 'facebook.com' OR ends_with(h, '.facebook.com') OR ends_with(h, '.fbcdn.net'))"
_trust = "CASE " + " ".join(f"WHEN {below('h', (d,))} THEN {t}" for d, t in DOMAINS.items()) + f" WHEN h IN ({', '.join(repr(x) for x in rules.STRUCTURED_HOSTS)}) THEN 80 WHEN h IN ({', '.join(repr(x) for x in rules.SOCIAL_HOSTS)}) THEN 75 WHEN h IN ('forms.gle', 'docs.google.com') THEN 30 ELSE 50 END"
_sql_moved = f"CASE WHEN page_id % 3 = 0 THEN url ELSE regexp_replace(url, '^(https?://)[^/]*', '\\1' || list_extract([{', '.join(repr(x) for x in HOSTS)}], CAST(page_id % {len(HOSTS)} + 1 AS INTEGER))) END"
PAGE_TRUST = f"""WITH m AS (SELECT page_id, {_sql_moved} AS url FROM pages), p AS (SELECT page_id, url, {HOST} AS h, {PATH} AS path FROM m)
SELECT page_id, url, CASE WHEN NOT regexp_matches(lower(url), '^https?://') OR h = '' OR {below('h', rules.CHROME_HOSTS)} OR ends_with(h, '.fbcdn.net')
OR ({_facebook} AND ({' OR '.join(f'starts_with(path, {x!r})' for x in rules.CHROME_PATHS)})) OR {below('h', rules.OPAQUE_HOSTS)} THEN 'DROP'
WHEN {_facebook} THEN CASE WHEN {any_of('path', rules.FACEBOOK_PAGES)} THEN 'CLICKABLE' ELSE 'DROP' END
WHEN {below('h', rules.SHORTENERS)} THEN 'PLAIN' WHEN {_trust} >= 60 THEN 'CLICKABLE' WHEN {below('h', rules.FORM_HOSTS)} THEN 'CLICKABLE' ELSE 'PLAIN' END AS trust FROM p"""


def page_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and links of a page by pattern: a row a link."""
    p = table(spark, sf_dir, "pages").select("page_id", title_of(F.col("html")).alias("title"), hrefs_of(F.col("html")).alias("links"))
    return p.select("page_id", "title", F.posexplode("links").alias("position", "link"))


PAGE_LINKS = r"""WITH l AS (SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages),
u AS (SELECT page_id, title, unnest(links) AS link, generate_subscripts(links, 1) AS n FROM l), f AS (SELECT page_id, title, link, min(n) AS n FROM u GROUP BY page_id, title, link),
r AS (SELECT page_id, title, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS position, link FROM f) SELECT * FROM r WHERE position < 500"""


def page_rendered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address and the same path on two well-known hosts, as lines."""
    moved = [F.regexp_replace("url", "^(https?://)[^/]*", f"$1{host}") for host in ("bit.ly", "youtu.be")]
    return table(spark, sf_dir, "pages").select("page_id", urls.rendered_links(F.array("url", *moved), DOMAINS).alias("links"))


_label = r"regexp_replace(h, '([\\*_~`|\[\]])', '\\\1', 'g')"
PAGE_RENDERED = rf"""WITH p AS (SELECT page_id, url, {HOST} AS h FROM pages)
SELECT page_id, left(CASE WHEN {_trust} >= 60 OR {below('h', rules.FORM_HOSTS)} THEN '[' || {_label} || '](' || url || ')' ELSE '`' || url || '`' END
|| chr(10) || '`' || regexp_replace(url, '^(https?://)[^/]*', '\1bit.ly') || '` (shortened link)', 1024) AS links FROM p"""


def page_paid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as payloads of a search service with two results each, read back."""
    result = lambda url, title: F.struct(url.alias("url"), title.alias("title"), F.lit("x").alias("description"))
    both = F.array(result(F.col("url"), F.col("page_id").cast("string")), result(F.lit("ftp://x.test/"), F.lit("no")))
    payload = F.to_json(F.struct(F.struct(both.alias("results")).alias("web")))
    return paid_seeds(table(spark, sf_dir, "pages").select(F.col("page_id").alias("query"), payload.alias("payload"))).select("query", "rank", "url", "title", "snippet")


PAGE_PAID = "SELECT page_id AS query, CAST(0 AS INTEGER) AS rank, url, CAST(page_id AS VARCHAR) AS title, 'x' AS snippet FROM pages"


def page_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(urls.normalize_url(F.col("url"))).alias("addresses"))


PAGE_HOSTS = PAGE_URL.replace("SELECT page_id, coalesce(nullif(s", "SELECT h AS host, count(*) AS n, count(DISTINCT coalesce(nullif(s").replace("END AS normalized FROM p", "END) AS addresses FROM p GROUP BY h")


def page_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", content_hash(F.col("html")).alias("content_hash"))


PAGE_HASH = "SELECT page_id, sha256(html) AS content_hash FROM pages"


def page_similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the others of its top domain whose title is spelled like its own."""
    p = table(spark, sf_dir, "pages").filter("page_id is not null").select(F.col("page_id").alias("id"), F.substring_index(urls.host_of(F.col("url")), ".", -2).alias("domain"), normalize_title(title_of(F.col("html"))).alias("title"))
    return similar_titles(p, "domain", "title").withColumnRenamed("id", "page_id")


def page_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the markup of each page says, by a parser."""
    p = table(spark, sf_dir, "pages").withColumn("p", parse_html("html", "url"))
    return p.select("page_id", "p.title", F.size("p.links").alias("n_links"), F.size("p.metadata").alias("n_meta"), F.sha2("p.text", 256).alias("text_hash"), F.char_length("p.text").alias("n_text"))


def page_fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a minute for each page's host: the most specific domain's."""
    policies = spark.createDataFrame([("example.org", False, 3), ("example.net", True, 4), ("spam-farm.example.org", False, 0), ("blog.ththan.example.net", True, 9)], "domain string, exact boolean, per_minute int")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))
    return urls.with_policy(pages, "host", policies).select("page_id", F.coalesce("per_minute", F.lit(6)).alias("per_minute"))


PAGE_POLICY = f"SELECT page_id, CASE WHEN {HOST} = 'blog.ththan.example.net' THEN 9 WHEN {below(HOST, ('spam-farm.example.org',))} THEN 0 WHEN {below(HOST, ('example.org',))} THEN 3 WHEN {HOST} = 'example.net' THEN 4 ELSE 6 END AS per_minute FROM pages"
ADDRESSES = ("10.1.2.3", "127.0.0.1", "172.20.0.1", "172.40.0.1", "192.168.1.1", "8.8.8.8", "169.254.169.254", "user:pw@8.8.4.4", "239.1.1.1")


def page_public_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages, some moved to literal addresses, may be fetched."""
    host = F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.col("page_id") % len(ADDRESSES) + 1).cast("int"))
    moved = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace(F.col("url"), F.lit("^(https?://)[^/]*"), F.concat(F.lit("$1"), host)))
    return table(spark, sf_dir, "pages").select("page_id", urls.is_public_url(moved).alias("public"))


PAGE_PUBLIC = f"SELECT page_id, page_id % 2 = 0 OR list_extract([{', '.join(repr(a in ('172.40.0.1', '8.8.8.8')).lower() for a in ADDRESSES)}], CAST(page_id % {len(ADDRESSES)} + 1 AS INTEGER)) AS public FROM pages"

QUERIES = {f.__name__: f for f in (page_url_normalized, page_host_authority, page_url_flags, page_link_trust, page_title_links, page_host_counts, page_content_hash, page_similar_titles, page_parsed, page_fetch_policy, page_public_address, page_rendered_links, page_paid_results)}
SQL = {"page_url_normalized": PAGE_URL, "page_host_authority": PAGE_AUTHORITY, "page_url_flags": PAGE_FLAGS, "page_link_trust": PAGE_TRUST, "page_title_links": PAGE_LINKS, "page_host_counts": PAGE_HOSTS, "page_content_hash": PAGE_HASH, "page_fetch_policy": PAGE_POLICY, "page_public_address": PAGE_PUBLIC, "page_rendered_links": PAGE_RENDERED, "page_paid_results": PAGE_PAID}
