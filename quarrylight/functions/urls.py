"""URL functions over string columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import rules
from quarrylight.functions.text import contains_any, escaped
from quarrylight.shipping import ship_package

#: scheme, host, port, path, query
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, group)


def host_of(url: Column) -> Column:
    """Folded host; '' if there is none."""
    return F.lower(_part(F.coalesce(url, F.lit("")), 2))


def path_of(url: Column) -> Column:
    return _part(F.coalesce(url, F.lit("")), 4)


def query_pairs(url: Column) -> Column:
    """Decoded key and value structs, in order; a key without a value has ''."""
    pieces = F.filter(F.split(_part(url, 5), "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)

    def pair(p: Column) -> Column:
        return F.struct(decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"))

    return F.transform(pieces, pair)


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """One spelling for a page: folded scheme and host, no default port, user,
    fragment or tracking pairs, single slashes, sorted query."""
    scheme = F.coalesce(F.nullif(F.lower(_part(url, 1)), F.lit("")), F.lit("https"))
    port = _part(url, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.when(default, host_of(url)).otherwise(F.concat(host_of(url), F.lit(":"), port))
    path = F.regexp_replace(F.coalesce(F.nullif(_part(url, 4), F.lit("")), F.lit("/")), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    wanted = F.filter(query_pairs(url), lambda p: ~F.lower(p["k"]).isin(*rules.TRACKING_KEYS) & ~F.lower(p["k"]).startswith(rules.TRACKING_PREFIX))
    query = F.array_join(F.transform(F.array_sort(wanted), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def is_registration_url(url: Column) -> Column:
    return contains_any(F.lower(url), rules.REGISTRATION_MARKERS)


def _closed_path(url: Column) -> Column:
    path = F.lower(path_of(url))
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def is_listing_url(url: Column) -> Column:
    """A page that lists many events: by its path, or by a search term in its query."""
    asked = F.exists(query_pairs(F.lower(url)), lambda p: p["k"].isin(*rules.LISTING_KEYS) & (p["v"] != ""))
    return contains_any(_closed_path(url), rules.LISTING_MARKERS) | asked


def is_news_url(url: Column) -> Column:
    path = _closed_path(url)
    return F.coalesce(contains_any(path, rules.NEWS_MARKERS) | path.rlike(rules.DATED_PATH), F.lit(False))


def host_in(host: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of ``hosts`` or below one."""
    return reduce(lambda out, h: out | (host == h) | host.endswith(f".{h}"), hosts, F.lit(False))


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first: keys for an equi-join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def authority(host: Column, domains: dict[str, int] | None = None) -> Column:
    """Trust in a host from 0 to 100: configured domains (organizers' among them) in
    order, then kinds of host."""
    chain = F.when(F.lit(False), F.lit(0))
    for domain, trust in (domains or {}).items():
        chain = chain.when((host == domain) | host.endswith(f".{domain}"), F.lit(trust))
    for hosts, kind in ((rules.STRUCTURED_HOSTS, "structured"), (rules.SOCIAL_HOSTS, "social"), (rules.FORM_AUTHORITY_HOSTS, "form")):
        chain = chain.when(host.isin(*hosts), F.lit(rules.AUTHORITY[kind]))
    return chain.otherwise(F.lit(rules.AUTHORITY["third_party"]))


def link_trust(url: Column, domains: dict[str, int] | None = None) -> Column:
    """DROP, PLAIN or CLICKABLE."""
    host, path = host_of(url), F.lower(path_of(url))
    facebook = (host == "facebook.com") | host.endswith(".facebook.com") | host.endswith(".fbcdn.net")
    furniture = reduce(lambda out, p: out | path.startswith(p), rules.CHROME_PATHS, F.lit(False))
    chrome = host_in(host, rules.CHROME_HOSTS) | host.endswith(".fbcdn.net") | (facebook & furniture)
    web = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    return (
        F.when(url.isNull() | ~web | (host == "") | chrome | host_in(host, rules.OPAQUE_HOSTS), "DROP")
        .when(facebook, F.when(contains_any(path, rules.FACEBOOK_PAGES), "CLICKABLE").otherwise("DROP"))
        .when(host_in(host, rules.SHORTENERS), "PLAIN")
        .when(authority(host, domains) >= rules.TRUSTED_AUTHORITY, "CLICKABLE")
        .when(host_in(host, rules.FORM_HOSTS), "CLICKABLE")
        .otherwise("PLAIN")
    )


def is_trusted_registration_url(url: Column, domains: dict[str, int] | None = None) -> Column:
    return is_registration_url(url) & (link_trust(url, domains) == "CLICKABLE")


def same_site(a: Column, b: Column) -> Column:
    x, y = host_of(a), host_of(b)
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def choose_urls(requested: Column, final: Column, declared: Column, links: Column, domains: dict[str, int] | None = None) -> tuple[Column, Column]:
    """Canonical URL of a page and its registration link (or null).

    ``declared``: array of the URLs that the page gives for itself, in order."""
    own = normalize_url(F.coalesce(final, requested))
    web = lambda u: u.startswith("http://") | u.startswith("https://")
    told = F.transform(F.filter(F.array_compact(declared), web), normalize_url)
    deep = lambda u: path_of(u).rlike("[^/]")
    usable = F.filter(told, lambda u: same_site(u, own) & (deep(u) | ~deep(own)))
    every = F.array_distinct(F.concat(F.transform(F.filter(F.array_compact(F.array(requested, final)), web), normalize_url), told, F.transform(F.filter(F.array_compact(links), web), normalize_url)))
    registers = F.filter(every, (lambda u: is_registration_url(u)) if domains is None else (lambda u: is_trusted_registration_url(u, domains)))
    return F.coalesce(F.get(usable, 0), own), F.get(registers, 0)


#: First address and prefix length of the special IPv4 blocks.
SPECIAL_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def is_public_url(url: Column) -> Column:
    """A web address without credentials whose host is a name, or a public address.

    Names are not resolved here; the local host's name isn't public.  IPv4 addresses
    may be dotted or one number, with or without a last dot; other spellings of numbers
    (hexadecimal, fewer than four parts) are refused.  IPv6 addresses are public in the
    global unicast range 2000::/3 without its documentation and tunnel blocks."""
    host, scheme = F.regexp_replace(host_of(url), r"\.$", ""), F.lower(_part(url, 1))
    octets = [F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("long") for i in (1, 2, 3, 4)]
    dotted = F.when(reduce(Column.__and__, (o <= 255 for o in octets)), octets[0] * 2**24 + octets[1] * 2**16 + octets[2] * 2**8 + octets[3])
    number = F.coalesce(dotted, F.when(host.rlike("^[0-9]{1,10}$"), host.try_cast("long")))
    blocks = []
    for first, length in SPECIAL_IPV4:
        low = reduce(lambda n, part: n * 256 + int(part), first.split("."), 0)
        blocks.append(number.between(low, low + 2 ** (32 - length) - 1))
    numeric = host.rlike(r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*$")
    v4 = number.isNotNull() & (number < 2**32) & ~reduce(Column.__or__, blocks)
    v6 = host.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:.]*\]$") & ~host.rlike(r"^\[(?:2001:0?db8:|2001:0{0,4}:|2002:)")
    named = ~host.startswith("[") & ~numeric & (host != "") & (host != "localhost") & ~host.endswith(".localhost")
    signed = F.trim(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*@")
    return F.coalesce(scheme.isin("http", "https") & ~signed & (named | F.coalesce(v4, F.lit(False)) | v6), F.lit(False))


def displayable_image(url: Column, domains: dict[str, int] | None = None) -> Column:
    """The image's address if its link is trusted enough to show, else null."""
    return F.when(link_trust(url, domains) == "CLICKABLE", url)


def organizer_icon(url: Column, logos: dict[str, str] | None = None, domains: dict[str, int] | None = None) -> Column:
    """The logo configured for a host's domain, else the site's own icon if its links may
    be shown, else null."""
    host = host_of(url)
    chain = F.when(host == "", F.lit(None).cast("string"))
    for domain, logo in (logos or {}).items():
        chain = chain.when((host == domain) | host.endswith(f".{domain}"), F.lit(logo))
    return chain.when(link_trust(url, domains) == "CLICKABLE", F.concat(F.lit("https://"), host, F.lit("/favicon.ico")))


def rendered_links(urls: Column, domains: dict[str, int] | None = None, most: int = 5, room: int = 1024) -> Column:
    """The first links of an array as lines: trusted ones can be clicked, others are
    plain text, the platforms' own are left out; null if none remains."""
    known = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), host_of(u).alias("host"), link_trust(u, domains).alias("trust")))
    shown = F.slice(F.filter(known, lambda k: k["trust"] != "DROP"), 1, most)

    def line(k: Column) -> Column:
        label = escaped(F.when(k["host"] != "", k["host"]).otherwise(k["url"]))
        link = F.concat(F.lit("["), label, F.lit("]("), k["url"], F.lit(")"))
        short = F.when(host_in(k["host"], rules.SHORTENERS), F.lit(" (shortened link)")).otherwise(F.lit(""))
        return F.when(k["trust"] == "CLICKABLE", link).otherwise(F.concat(F.lit("`"), k["url"], F.lit("`"), short))

    return F.nullif(F.substring(F.array_join(F.transform(shown, line), "\n"), 1, room), F.lit(""))


@F.pandas_udf(T.StringType())
def _ascii_host(hosts):
    return hosts.map(_encoded_host)


def _encoded_host(host: str | None) -> str | None:
    try:
        return host if not host or host.isascii() else host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


def ascii_url(url: Column) -> Column:
    """The address with an international host in its ASCII spelling; like folding of
    text, applied once at the source (encoding a host has no built-in)."""
    ship_package()
    host = _part(F.coalesce(url, F.lit("")), 2)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.replace(url, host, _ascii_host(host))).otherwise(url)


def with_policy(rows: DataFrame, host: str, policies: DataFrame) -> DataFrame:
    """Rows with the columns of the most specific policy for their host.  ``policies``:
    domain, exact (no subdomains) and any values; an equi-join on suffixes."""
    keyed = rows.select(F.col(host).alias("_host")).distinct().select("_host", F.posexplode(suffixes(F.col("_host"))).alias("_at", "domain"))
    values = [c for c in policies.columns if c not in ("domain", "exact")]
    hits = keyed.join(policies, "domain").filter((F.col("_at") == 0) | ~F.coalesce("exact", F.lit(False)))
    best = hits.groupBy("_host").agg(F.min_by(F.struct(*values), "_at").alias("_policy")).select("_host", "_policy.*")
    return rows.join(best, rows[host] == best["_host"], "left").drop("_host")
