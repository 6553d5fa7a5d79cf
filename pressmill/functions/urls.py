"""URLs in pages, and relative ones made absolute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Where feeds and news sitemaps are looked for on a publisher's site, in order.
FEED_PATHS = ["/feed", "/feed/", "/rss", "/rss/", "/rss.xml", "/feed.xml", "/atom.xml", "/index.xml", "/?feed=rss2", "/feeds/posts/default"]
SITEMAP_PATHS = ["/sitemap-news.xml", "/news-sitemap.xml", "/sitemap_news.xml", "/wp-sitemap-news.xml", "/sitemap.xml"]


#: Schemes with an authority and slashes, and their ports; what is written as %XX in each part of a URL.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_CONTROL = r"\x00-\x20\x7F-\x{10FFFF}"
ENCODED = {"path": rf"[{_CONTROL}\"#<>?`{{}}^]", "query": rf"[{_CONTROL}\"#<>']", "fragment": rf"[{_CONTROL}\"<>`]", "user": rf"[{_CONTROL}\"#<>?`{{}}^/:;=@\[\\\]|]"}
_FORBIDDEN = r"[\x00-\x20#/<>?@\\^|%:\[\]\x7F]"


def absolute(base: Column, path: Column) -> Column:
    """path as seen from base, as the URL standard resolves and writes it; null where either is missing or can't be a URL.

    Bases have a scheme of PORTS. Hosts are lower-cased and written in ASCII; numbers as hosts stand as four decimal
    parts. Other schemes in path are left as they are.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    # each step names what the next ones use, so that nothing is found twice
    return once(F.struct(clean(base).alias("b"), clean(path).alias("p")), lambda v: once(_schemes(v), lambda v: once(_ways(v), lambda v: once(_chosen(v), _joined))))


def _scheme(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _schemes(v: Column) -> Column:
    rest = lambda x: F.regexp_replace(x, r"^[^:]*:", "")
    return F.struct(_scheme(v["b"]).alias("b_scheme"), F.regexp_replace(rest(v["b"]), r"^[/\\]+", "").alias("b_rest"), _scheme(v["p"]).alias("p_scheme"), rest(v["p"]).alias("p_rest"), v["p"].alias("p"))


def _ways(v: Column) -> Column:
    """Whether a path goes its own way: elsewhere (to another host), other (to no host at all)."""
    slashes = r"^[/\\]{2}"
    # the base's own scheme without two slashes is as good as none
    own = (v["p_scheme"] == v["b_scheme"]) & ~v["p_rest"].rlike(slashes)
    near = (v["p_scheme"] == "") | own
    r = F.when((v["p_scheme"] == "") | ~(own | v["p_scheme"].isin(*PORTS)), v["p"]).otherwise(v["p_rest"])
    return F.struct(
        v["b_scheme"], v["b_rest"], v["p_scheme"], r.alias("r"), (~near & ~v["p_scheme"].isin(*PORTS)).alias("other"), (near & r.rlike(slashes) | ~near & v["p_scheme"].isin(*PORTS)).alias("elsewhere"),
        F.when(near, v["b_scheme"]).otherwise(v["p_scheme"]).alias("scheme"),
    )


def _chosen(v: Column) -> Column:
    """The site (null where there is none), and path, query and fragment of base and target as they were given."""
    there = F.regexp_replace(v["r"], r"^[/\\]+", "")
    place = lambda scheme, rest: F.struct(scheme.alias("scheme"), rest.alias("rest"))
    sites = F.transform(F.array(place(v["b_scheme"], v["b_rest"]), place(v["scheme"], there)), lambda x: F.when(x["scheme"].isin(*PORTS), _site(x["scheme"], x["rest"])))
    tail = lambda k: F.when(v["elsewhere"], _tail(there, k)).otherwise(F.regexp_extract(v["r"], r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$", k))
    return F.struct(v["other"], v["elsewhere"], v["p_scheme"], v["r"], sites.alias("sites"), _straight(_tail(v["b_rest"], 1)).alias("b_path"), _tail(v["b_rest"], 2).alias("b_query"), *[tail(k).alias(n) for k, n in ((1, "path"), (2, "query"), (3, "fragment"))])


def _joined(v: Column) -> Column:
    kept = ~v["elsewhere"] & (v["path"] == "")
    path = F.when(kept, v["b_path"]).when(v["elsewhere"] | v["path"].rlike(r"^[/\\]"), v["path"]).otherwise(F.concat(F.regexp_extract(v["b_path"], "(?s)^(.*/)", 1), v["path"]))
    query = F.when(kept & (v["query"] == ""), v["b_query"]).otherwise(v["query"])
    found = F.concat(F.when(v["elsewhere"], v["sites"][1]).otherwise(v["sites"][0]), _straight(path), _written(query, "query"), _written(v["fragment"], "fragment"))
    return F.when(v["sites"][0].isNotNull(), F.when(v["other"], F.concat(v["p_scheme"], F.lit(":"), F.regexp_replace(v["r"], r"^[^:]*:", ""))).otherwise(found))


def _tail(rest: Column, part: int) -> Column:
    """Of what stands behind the slashes: 0 the authority, 1 the path, 2 the query with its mark, 3 the fragment with its mark."""
    return F.regexp_extract(rest, r"(?s)^([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", part + 1)


def _written(x: Column, part: str) -> Column:
    """x with the characters of its part that may not stand there as %XX."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    first = 2 if part in ("query", "fragment") else 1  # their marks stay
    coded = F.array_join(F.transform(F.split(F.substr(x, F.lit(first)), ""), lambda c: F.when(c.rlike(ENCODED[part]), code(c)).otherwise(c)), "")
    return F.when(F.substr(x, F.lit(first)).rlike(ENCODED[part]), F.concat(F.substring(x, 1, first - 1), coded)).otherwise(F.when(F.length(x) > first - 1, x).otherwise(F.lit("") if part == "fragment" else x))


def _straight(path: Column) -> Column:
    """A path from its slash on, without dot segments."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "^/", ""), "/")
    marked = F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.regexp_replace(s, "(?i)%2e", ".").alias("dots"), i.alias("i")))

    def step(done: Column, x: Column) -> Column:
        left = F.when(x["dots"] == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x["dots"] == ".", done).otherwise(F.concat(done, F.array(x["s"])))
        return F.when(x["dots"].isin(".", "..") & (x["i"] == F.size(parts) - 1), F.concat(left, F.array(F.lit("")))).otherwise(left)

    return F.concat(F.lit("/"), _written(F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"), "path"))


def _site(scheme: Column, rest: Column) -> Column:
    """scheme://authority, null where the authority is none."""

    def named(authority: Column) -> Column:
        user = F.regexp_extract(authority, r"(?s)^(.*)@", 1)
        place = F.regexp_replace(authority, r"(?s)^.*@", "")
        name, port = (F.regexp_extract(place, r"(?s)^(\[[^\]]*\]|[^:]*)(?::(.*))?$", k) for k in (1, 2))
        digits = F.regexp_replace(port, "^0+(?=.)", "")
        usual = F.element_at(F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair]), scheme)
        fits = port.rlike("^[0-9]*$") & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535) & (F.length(digits) < 6)
        first, second = F.substring_index(user, ":", 1), F.when(user.contains(":"), F.regexp_replace(user, "(?s)^[^:]*:", ""))
        who = F.when(user != "", F.concat(_written(first, "user"), F.coalesce(F.concat(F.lit(":"), _written(second, "user")), F.lit("")), F.lit("@"))).otherwise("")
        return F.when(fits, once(_host(name), lambda h: F.concat(scheme, F.lit("://"), who, h, F.when((digits != "") & (digits != usual), F.concat(F.lit(":"), digits)).otherwise(""))))

    return once(_tail(rest, 0), named)


def _host(name: Column) -> Column:
    """A host in ASCII, null where it is none."""
    plain = F.when(name.contains("%"), F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    low = F.lower(F.translate(plain, "。．｡", "..."))
    label = lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)

    def checked(host: Column) -> Column:
        number = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
        fits = ~number | host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
        return F.when((host != "") & ~host.rlike(_FORBIDDEN) & fits, host)

    named = once(low, lambda h: F.when(h.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(h, r"\."), label), ".")).otherwise(h))
    return F.when(name.rlike(r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"), F.lower(name)).otherwise(once(named, checked))


def punycode(label: Column) -> Column:
    """The ASCII form of a label with other characters, without xn--: its ASCII characters, and where the others stand, in steps of growing code points."""
    points = F.transform(F.split(label, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    basic = F.array_join(F.filter(F.split(label, ""), lambda c: c.rlike(r"^[\x00-\x7F]$")), "")
    long = lambda n: F.lit(n).cast("long")
    whole = lambda a, b: F.floor(a / b)

    def digits(delta: Column, bias: Column) -> Column:
        """delta in digits of a base that grows by place: the last is the first below its threshold."""
        start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

        def step(s: Column, k: Column) -> Column:
            t = F.greatest(F.lit(1), F.least(F.lit(26), k * 36 - bias))
            last = s["q"] < t
            d = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (36 - t))
            sign = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (d + 1).cast("int"), F.lit(1))
            return F.when(s["done"], s).otherwise(F.struct(F.when(last, s["q"]).otherwise(whole(s["q"] - t, 36 - t)).alias("q"), F.concat(s["out"], sign).alias("out"), last.alias("done")))

        return F.aggregate(F.sequence(long(1), long(12)), start, step, lambda s: s["out"])

    def adapted(delta: Column, count: Column, first: Column) -> Column:
        half = F.when(first, whole(delta, 700)).otherwise(whole(delta, 2))
        start = F.struct((half + whole(half, count)).alias("d"), long(0).alias("k"))
        fold = lambda s, _: F.when(s["d"] > 455, F.struct(whole(s["d"], 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
        return F.aggregate(F.sequence(long(1), long(8)), start, fold, lambda s: s["k"] + whole(36 * s["d"], s["d"] + 38))

    def level(s: Column, m: Column) -> Column:
        """All places of one code point."""
        begin = F.struct((s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))

        def place(x: Column, c: Column) -> Column:
            here = F.struct(long(0).alias("delta"), adapted(x["delta"], x["h"] + 1, x["h"] == F.length(basic)).alias("bias"), (x["h"] + 1).alias("h"), F.concat(x["out"], digits(x["delta"], x["bias"])).alias("out"))
            past = F.struct((x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["h"].alias("h"), x["out"].alias("out"))
            return F.when(c == m, here).when(c < m, past).otherwise(x)

        done = F.aggregate(points, begin, place)
        return once(done, lambda x: F.struct((x["delta"] + 1).alias("delta"), x["bias"].alias("bias"), x["h"].alias("h"), x["out"].alias("out"), (m + 1).alias("n")))

    front = F.when(basic != "", F.concat(basic, F.lit("-"))).otherwise(F.lit(""))
    start = F.struct(long(0).alias("delta"), long(72).alias("bias"), F.length(basic).cast("long").alias("h"), front.alias("out"), long(128).alias("n"))
    return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= 128))), start, level, lambda s: s["out"])


def is_url(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).__ne__("")


def tags(html: Column, name: str) -> Column:
    """All tags of a name, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag, else null."""
    return F.nullif(F.regexp_extract(tag, rf"""(?i){name}\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def announced_links(html: Column) -> Column:
    """Where a page says that its feeds are."""
    feed = F.filter(
        tags(html, "link"),
        lambda t: t.rlike(r"""(?i)rel\s*=\s*["']alternate["']""") & t.rlike(r"""(?i)type\s*=\s*["']application/(?:rss|atom)\+xml["']"""),
    )
    return F.filter(F.transform(feed, lambda t: attribute(t, "href")), lambda h: h.isNotNull())
