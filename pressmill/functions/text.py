"""Text expressions: all are Column expressions that stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What browsers' scripts call white space.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same without the space.
ODD_SPACE = SPACE.replace("r ", "r")

#: What follows the ampersand of a named or numeric reference.
REFERENCE = r"(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);"

#: The categories in order of priority, with the parts of words that tell them.
KEYWORDS = {
    "politics": ["politiqu", "election", "president", "government", "parliament", "minister"],
    "business": ["business", "economie", "econom", "market", "bourse", "finance", "bank"],
    "technology": ["tech", "ntic", "digital", "numeriq", "startup", "internet"],
    "sports": ["sport", "football", "foot", "cup", "league", "match"],
    "health": ["sante", "health", "hopital", "medic", "covid", "disease"],
    "entertainment": ["culture", "musique", "music", "cinema", "entertainment", "celebrit"],
}
OTHER = "other"

#: Patterns that tell the risk of a change.
LOW_RISK = [
    "ui text", "colour", "color", "documentation", "logging", "comment", "readme", "typo", "wording", "style", "css", "label", "translation",
    "non-functional", "refactor", "rename variable", "format", "add feed", "new feed", "new publisher",
]
HIGH_RISK = [
    "database migration", "schema change", "schema", "migrate", "postgres", "column", "constraint", "alter table", "index", "table",
    "kubernetes", "k8s", r"deployment\.yaml", "statefulset", "cronjob manifest", "nlb", "load balancer", "backend set", "dns", "tls", "certificate", "cert",
    "secret", "ingress", "namespace", "oke", "ocir", "dockerfile", "kaniko", "bastion", "environment variable", "env var", "security", "auth",
]
MEDIUM_RISK = [
    "new feature", "api", "endpoint", "new country", "worker", "categorization", "category", "polling", "schedule", "frontend component", "globe", "route",
    "query", "index",
]


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def normal_headline(headline: Column) -> Column:
    """Trimmed, lower-cased, each run of white space one space (null: empty)."""
    # single spaces stay as they are; a run begins at one place only, so its length tells how long it takes, and
    # what is printable ASCII is passed by first
    one = F.regexp_replace(F.coalesce(headline, F.lit("")), f"(?![!-~])(?: *{ODD_SPACE}{SPACE}*|  {SPACE}*)", " ")
    return F.trim(F.lower(one))


def dedup_hash(publisher: Column, headline: Column) -> Column:
    """The key under which a publisher's headline is stored once."""
    return F.sha2(F.concat_ws(":", publisher.cast("string"), normal_headline(headline)), 256)


def escape_ampersands(xml: Column) -> Column:
    """& as &amp;, but where it begins a named or numeric reference."""
    return F.regexp_replace(xml, f"&(?!{REFERENCE})", "&amp;")


def category_texts(categories: Column) -> Column:
    """Texts of array<struct<_VALUE, ...>>; one without text is empty."""
    return F.transform(categories, lambda c: F.coalesce(c["_VALUE"], F.lit("")))


def once(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used: as the argument of a function over an array of one."""
    return F.transform(F.array(value), use)[0]


def categorize(texts: Column, headline: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The first category with a keyword anywhere in the texts or the headline."""
    joined = F.array_join(F.concat(F.coalesce(texts, F.array().cast("array<string>")), F.array(F.coalesce(headline, F.lit("")))), " ")

    def first(text: Column) -> Column:
        out = None
        for category, words in (keywords or KEYWORDS).items():
            has = reduce(or_, map(text.contains, words))
            out = F.when(has, category) if out is None else out.when(has, category)
        return out.otherwise(OTHER)

    return once(F.lower(joined), first)


def first_units(text: Column, most: int) -> Column:
    """The first UTF-16 code units of a text, as scripts of browsers count and cut: a character beyond U+FFFF has two, and half of one is U+FFFD."""
    units = F.encode(F.substring(text, 1, most), "UTF-16BE")
    half = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.when(half, F.concat(F.decode(F.substring(units, 1, 2 * most - 2), "UTF-16BE"), F.lit("\ufffd"))).otherwise(F.decode(F.substring(units, 1, 2 * most), "UTF-16BE"))
    return F.when(F.octet_length(units) <= 2 * most, F.substring(text, 1, most)).otherwise(cut)


def summary(snippet: Column, text: Column, most: int = 1000) -> Column:
    return first_units(F.coalesce(filled(snippet, text), F.lit("")), most)


def error_status(message: Column, most: int = 250) -> Column:
    return first_units(F.concat(F.lit("error: "), message), most)


def json_string(value: Column) -> Column:
    """The text of a JSON string; null for other JSON, and for none."""
    return F.when(value.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])


def author(creator: Column, other: Column) -> Column:
    """The creator, or else the author, if it is text: what is no text hides what stands behind it."""
    blank = lambda c: c.isNull() | c.isin('""', "null", "", "false", "0")
    return json_string(F.when(~blank(creator), creator).otherwise(other))


def site_with_path(url: Column) -> Column:
    """The address without scheme and www., the path kept."""
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")


def site(url: Column) -> Column:
    """As site_with_path, up to the first slash: a port stays, and so does letter case."""
    return F.regexp_replace(site_with_path(url), "/.*$", "")


def host(url: Column) -> Column:
    """The lower-cased host name without www. and port; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def thousands(number: Column) -> Column:
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def slug(text: Column, most: int = 40) -> Column:
    dashes = F.regexp_replace(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", "-")), "-+", "-")
    return F.rtrim(F.substring(dashes, 1, most), F.lit("-"))


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 8)


def locale_region(locale: Column) -> Column:
    """The two-letter region of a locale such as fr-CI, upper-cased, else null."""
    part = F.try_element_at(F.split(locale, "-"), F.lit(2))
    return F.when(F.length(part) == 2, F.upper(part))


def leading_int(text: Column) -> Column:
    """The whole number that a text begins with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def page_limit(text: Column, usual: int = 30, most: int = 100) -> Column:
    """A page size: what is absent, no number or zero is the usual; negative ones stay, for the query to refuse."""
    return F.least(F.coalesce(F.nullif(leading_int(text), F.lit(0)), F.lit(usual)), F.lit(most))


def risk(change: Column) -> Column:
    """HIGH, MEDIUM or LOW: low patterns outrule high ones, and medium ones all but a high that stands."""

    def told(text: Column) -> Column:
        high, low, medium = (text.rlike("|".join(p)) for p in (HIGH_RISK, LOW_RISK, MEDIUM_RISK))
        return F.when(high & ~low, "HIGH").when(low & ~medium, "LOW").otherwise("MEDIUM")

    return once(F.lower(change), told)


def occurrences(text: Column, literal: str) -> Column:
    return F.regexp_count(text, F.lit("\\Q" + literal + "\\E"))


def kilobytes(size: Column) -> Column:
    """Rounded half to even, one decimal."""
    return F.bround(size / 1024, 1)


def verdict(answer: Column) -> Column:
    """A moderator's answer: approved, rejected, or null to skip."""
    first = F.lower(F.trim(answer))
    return F.when(first == "a", "approved").when(first == "r", "rejected")


def shown(value: Column, missing: str = "—") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))
