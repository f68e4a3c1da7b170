"""Web addresses and pages: canonical form, safety, policy rules, sanitised text."""

from __future__ import annotations

import html as html_lib
import ipaddress
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(c: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(c), _URL, n)


def canonical_url(c: Column) -> Column:
    """Lower scheme and host, no default port, a path, no fragment; null for addresses
    with credentials or of no known form."""
    scheme, host, port = F.lower(url_part(c, 1)), F.lower(url_part(c, 3)), url_part(c, 4)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    query = url_part(c, 6)
    out = F.concat(
        scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(url_part(c, 5) == "", "/").otherwise(url_part(c, 5)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme.isin("http", "https") & (url_part(c, 2) == "") & (host != ""), out)


def unsafe_reason(c: Column) -> Column:
    """Why an address may not be fetched; null if it may."""
    host = F.lower(url_part(c, 3))
    return (
        F.when(~F.lower(url_part(c, 1)).isin("http", "https"), "scheme")
        .when(url_part(c, 2) != "", "credentials")
        .when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"), "local_host")
        .when(host.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), "private_address")
        .when(host.rlike(r"^\d+(\.\d+){3}$") | host.startswith("["), "ip_literal")
    )


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule_id): the first rule (by rule_no) whose origin is equal and whose path
    prefix fits; null if none. Joined on the origin, so no URL meets other sites' rules."""
    u = urls.select(F.col(url).alias("url")).distinct().withColumn("c", canonical_url(F.col("url")))
    u = u.withColumn("origin", F.regexp_extract("c", r"^([a-z]+://[^/]+)", 1)).withColumn("path", F.regexp_extract("c", r"^[a-z]+://[^/]+([^?]*)", 1))
    hit = u.join(rules, "origin").filter(F.startswith("path", F.col("path_prefix")))
    best = hit.groupBy("url").agg(F.min_by("rule_id", "rule_no").alias("rule_id"))
    return u.select("url").join(best, "url", "left")


def type_allowed(content_type: Column, allowed: Column) -> Column:
    """Whether a content type fits one of the allowed ones, * standing for any."""
    base = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.exists(allowed, lambda a: (a == "*/*") | (a == base) | (a.endswith("/*") & base.startswith(F.substring_index(a, "/", 1))))


# Tags that end a line of text, and tags whose content is not text.
BLOCK_TAGS = frozenset(
    "article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr "
    "ul".split()
)
SILENT_TAGS = frozenset("script style noscript template".split())
# Of a cleaned page, tags that go with their content, tags that stay, and
# those without an end.
STRIPPED_TAGS = frozenset("script style noscript iframe object embed svg canvas template".split())
KEPT_TAGS = frozenset(
    "p br div span h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code strong b em i u s hr a table thead tbody tr th td".split()
)
LONE_TAGS = frozenset(("br", "hr"))


class _Page(HTMLParser):
    """Visible text of a page, with a line for each block, and its title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.titles: list[str] = []
        self.silent, self.titled = 0, False

    def _mark(self, tag: str, opened: bool) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent + (1 if opened else -1))
        elif not self.silent:
            self.titled = opened if tag == "title" else self.titled
            self.parts.append("\n" if tag in BLOCK_TAGS else "")

    def handle_starttag(self, tag, attrs):
        self._mark(tag, True)

    def handle_endtag(self, tag):
        self._mark(tag, False)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.titled and data.strip():
                self.titles.append(data.strip())


def read_page(page: str) -> tuple[str, str | None]:
    """(visible text, title) of a page; blanks within a line are collapsed."""
    p = _Page()
    p.feed(page)
    p.close()
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.parts).splitlines())
    return "\n".join(x for x in lines if x), " ".join(p.titles).strip() or None


def visible_text(page: str | None) -> str | None:
    """The text of a page, a line for each block, blanks collapsed."""
    return None if page is None else read_page(page)[0]


class _Clean(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.texts: list[str] = []
        self.titles: list[str] = []
        self.inside: list[str] = []  # stripped tags that are open
        self.titled = 0

    def handle_starttag(self, tag, attrs):
        if tag in STRIPPED_TAGS:
            self.inside.append(tag)
        elif self.inside:
            return
        elif tag == "title":
            self.titled += 1
        elif tag == "a":
            href = next((v.strip() for k, v in attrs if k == "href" and v), "")
            web = href.lower().startswith(("http://", "https://"))
            self.out.append(f'<a href="{html_lib.escape(href)}">' if web else "<a>")
        elif tag in KEPT_TAGS:
            self.out.append(f"<{tag}>")

    def handle_startendtag(self, tag, attrs):
        if tag in LONE_TAGS and not self.inside:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if self.inside:
            if tag == self.inside[-1]:
                self.inside.pop()
        elif tag == "title":
            self.titled = max(0, self.titled - 1)
        elif tag in KEPT_TAGS and tag not in LONE_TAGS:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.inside:
            return
        if self.titled:
            self.titles.append(data)
            return
        self.out.append(html_lib.escape(data))
        if data.strip():
            self.texts.append(data)


def cleaned(page: str | None) -> tuple[str, str, str] | None:
    """(html, text, title) of a page: of its tags those that are allowed, of attributes
    only web links; a page of text alone becomes one paragraph."""
    if page is None:
        return None
    p = _Clean()
    p.feed(page)
    p.close()
    text = " ".join(" ".join(p.texts).split())
    out = "".join(p.out).strip() or (f"<p>{html_lib.escape(text)}</p>" if text else "")
    return out, text, " ".join(" ".join(p.titles).split())


def sanitised(page: str | None) -> str | None:
    return None if page is None else cleaned(page)[0]


@F.pandas_udf(StringType())
def html_text(page: pd.Series) -> pd.Series:
    return page.map(visible_text, na_action="ignore")


@F.pandas_udf(StringType())
def html_clean(page: pd.Series) -> pd.Series:
    return page.map(sanitised, na_action="ignore")


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("html", "text", "title")]))
def html_parts(page: pd.Series) -> pd.DataFrame:
    """The cleaned page, its text and title."""
    rows = [cleaned(p) or (None, None, None) for p in page]
    return pd.DataFrame(rows, columns=["html", "text", "title"])


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references of markup as the characters they stand for."""
    return text.map(html_lib.unescape, na_action="ignore")


def nonpublic(address: str | None) -> bool | None:
    """Whether an IP address is private, local, link-local, for many, reserved or none;
    null if it is no address."""
    try:
        ip = ipaddress.ip_address((address or "").strip("[] "))
    except ValueError:
        return None
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(BooleanType())
def nonpublic_address(address: pd.Series) -> pd.Series:
    return address.map(nonpublic, na_action="ignore")


def quoted_path(path: Column) -> Column:
    """A path as part of an address: all but letters, digits and ``_.-~/`` escaped."""
    out = F.url_encode(path)
    for seen, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(seen), F.lit(wanted))
    return out


def file_address(base: Column, path: Column) -> Column:
    """The address of a file below a base address."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), quoted_path(path))


def plain_type(content_type: Column) -> Column:
    """A content type without parameters; unknown bytes where there is none."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.when(kind == "", "application/octet-stream").otherwise(kind)


# Suffixes of payloads by content type.
SUFFIX_OF = {
    "application/pdf": ".pdf", "application/json": ".json", "application/toml": ".toml", "application/yaml": ".yaml", "application/x-yaml": ".yaml",
    "text/yaml": ".yaml", "text/markdown": ".md", "text/plain": ".txt", "text/csv": ".csv", "text/x-rst": ".rst",
}


def suffix_of_type(content_type: Column) -> Column:
    """The suffix of a payload by its type: a given one, text or unknown."""
    kind = plain_type(content_type)
    given = F.create_map(*[F.lit(x) for pair in SUFFIX_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(given, kind), F.when(kind.startswith("text/"), ".txt").otherwise(".bin"))


def safe_suffix(url: Column, content_type: Column) -> Column:
    """The suffix in an address if it is short and plain, else that of the type."""
    name = F.regexp_extract(url_part(url, 5), r"([^/]*)$", 1)
    own = F.lower(F.regexp_extract(name, r"^[^/]*[^./](\.[^./]+)$", 1))
    plain = own.rlike(r"^\.[\p{L}\p{N}-]*[\p{L}\p{N}][\p{L}\p{N}-]*$") & (F.length(own) <= 12)
    guessed = F.when(plain_type(content_type) == "text/html", ".html").otherwise(suffix_of_type(content_type))
    return F.when(plain, own).otherwise(guessed)


def tag_strip(c: Column) -> Column:
    """Text without tags and character references, blanks collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, r"<[^>]+>", " ")), r"[\s\u00a0]+", " "))


def title_of(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<(?:title|h1)[^>]*>(.*?)</(?:title|h1)>", 1), r"\s+", " ")), F.lit(""))
