"""Web pages: extraction of title, text, tables and links; link tables; ranking of sources."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import plain_terms, terms, text_key

# Fixed values that results depend on: what isn't visible text, words and hosts that speak of data, and
# sentences and titles that say nothing.
HIDDEN_TAGS = frozenset("script style nav noscript template iframe object embed svg footer aside".split())
HIDDEN_ROLES = frozenset(("navigation", "banner", "contentinfo"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SECRET_KEYS = re.compile(r"(?:^|[_-])(?:api[_-]?key|key|token|secret|password|auth(?:orization)?|signature|sig)$", re.I)
STOPWORDS = frozenset("a an and are as at be by for from in is it of on or the to with".split())
DISCOVERY_WORDS = frozenset("data dataset datasets download downloads source sources official open file files format csv tsv json geojson geotiff tif tiff gpkg kml kmz shp zip".split())
POPULATION_WORDS = frozenset(("population", "populations", "census", "demographic", "demographics", "worldpop"))
DATA_WORDS = frozenset(("data", "dataset", "datasets", "geodata", "raster", "csv", "geojson", "geotiff"))
TRUSTED_HOSTS = ("worldpop.org", "censusindia.gov.in", "census.gov", "sedac.ciesin.columbia.edu", "ghsl.jrc.ec.europa.eu")
RASTER_WORDS = ("geotiff", "geojson", "geopackage", "gridded", "raster")
BOILERPLATE = (
    r"\b(?:javascript is (?:disabled|required)|(?:enable|requires?) javascript|verify (?:that )?you(?: are|'re|’re) (?:not a robot|(?:a )?human)|"
    r"checking (?:your browser|if the site connection is secure)|(?:complete|solve) (?:the |this |a )?(?:captcha|security check)|"
    r"unusual traffic from your (?:computer|network)|security verification|just a moment|please wait|cloudflare ray id)\b"
)
PLACEHOLDERS = ("untitled", "just a moment", "please wait", "access denied", "attention required", "captcha", "security check", "human verification", "robot check")


@dataclass(frozen=True)
class Limits:
    """How much of a page is kept: characters of titles and URLs, tables, their rows and cells, links."""

    title: int = 160
    tables: int = 6
    rows: int = 100
    cells: int = 30
    links: int = 40
    url: int = 2048


def clean_url(url: str | None, base: str = "", most: int = Limits.url) -> str | None:
    """The canonical form of an admissible URL, else None: http or https, a public host in lower case, no
    user, no secrets in the query, no fragment, at most so many characters."""
    try:
        parts = urlsplit(urljoin(base, (url or "").strip()))
        host = (parts.hostname or "").encode("idna").decode() if parts.hostname else ""
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    if parts.scheme not in ("http", "https") or not host or parts.username is not None or parts.password is not None:
        return None
    try:
        if not ipaddress.ip_address(host).is_global:
            return None
    except ValueError:
        if "." not in host or host.endswith((".local", ".internal", ".localhost", ".lan", ".home", ".arpa")):
            return None
    if any(SECRET_KEYS.search(k) for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
        return None
    default = {"http": 80, "https": 443}[parts.scheme]
    out = urlunsplit((parts.scheme, host + (f":{port}" if port and port != default else ""), parts.path or "/", parts.query, ""))
    return out if len(out) <= most else None


class _Page(HTMLParser):
    def __init__(self, url: str, limits: Limits):
        super().__init__(convert_charrefs=True)
        self.limits = limits
        self.url, self.hidden, self.stack = url, 0, []
        self.title, self.text, self.links, self.tables = [], [], {}, []
        self.in_title, self.table, self.row, self.cell, self.link = False, None, None, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag not in VOID_TAGS:
            hide = tag in HIDDEN_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in HIDDEN_ROLES
            self.stack.append((tag, hide))
            self.hidden += hide
        if tag == "title":
            self.in_title = True
        if self.hidden:
            return
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "table"):
            self.text.append("\n")
        if tag == "a" and len(self.links) < self.limits.links:
            self.link = (clean_url(a.get("href"), self.url, self.limits.url), [])
        if tag == "table" and len(self.tables) < self.limits.tables:
            self.table = []
        elif tag == "tr":  # cells and rows may be left open
            self._end_cell()
            self._end_row()
            self.row = [] if self.table is not None and len(self.table) < self.limits.rows else None
        elif tag in ("td", "th"):
            self._end_cell()
            self.cell = (tag, []) if self.row is not None and len(self.row) < self.limits.cells else None

    def _end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append((self.cell[0], " ".join("".join(self.cell[1]).split())))
        self.cell = None

    def _end_row(self) -> None:
        if self.row and self.table is not None:
            self.table.append(self.row)
        self.row = None

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, hide = self.stack.pop()
                self.hidden -= hide
                if t == tag:
                    break
        if tag == "title":
            self.in_title = False
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        if tag in ("tr", "table"):
            self._end_row()
        if tag == "table" and self.table is not None:
            if self.table:
                self.tables.append(self.table)
            self.table = None
        if tag == "a" and self.link:
            url, words = self.link
            if url and url not in self.links:
                self.links[url] = " ".join("".join(words).split())[:self.limits.title]
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)
            if self.cell is not None:
                self.cell[1].append(data)
            if self.link:
                self.link[1].append(data)


def read_page(url: str | None, html: str | None, limits: Limits = Limits()) -> dict:
    page = _Page(url or "", limits)
    page.feed(html or "")
    page.close()
    tables = []
    for rows in page.tables:
        heads = [c for _, c in rows[0]] if all(t == "th" for t, _ in rows[0]) else []
        tables.append({"headers": heads, "rows": [[c for _, c in r] for r in rows[bool(heads) :]]})
    lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
    return {"title": " ".join("".join(page.title).split())[: limits.title], "text": "\n".join(x for x in lines if x), "tables": tables, "links": [{"url": u, "title": t} for u, t in page.links.items()]}


PAGE_SCHEMA = "page_id long, url string, title string, text string, tables array<struct<headers:array<string>,rows:array<array<string>>>>, links array<struct<url:string,title:string>>"


def extract_pages(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(page_id, url, title, text, tables, links) of pages (page_id, url, html), within limits; the parser is
    Python's, run on batches where the pages are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield pd.DataFrame([{"page_id": k, "url": u, **read_page(u, h, limits)} for k, u, h in part.itertuples(index=False)], columns=["page_id", "url", "title", "text", "tables", "links"])

    return pages.select("page_id", "url", "html").mapInPandas(run, PAGE_SCHEMA)


def link_table(pages: DataFrame) -> DataFrame:
    """(url, host, pages): admissible links of extracted pages, each once."""
    links = pages.select("page_id", F.explode("links").alias("l")).select("page_id", "l.url")
    per = links.groupBy("url").agg(F.count_distinct("page_id").alias("pages"))
    return per.withColumn("host", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1))


def host_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("host").agg(F.count("*").alias("urls"))


def clean_urls(column: str | Column) -> Column:
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(clean_url)

    run.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.col(column) if isinstance(column, str) else column)


def useful_sources(sources: DataFrame) -> DataFrame:
    """sources (title, snippet, ...) without boilerplate sentences, and without rows that then say nothing."""
    ask = F.lit(f"(?iU){BOILERPLATE}")
    parts = F.filter(F.split("snippet", r"(?U)(?<=[.!?])\s+|\n+"), lambda x: ~F.regexp_like(x, ask))
    snippet = F.array_join(parts, " ")
    bare = F.regexp_replace(text_key("title"), r"^[ .!?:]+|[ .!?:]+$", "")
    useful = ~bare.isin(*PLACEHOLDERS) & ~F.regexp_like("title", F.lit(f"(?iU)^(?:{BOILERPLATE})"))
    return sources.withColumn("snippet", snippet).where(useful | F.regexp_like("snippet", F.lit(r"[\p{L}\p{N}]")))


def rank_sources(sources: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The best of useful_sources for a query: rare query words weigh most, then words that speak of data,
    trusted hosts for questions of population, and file hints; equals keep their order (pos), and a URL
    counts once. Words are unquoted, of any script, in one case and without accents; they are counted over all
    sources by one aggregation."""
    words = set(plain_terms(query)) - STOPWORDS
    real = sorted(words - DISCOVERY_WORDS)
    population = bool(words & POPULATION_WORDS)
    about_data = population or bool(words & DATA_WORDS)
    s = useful_sources(sources).withColumn("_w", terms(F.concat_ws(" ", "title", "snippet", "url")))
    counts = s.agg(F.count("*").alias("_n"), *(F.count_if(F.array_contains("_w", w)).alias(f"_df{k}") for k, w in enumerate(real)))
    s = s.crossJoin(F.broadcast(counts))
    has = lambda w: F.array_contains("_w", w)
    score = F.lit(0.0)
    for k, w in enumerate(real):
        score = score + F.when(has(w), 1 + F.log((F.col("_n") + 1) / (1 + F.col(f"_df{k}")))).otherwise(0.0)
    found = sum((has(w).cast("int") for w in sorted(words & DISCOVERY_WORDS)), F.lit(0))
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/:?#]+)", 1)
    trusted = F.lit(False)
    for h in TRUSTED_HOSTS if population else ():
        trusted |= (host == h) | F.endswith(host, F.lit("." + h))
    any_real = F.lit(False)
    for w in real:
        any_real |= has(w)
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    hint = F.lit(about_data) & (any_real | trusted) & (F.regexp_like(path, F.lit(r"(?i)\.(?:csv|tsv|geojson|tif|tiff|gpkg|fgb|shp|kml|kmz|zip)$")) | F.arrays_overlap("_w", F.array(*map(F.lit, RASTER_WORDS))))
    score = score + F.least(F.lit(0.5), 0.1 * found) + F.when(trusted, 1.5).otherwise(0.0) + F.when(hint, 0.25).otherwise(0.0)
    scored = s.withColumn("score", score)
    best = scored.groupBy("url").agg(F.max_by(F.struct(*(F.col(c) for c in (*sources.columns, "score"))), F.struct("score", -F.col("pos"))).alias("b")).select("b.*")
    return best.orderBy(F.desc("score"), "pos").limit(most)


def joined_results(*lists: DataFrame) -> DataFrame:
    """Lists (pos, url, ...) one after the other, each URL at its first place."""
    out = None
    for k, rows in enumerate(lists):
        rows = rows.withColumn("list", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    first = out.groupBy("url").agg(F.min(F.struct("list", "pos")).alias("_f"))
    return out.join(first, "url").where(F.struct("list", "pos") == F.col("_f")).drop("_f")
