"""Literature services: requests, answers fetched side by side, and their parsers, one plan for each source."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import literature as L
from folioscan.functions.text import clean_snippet, format_authors, short_text, strip, text
from folioscan.operators.merging import source_diagnostics
from folioscan.session import cut
from folioscan.sources.http import fetch_frame

# The addresses of the services and the parameters of their searches; "{n}" is the number of results asked for.
ENDPOINTS = {
    "arxiv": "https://export.arxiv.org/api/query",
    "openalex": "https://api.openalex.org/works",
    "semanticscholar": "https://api.semanticscholar.org/graph/v1/paper/search",
    "crossref": "https://api.crossref.org/works",
    "mathoverflow": "https://api.stackexchange.com/2.3/search/advanced",
    "mathse": "https://api.stackexchange.com/2.3/search/advanced",
    "wikipedia": "https://en.wikipedia.org/w/api.php",
}
ASKED_AS = {
    "arxiv": "search_query",
    "openalex": "search",
    "semanticscholar": "query",
    "crossref": "query.bibliographic",
    "mathoverflow": "q",
    "mathse": "q",
    "wikipedia": "srsearch",
}
PARAMETERS = {
    "arxiv": "start=0&max_results={n}&sortBy=relevance&sortOrder=descending",
    "openalex": "per-page={n}&sort=relevance_score%3Adesc",
    "semanticscholar": "limit={n}&fields=title%2Cyear%2Cauthors%2Curl%2Cabstract%2CexternalIds",
    "crossref": "rows={n}&sort=relevance&order=desc&select=DOI%2Ctitle%2Cauthor%2Cissued%2CURL%2Ccontainer-title%2Cabstract",
    "mathoverflow": "order=desc&sort=relevance&site=mathoverflow.net&pagesize={n}&filter=default",
    "mathse": "order=desc&sort=relevance&site=math&pagesize={n}&filter=default",
    "wikipedia": "action=query&format=json&list=search&srlimit={n}&utf8=1",
}



def _of(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source_key") == source)


def _items(rows: DataFrame, **fields: Column) -> DataFrame:
    filled = {c: text(fields.get(c, F.lit(""))) for c in ("title", "authors", "year", "summary", "url", "doi", "arxiv_id")}
    return rows.select("source_key", "qid", (F.col("pos") + 1).alias("rank"), *[v.alias(c) for c, v in filled.items()])


def _rows(df: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = df.select("source_key", "qid", F.from_json("payload", schema).alias("d"))
    return parsed.select("source_key", "qid", F.posexplode(F.filter(F.col(f"d.{path}"), lambda x: x.isNotNull())).alias("pos", "r"))


def arxiv(df: DataFrame) -> DataFrame:
    """Entries of an Atom feed."""
    bare = F.regexp_replace("payload", r'\sxmlns(:\w+)?="[^"]*"', "")
    entries = F.regexp_extract_all(bare, F.lit(r"(?s)(<entry>.*?</entry>)"), F.lit(1))
    rows = df.select("source_key", "qid", F.posexplode(entries).alias("pos", "e"))
    one = lambda p: strip(F.coalesce(F.xpath_string("e", F.lit(p)), F.lit("")))
    rows = rows.select("*", one("entry/title").alias("title"), one("entry/summary").alias("summary"), one("entry/published").alias("published"), one("entry/id").alias("id"), one("entry/link[@rel='alternate']/@href").alias("link"), F.xpath("e", F.lit("entry/author/name/text()")).alias("names"))
    url = F.when(F.col("link") != "", F.col("link")).otherwise(F.col("id"))
    key = F.when(L.arxiv_in(url) != "", L.arxiv_in(url)).otherwise(L.arxiv_in(F.col("id")))
    return _items(rows, title=F.col("title"), authors=format_authors(F.col("names")), year=L.year_of(F.col("published")), summary=short_text(F.col("summary")), url=url, arxiv_id=key)


def openalex(df: DataFrame) -> DataFrame:
    rows = _rows(df, "results array<struct<id:string,display_name:string,publication_year:string,doi:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string>>>", "results")
    doi = F.regexp_replace(F.lower(strip(text(F.col("r.doi")))), r"^https://doi\.org/", "")
    landing = strip(text(F.col("r.primary_location.landing_page_url")))
    url = F.when(landing != "", landing).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(strip(text(F.col("r.id"))))
    names = F.transform(F.col("r.authorships"), lambda a: a["author"]["display_name"])
    return _items(rows, title=strip(text(F.col("r.display_name"))), authors=format_authors(names), year=L.year_of(F.col("r.publication_year")), summary=L.abstract_of_index(F.col("r.abstract_inverted_index")), url=url, doi=doi)


def semanticscholar(df: DataFrame) -> DataFrame:
    rows = _rows(df, "data array<struct<title:string,year:string,abstract:string,url:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string,ArXiv:string>>>", "data")
    doi = F.lower(strip(text(F.col("r.externalIds.DOI"))))
    url = strip(text(F.col("r.url")))
    url = F.when((url == "") & (doi != ""), F.concat(F.lit("https://doi.org/"), doi)).otherwise(url)
    return _items(rows, title=strip(text(F.col("r.title"))), authors=format_authors(F.col("r.authors.name")), year=L.year_of(F.col("r.year")), summary=short_text(strip(text(F.col("r.abstract")))), url=url, doi=doi, arxiv_id=F.lower(strip(text(F.col("r.externalIds.ArXiv")))))


def crossref(df: DataFrame) -> DataFrame:
    rows = _rows(df, "message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:string,URL:string,abstract:string>>>", "message.items")
    doi = F.lower(strip(text(F.col("r.DOI"))))
    url = strip(text(F.col("r.URL")))
    url = F.when((url == "") & (doi != ""), F.concat(F.lit("https://doi.org/"), doi)).otherwise(url)
    names = F.transform(F.col("r.author"), lambda a: F.concat_ws(" ", F.nullif(strip(text(a["given"])), F.lit("")), F.nullif(strip(text(a["family"])), F.lit(""))))
    return _items(rows, title=strip(text(F.get("r.title", F.lit(0)))), authors=format_authors(names), year=L.year_of_json(F.col("r.issued")), summary=clean_snippet(strip(text(F.col("r.abstract")))), url=url, doi=doi)


def wikipedia(df: DataFrame) -> DataFrame:
    rows = _rows(df, "query struct<search:array<struct<title:string,snippet:string>>>", "query.search")
    title = strip(text(F.col("r.title")))
    place = F.regexp_replace(F.regexp_replace(F.url_encode(F.translate(title, " ", "_")), "%2F", "/"), r"\*", "%2A")
    url = F.when(title != "", F.concat(F.lit("https://en.wikipedia.org/wiki/"), place)).otherwise(F.lit(""))
    return _items(rows, title=title, summary=clean_snippet(F.col("r.snippet")), url=url)


def stackexchange(df: DataFrame) -> DataFrame:
    rows = _rows(df, "items array<struct<title:string,link:string,tags:array<string>,score:bigint,answer_count:bigint,is_answered:boolean,creation_date:bigint>>", "items")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    summary = F.concat(F.lit("tags: "), F.array_join(F.slice(F.coalesce("r.tags", F.array().cast("array<string>")), 1, 6), ", "), F.lit("; score: "), shown("r.score"), F.lit("; answers: "), shown("r.answer_count"), F.lit("; accepted/answered: "), F.when(F.col("r.is_answered"), "True").otherwise("False"))
    return _items(rows, title=strip(text(F.col("r.title"))), year=L.year_of_epoch(F.col("r.creation_date")), summary=short_text(summary), url=strip(text(F.col("r.link"))))


PARSERS = {"arxiv": arxiv, "openalex": openalex, "semanticscholar": semanticscholar, "crossref": crossref, "mathoverflow": stackexchange, "mathse": stackexchange, "wikipedia": wikipedia}


def known_sources(sources: list[str] | None) -> list[str]:
    """Lower-case names in order, each once; none given means all; an unknown one is an error."""
    wanted = [s.strip().lower() for s in sources or L.SOURCES]
    unknown = sorted(set(wanted) - set(PARSERS))
    if unknown:
        raise ValueError(f"unknown sources {', '.join(unknown)}; there are {', '.join(sorted(PARSERS))}")
    return list(dict.fromkeys(wanted))


def parse_payloads(payloads: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Items of all sources: ``source_key, qid, rank`` and the fields of a record; an unknown source is an error."""
    return reduce(DataFrame.unionByName, [PARSERS[s](_of(payloads, s)) for s in known_sources(sources)])


def arxiv_query(query: Column, categories: list[str] | None = None) -> Column:
    some = L.CATEGORIES if categories is None else categories
    base = F.concat(F.lit("(all:"), query, F.lit(")"))
    return F.concat(base, F.lit(f" AND ({' OR '.join(f'cat:{c}' for c in some)})")) if some else base


def request_urls(queries: DataFrame, sources: list[str] | None = None, per_source: int = 8, categories: list[str] | None = None, bases: dict[str, str] | None = None, hint: bool = True) -> DataFrame:
    """``source_key, qid, url`` of the search of every source for each ``(qid, query)``; ``bases`` replace addresses, for mirrors and tests."""
    asked = []
    for source in known_sources(sources):
        q = L.web_query(F.col("query"), hint)
        sent = arxiv_query(q, categories) if source == "arxiv" else q
        base = (bases or {}).get(source, ENDPOINTS[source])
        url = F.concat(F.lit(f"{base}?{ASKED_AS[source]}="), F.url_encode(sent), F.lit("&" + PARAMETERS[source].format(n=per_source)))
        asked.append(F.struct(F.lit(source).alias("source_key"), url.alias("url")))
    return queries.select("qid", F.explode(F.array(*asked)).alias("a")).select("a.source_key", "qid", "a.url")


@dataclass
class Gathered:
    """``items`` of all sources, ``failures(source_key, qid, code, message)``, ``diagnostics`` per source."""

    items: DataFrame
    failures: DataFrame
    diagnostics: DataFrame


def gather(queries: DataFrame, sources: list[str] | None = None, per_source: int = 8, categories: list[str] | None = None, bases: dict[str, str] | None = None, hint: bool = True, workers: int = 8, **options) -> Gathered:
    """Ask every source for each query. A source that fails or answers nonsense is a row of failures; the others go on.

    Requests are repeated by their status (see :func:`folioscan.sources.http.fetch`), ``workers`` of them side by side.
    """
    names = known_sources(sources)
    urls = cut(request_urls(queries, names, per_source, categories, bases, hint), "requests")
    fetched = fetch_frame(urls, workers=workers, status_aware=True, **options)
    answers = cut(urls.join(fetched, "url").withColumnRenamed("content", "payload"), "answers")
    is_feed = F.col("source_key") == "arxiv"
    readable = F.when(is_feed, F.col("payload").rlike("<feed[\\s>]")).otherwise(F.try_parse_json("payload").isNotNull())
    lost = F.when(~F.col("ok"), F.col("code")).when(~readable, F.lit("PARSE_ERROR"))
    message = F.when(~F.col("ok"), F.col("error")).otherwise(F.lit("the answer cannot be read"))
    failures = answers.select("source_key", "qid", lost.alias("code"), message.alias("message")).filter("code IS NOT NULL")
    items = cut(parse_payloads(answers.filter(lost.isNull()).select("source_key", "qid", "payload"), names), "items")
    by_source = failures.groupBy("source_key").agg(F.min_by("code", "qid").alias("code"), F.min_by("message", "qid").alias("message"))
    asked = F.col("source_key").isin(names)
    return Gathered(items, failures, source_diagnostics(items, by_source).filter(asked))
