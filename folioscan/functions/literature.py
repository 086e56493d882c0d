"""Functions over literature records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import let, short_text, strip, text

# Sources in order, their labels and weights, and the terms of the query tests.
SOURCES = ["arxiv", "openalex", "semanticscholar", "crossref", "mathoverflow", "mathse", "wikipedia"]
LABELS = {"arxiv": "arXiv", "openalex": "OpenAlex", "semanticscholar": "Semantic Scholar", "crossref": "Crossref", "mathoverflow": "MathOverflow", "mathse": "Math StackExchange", "wikipedia": "Wikipedia"}
WEIGHTS = {"arxiv": 1.0, "openalex": 0.92, "semanticscholar": 0.88, "crossref": 0.8, "mathoverflow": 0.82, "mathse": 0.72, "wikipedia": 0.58}
CATEGORIES = ["math.AG", "math.AC", "math.RT", "math.NT", "math.KT", "math.RA", "math.AT"]
DOMAIN_TERMS = ["scheme", "morphism", "sheaf", "stack", "moduli", "cohomology", "divisor", "etale", "flat", "affine", "proper", "algebraic geometry", "代数几何", "概形", "层", "态射", "上同调", "平坦"]
FRESH_TERMS = ["latest", "recent", "state of the art", "state-of-the-art", "trend", "trends", "survey", "surveys", "survey paper", "review", "reading list", "比较", "进展", "最新", "最新进展", "综述", "发展"]
RECENCY, RECENCY_FRESH = 0.25, 0.40
# The patterns of years, DOIs and arXiv identifiers.
YEAR_PATTERN = r"((?:19|20)\d{2})"
DOI_PATTERN = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ARXIV_PATTERN = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|^)(\d{4}\.\d{4,5}(?:v\d+)?)"


def contains_any(column: Column, terms: list[str]) -> Column:
    return let(F.lower(column), lambda c: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t)))


def year_of(value: Column) -> Column:
    """The first year 19xx or 20xx in a text, or empty."""
    return F.regexp_extract(text(value), YEAR_PATTERN, 1)


def year_of_json(value: Column) -> Column:
    """Year of a loosely typed JSON value: a number, a text, or ``{"date-parts": [[y, ...]]}``."""
    v = F.try_parse_json(value)
    number = F.try_variant_get(v, "$", "bigint").cast("string")
    part = F.try_variant_get(v, "$['date-parts'][0][0]", "string")
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), number).when(kind == "STRING", year_of(F.try_variant_get(v, "$", "string"))).otherwise(F.when(part.rlike(r"^\d+$"), part).otherwise(year_of(part)))


def year_of_epoch(seconds: Column) -> Column:
    return F.when(seconds > 0, F.year(F.timestamp_seconds(seconds)).cast("string")).otherwise(F.lit(""))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(title)), "[^a-z0-9]+", " "))


def doi_in(value: Column) -> Column:
    return F.lower(F.regexp_extract(text(value), DOI_PATTERN, 1))


def arxiv_in(value: Column) -> Column:
    return F.lower(F.regexp_extract(strip(text(value)), ARXIV_PATTERN, 1))


def canonical_key(doi: Column, arxiv: Column, url: Column, title: Column) -> Column:
    """The strongest key of a record: DOI, arXiv id, either of them in the URL, title, URL; else empty."""
    low = lambda c: F.lower(strip(text(c)))
    keyed = lambda prefix, value: F.when(value != "", F.concat(F.lit(prefix), value))
    return F.coalesce(keyed("doi:", low(doi)), keyed("arxiv:", low(arxiv)), keyed("doi:", doi_in(low(url))), keyed("arxiv:", arxiv_in(low(url))), keyed("title:", title_key(title)), keyed("url:", low(url)), F.lit(""))


def abstract_of_index(index: Column, most: int = 5000) -> Column:
    """Text of an inverted index ``map<word, array<position>>``; of words on one place the last stays; beyond ``most`` places none."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    kept = F.filter(places, lambda x: x["p"] >= 0)
    last = F.array_max(F.transform(kept, lambda x: x["p"]))
    numbered = F.transform(kept, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    ordered = F.array_sort(numbered)
    winning = F.filter(ordered, lambda x, i: (i + 1 >= F.size(ordered)) | (F.get(ordered, i + 1)["p"] != x["p"]))
    joined = F.array_join(F.filter(F.transform(winning, lambda x: x["w"]), lambda w: w != ""), " ")
    return F.when(last.isNull() | (last > most), F.lit("")).otherwise(short_text(joined))


def query_tokens(query: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(query)), F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3))


def web_query(query: Column, hint: bool = True) -> Column:
    return F.when(contains_any(query, DOMAIN_TERMS) | F.lit(not hint), query).otherwise(F.concat(query, F.lit(" algebraic geometry")))


def prefers_fresh(query: Column) -> Column:
    return contains_any(query, FRESH_TERMS)


def source_weight(source: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weight, source), F.lit(0.5))


def source_rank_score(source: Column, rank: Column) -> Column:
    return source_weight(source) / (1.0 + 0.12 * F.greatest(rank - 1, F.lit(0)))


def overlap(title: Column, summary: Column, tokens: Column) -> Column:
    """Share of the query's tokens that occur, also inside words, in title and summary."""
    hay = F.lower(F.concat_ws(" ", text(title), text(summary)))
    return F.when(F.size(tokens) > 0, let(hay, lambda h: F.size(F.filter(tokens, lambda t: F.contains(h, t)))) / F.size(tokens)).otherwise(F.lit(0.0))


def recency(year: Column, now_year: int) -> Column:
    y = year.try_cast("int")
    age = F.greatest(F.lit(now_year) - y, F.lit(0))
    steps = F.when(age <= 1, 1.0).when(age <= 3, 0.8).when(age <= 6, 0.55).when(age <= 10, 0.3).otherwise(0.12)
    return F.when(y.isNull() | (y <= 1900) | (y > now_year + 1), F.lit(0.0)).otherwise(steps)


def item_score(rank_signal: Column, overlap_: Column, recency_: Column, n_sources: Column, has_id: Column, fresh: Column) -> Column:
    weight = F.when(fresh, RECENCY_FRESH).otherwise(RECENCY)
    return rank_signal + 0.45 * overlap_ + weight * recency_ + F.least(0.08 * n_sources, F.lit(0.24)) + F.when(has_id, 0.08).otherwise(0.0)


def local_citation(cid: Column, tag: Column, title: Column, reference: Column, url: Column) -> Column:
    part = lambda c: F.nullif(text(c), F.lit(""))
    return F.concat_ws(", ", F.concat(F.lit("["), cid, F.lit("]")), F.concat(F.lit("Tag "), part(tag)), part(reference), part(title), part(url))


def paper_citation(cid: Column, authors: Column, title: Column, year: Column, source: Column, url: Column) -> Column:
    part = lambda c: F.nullif(text(c), F.lit(""))
    return F.concat_ws(", ", F.concat(F.lit("["), cid, F.lit("]")), part(title), part(authors), part(year), part(source), part(url))
