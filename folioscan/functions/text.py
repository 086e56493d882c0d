"""Text functions of the corpus pipeline as column expressions.

A missing text counts as empty. Blanks are Unicode blanks unless said otherwise.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.fold import fold_accents

# Query terms and what is added for them, in this order.
QUERY_EXPANSIONS = [("概形", "scheme"), ("层", "sheaf"), ("平坦", "flat"), ("态射", "morphism"), ("代数栈", "algebraic stack"), ("上同调", "cohomology"), ("余切", "cotangent"), ("除子", "divisor"), ("定义", "definition"), ("引理", "lemma"), ("定理", "theorem"), ("证明", "proof")]
# Elements that start a new line of text.
BLOCK_ELEMENTS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A whole tag, for the engine's regular expressions.
TAG = r"""</?[A-Za-z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""


def text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def compact(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"(?U)\s+", " "))


_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)  # comments and declarations
    |</?(?P<tag>[A-Za-z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*>
    |(?P<text>[^<]+|<)""",
    re.S | re.X,
)
_RAW = {"script", "style"}  # elements whose text is not mark-up


def plain_text(source: str | None, keep_scripts: bool = True) -> str:
    """Text of an HTML fragment: block elements break lines, entities are decoded, comments go; runs of blanks collapse."""
    source, out, at = source or "", [], 0
    while at < len(source):
        piece = _PIECE.match(source, at)
        if piece is None:  # a tag that never ends is no text
            break
        at = piece.end()
        if piece["text"]:
            out.append(html.unescape(piece["text"]))
        elif piece["tag"]:
            name, opens = piece["tag"].lower(), source[piece.start() + 1] != "/"
            out.append("\n" if name in BLOCK_ELEMENTS else "")
            if opens and name in _RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                end = closing.start() if closing else len(source)
                out.append(source[at:end] if keep_scripts else "")
                at = end
    joined = re.sub(r"[ \t\f\v]+", " ", "".join(out))
    return re.sub(r"\n\s*\n+", "\n\n", joined).strip()


@F.pandas_udf(T.StringType())
def _parsed(source: pd.Series) -> pd.Series:
    return source.map(lambda x: None if x is None else plain_text(x))


def html_to_text(source: Column | str) -> Column:
    """:func:`plain_text`; null gives the empty text.

    Fragments of nothing but whole tags and text, without entities, are read by
    the engine itself; only the others are sent to Python.
    """
    c = text(F.col(source) if isinstance(source, str) else source)
    left_over = F.regexp_replace(c, TAG, "")
    simple = ~F.contains(c, F.lit("&")) & ~left_over.rlike("<") & ~c.rlike(r"(?i)<(?:script|style)\b")
    names = "|".join(sorted(BLOCK_ELEMENTS))
    broken = F.regexp_replace(c, rf"(?i)</?(?:{names})(?=[\s/>])[^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>", "\n")
    joined = F.regexp_replace(F.regexp_replace(broken, TAG, ""), r"[ \t\f\x0B]+", " ")
    here = strip(F.regexp_replace(joined, r"(?U)\n\s*\n+", "\n\n"))
    return F.when(simple, here).otherwise(_parsed(F.when(~simple, c)))


def normalize_math(column: Column) -> Column:
    r"""Formulas as words: ``\mathcal{X}`` and ``\mathbf{X}`` give X, arrows and named functors words, other commands their names."""
    c = F.regexp_replace(text(column), r"\\math(?:cal|bf)\{([A-Za-z])\}", "$1")
    for name in ("to", "mapsto", "Spec", "Hom"):
        c = F.regexp_replace(c, rf"\\{name}", f" {name} ")
    c = F.translate(c, "${}^_", "     ")
    return compact(F.regexp_replace(c, r"\\([A-Za-z]+)", " $1 "))


def tag_refs(source: Column) -> Column:
    """Distinct tags of ``/tag/XXXX`` links in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text(source), F.lit("/tag/([0-9A-Z]{4})"), F.lit(1)))


def tokenize(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(column)), F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def unicode_tokens(column: Column) -> Column:
    """Tokens of the lexical index: letters, digits and private-use signs, folded."""
    return F.regexp_extract_all(fold_accents(text(column)), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def sha256(column: Column) -> Column:
    return F.sha2(text(column), 256)


def lines(*columns: Column) -> Column:
    """Non-empty texts joined by line ends, trimmed."""
    return strip(F.concat_ws("\n", *[F.when(text(c) != "", text(c)) for c in columns]))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the texts joined by line ends, empty ones included."""
    return F.sha2(F.concat_ws("\n", *[text(c) for c in columns]), 256)


def doc_content(title: Column, statement: Column, proof: Column, normalized: Column) -> Column:
    return F.concat_ws("\n", *[F.when(text(c) != "", text(c)) for c in (title, statement, proof, normalized)])


def env_hint(label: Column, chapter: Column) -> Column:
    """What follows the chapter in a label, up to the next hyphen."""
    prefix = F.concat(chapter, F.lit("-"))
    tail = F.when(F.startswith(label, prefix), label.substr(F.length(prefix) + 1, F.length(label))).otherwise(label)
    return F.substring_index(tail, "-", 1)


def structure_fields(source: Column) -> Column:
    """``reference, name, type`` of a structure document; broken ones and the sentinel text give nulls."""
    return F.from_json(strip(text(source)), "reference string, name string, type string")


def env_type(statement_html: Column, hint: Column) -> Column:
    found = F.lower(F.regexp_extract(text(statement_html), r'class="env-([a-zA-Z0-9\-]+)"', 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(F.lower(text(hint)), F.lit("")), F.lit("unknown"))


def heading(statement_html: Column) -> Column:
    return F.regexp_extract(text(statement_html), r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)


def reference_number(statement_html: Column) -> Column:
    return F.regexp_extract(text(statement_html), r'data-tag="[0-9A-Z]{4}">([^<]+)</span>', 1)


def split_proof(statement: Column, full: Column) -> Column:
    """The proof: what the full text has beyond the statement it starts with; all of it if it starts otherwise."""
    s, f = strip(text(statement)), strip(text(full))
    return F.when(f == "", F.lit("")).when((s != "") & F.startswith(f, s), strip(f.substr(F.length(s) + 1, F.length(f)))).when(f != s, f).otherwise(F.lit(""))


def expand_query(query: Column) -> Column:
    """The query and the terms that its known needles stand for."""
    added = F.array_compact(F.array(*[F.when(F.contains(query, F.lit(k)), F.lit(v)) for k, v in QUERY_EXPANSIONS]))
    return F.concat_ws(" ", query, F.when(F.size(added) > 0, F.array_join(added, " ")))


def slug(column: Column) -> Column:
    made = F.lower(F.btrim(F.regexp_replace(text(column), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-")))
    return F.when(made == "", F.lit("unnamed")).otherwise(made)


def metric(metrics: Column, key: str) -> Column:
    """A number of a map of texts or numbers; absent or no number gives 0."""
    return F.coalesce(F.try_element_at(metrics, F.lit(key)).cast("string").try_cast("double"), F.lit(0.0))


def k_values(column: Column) -> Column:
    """Sorted distinct whole numbers of a comma-separated list."""
    parts = F.transform(F.split(text(column), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("int"))))


def csv_values(column: Column, lower: bool = False, default: Sequence[str] = ()) -> Column:
    """Distinct trimmed values of a comma-separated list in order; ``default`` if there are none."""
    parts = F.filter(F.transform(F.split(F.lower(text(column)) if lower else text(column), ","), lambda x: strip(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array(*[F.lit(x) for x in default]).cast("array<string>"))


def format_authors(names: Column, most: int = 6) -> Column:
    clean = F.filter(F.transform(names, lambda x: strip(text(x))), lambda x: x != "")
    return F.when(F.size(clean) > most, F.concat(F.array_join(F.slice(clean, 1, most), ", "), F.lit(", et al."))).otherwise(F.coalesce(F.array_join(clean, ", "), F.lit("")))


def short_text(column: Column, limit: int = 420) -> Column:
    c = compact(text(column))
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(c)


def clean_snippet(column: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text(column), "<[^>]+>", " "), "&[A-Za-z0-9#]+;", " ")
    return short_text(bare)


def snippet(column: Column, limit: int) -> Column:
    """One line, cut with dots at ``limit``."""
    c = strip(F.regexp_replace(text(column), "\n", " "))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)
