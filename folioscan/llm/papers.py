"""Cleaning of literature records: identifiers, abstracts, names, titles (shared by matching and survivorship)."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_BLANK = re.compile(r"[\s​-‏⁠﻿­]+")
_DOI_LEAD = re.compile(r"^(?:https?://[^/]*/|(?:dx\.)?doi\.[a-z.]+/|(?:urn:)?doi:)+(?=.)")
_ARXIV_LEAD = re.compile(r"^(?:https?://\S*/|[a-z.]+\.[a-z]+/(?:abs|pdf)/|arxiv:)+")
_DOI = re.compile(r"10\.\d{4,9}/.+")
_WORDLIKE = re.compile(r"\w")
_LETTERS = re.compile(r"[^\W_]+")
_ARXIV = re.compile(r"(\d\d(?:0[1-9]|1[0-2])\.\d{4,5})(v\d+)?")
_TAGS_LINE = re.compile(r"^\W*tags?\s*:.*\bscore\s*:", re.I | re.S)
# Words that stand-ins for an abstract are made of (a list of this project, not of a standard).
STANDIN = set(
    """abstract abstracts summary description text no not none null nil na n a tba tbd tbc to be announced added
    determined unavailable available missing provided given supplied by the publisher author authors this is for item
    record currently yet pending coming soon unknown empty withheld omitted see full here found""".split()
)
NOTICE = re.compile(r"^(?:record created by|this (?:content|item|record|article|document) is (?:available|only|not)|the metadata of this|please sign in|access to this|you do not have access|sign in to|subscribe|copyright|\(c\)|©)", re.I)


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def valid_doi(value: str | None) -> str | None:
    """The DOI in lower case without blanks and what decorates it, or None."""
    bare = _BLANK.sub("", value or "").lower()
    bare = _DOI_LEAD.sub("", bare)
    return bare if _DOI.fullmatch(bare) else None


def valid_arxiv(value: str | None) -> str | None:
    """The identifier in lower case with its version, or None."""
    bare = _BLANK.sub("", value or "").lower()
    bare = re.sub(r"\.pdf$", "", _ARXIV_LEAD.sub("", bare))
    return bare if _ARXIV.fullmatch(bare) else None


def plain_words(text: str | None) -> list[str]:
    """Words without mark-up; a cut's dots are no word."""
    bare = _TAG.sub(" ", html.unescape(text or ""))
    bare = re.sub(r"(?:\.{3,}|…)\s*$", "", bare.strip())
    return [w for w in bare.split() if w.isalnum() or _WORDLIKE.search(w) or w in ("=", "+", "-")]


def letters(text: str | None) -> list[str]:
    return _LETTERS.findall(fold(_TAG.sub(" ", html.unescape(text or ""))))


def repeats_title(words: list[str], titles: list[list[str]]) -> bool:
    """A short text most of whose longer words are a title's, in other case or spelling or not."""
    longer = [w[:4] for w in words if len(w) > 3]
    for title in titles:
        if len(title) < 2 or len(words) > 2 * len(title) + 4:
            continue
        heads = {t[:4] for t in title}
        if len(longer) > 1 and sum(w in heads for w in longer) >= 0.6 * len(longer):
            return True
        a, b = "".join(words), "".join(title)
        if a.startswith(b) or b.startswith(a):
            return True
    return False


def abstract(summary: str | None, titles: list[list[str]] = ()) -> list[str]:
    """The words of an abstract, whole or cut; [] for stand-ins, notices, tag and score lines and repeats of a title."""
    if not summary:
        return []
    plain = re.sub(r"\s+", " ", _TAG.sub(" ", html.unescape(summary))).strip()
    words = letters(summary)
    if not words or _TAGS_LINE.match(plain) or NOTICE.match(plain):
        return []
    if len(words) <= 12 and all(w in STANDIN for w in words):
        return []
    if repeats_title(words, list(titles)):
        return []
    return plain_words(summary)


# --- titles and names, for matching

# Words that open a note on another paper, and number words of parts (lists of this project, not of a standard).
NOTES = ("addendum", "addenda", "erratum", "errata", "corrigendum", "corrigenda", "correction", "corrections", "retraction", "comment", "comments", "reply", "response", "supplement")
PARTS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "first": 1, "second": 2, "third": 3}
ROMAN = ("ii", "iii", "iv", "vi", "vii", "viii", "ix")
_QUESTION = re.compile(r"\ba question\s*\W*$|^(?:is|are|what|why|how does|how do|how can|does|do|can|when|where|which|any)\b.*\?\s*$|^(?:intuition|reference|motivation|explanation|references|clarification|question|help|example|examples)\b.{0,20}\b(?:behind|for|of|about|on|regarding|with|in)\b", re.I)
_SIDE = re.compile(r"^\s*(?:\[[^\]]{0,30}\]|\([^)]{0,30}\))\s*|\s*(?:\[[^\]]{0,30}\]|\((?:preprint|v\d+|version[^)]*|draft|revised|accepted[^)]*|to appear|submitted|extended version|arxiv[^)]*)\))\s*(?=[.\s]*$)", re.I)
_INNER = re.compile(r"\[(?:preprint|v\d+|draft|revised)\]|\((?:preprint|v\d+|draft|revised)\)", re.I)
_LEAD = re.compile(r"^\s*(?:article|paper|preprint|chapter|book chapter|conference paper|journal article|title)\s*[:.]\s*", re.I)
_IN = re.compile(r"[.,;]?\s+in:\s.*$", re.I)


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters are changed, lost, added or swapped with their neighbours."""
    # Each change alters at most two of the letters that occur.
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return False
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return False
        older, old = old, new
    return old[-1] <= most


@lru_cache(maxsize=1 << 16)
def _mended(token: str) -> str:
    """Digits and letter pairs that scans mistake for letters."""
    token = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", token)
    return re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", token).replace("rn", "m")


@lru_cache(maxsize=1 << 16)
def _note(token: str) -> str:
    """The opening word of a note that the token is, misspelled or not, or an empty text."""
    return next((n for n in NOTES if near(token, n.replace("rn", "m"), 2 if len(n) > 6 else 1)), "")


def read_title(title: str | None) -> dict:
    """Tokens and marks of a title: ``tokens, part, note, question, cut``."""
    raw = _TAG.sub(" ", html.unescape(title or ""))
    for _ in range(2):
        raw = _LEAD.sub("", _SIDE.sub(" ", _INNER.sub(" ", raw)))
    raw = _IN.sub("", raw).strip()
    cut = bool(re.search(r"(?:\.{3,}|…)\W*$", raw))
    question = bool(_QUESTION.search(raw))
    raw = re.sub(r":?\s*a question\W*$", "", raw, flags=re.I)
    tokens = [_mended(t) for t in _LETTERS.findall(fold(raw).replace("-", " ").replace("&", " and "))]
    part, tail = 0, tokens[-4:]
    at = next((i for i, t in enumerate(tail) if i and t in ("part", "pt", "prat", "patr") and len(tokens) > 3), -1)
    if at > 0:  # the words may have been swapped with their neighbours
        rest = tail[at + 1 :]
        part = next((PARTS.get(t) or int(t) for t in reversed(rest) if t in PARTS or t.isdecimal()), 99)
        tokens = tokens[: len(tokens) - len(tail) + at] + [t for t in rest if t not in PARTS and not t.isdecimal()]
    elif len(tokens) > 2 and (hit := next((t for t in tokens[-1:] + tokens[-2:-1] if t in ROMAN), None)):
        part = PARTS[hit]
        tokens = tokens[:-2] + [t for t in tokens[-2:] if t != hit]
    elif len(tokens) > 2 and tokens[-1] in ("i", "v", "x"):
        part, tokens = PARTS[tokens[-1]], tokens[:-1]
    note = ""
    if tokens and (hit := _note(tokens[0])):
        if re.match(r"^\W*\w+\s*(?::|to\b|on\b|for\b)", fold(raw)):
            note, tokens = hit, tokens[1:]
            if tokens and tokens[0] in ("to", "on", "for"):
                tokens = tokens[1:]
    return {"tokens": tokens, "part": part, "note": note, "question": question, "cut": cut}


def surnames(authors: str | None) -> tuple[list[str], bool]:
    """Folded surnames in order, and whether the list is cut (``et al.``)."""
    text = re.sub(r"\s+", " ", authors or "").strip()
    cut = bool(re.search(r"\bet\.? al\b|\band others\b|\bu\. a\.", text, re.I))
    text = re.sub(r",?\s*\b(?:et\.? al\b\.?|and others|u\. a\.).*$", "", text, flags=re.I).strip(" ,;")
    if not text:
        return [], cut
    if ";" in text or re.fullmatch(r"[^,]+,\s*(?:\w\.?[\s-]*){1,3}", text):
        parts = [p.split(",")[0] if "," in p else p for p in text.split(";")]
        names = [fold(p).strip() for p in parts]
        names = [n.split()[-1] if "," not in p and len(n.split()) > 1 else n.replace(" ", "") for n, p in zip(names, text.split(";"))]
    else:
        names = []
        for p in re.split(r",|\band\b|&", text):
            tokens = [t for t in p.split() if len(t.strip(".")) > 1]
            if tokens:
                upper = [t for t in tokens if t.isupper() and len(t) > 2]
                names.append(fold(upper[0] if upper and len(upper) < len(tokens) else tokens[-1]))
    return list(dict.fromkeys(re.sub(r"[^a-z0-9ß-￿]", "", n) for n in names if n)), cut


def read_year(value: str | None) -> int:
    found = re.search(r"(?:19|20)\d\d", value or "")
    return int(found[0]) if found else 0
