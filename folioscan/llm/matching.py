"""Matching works across sources that share no key.

Candidates come from MinHash blocks over several attributes together; pairs get
similarity features; a logistic classifier fitted on weak labels, calibrated on
held-out ones, gives the probability that two items are one work.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.mixing import source_key
from folioscan.llm.papers import abstract, letters, near, read_title, read_year, surnames, valid_arxiv, valid_doi
from folioscan.operators.skew import hot_keys, lookup_join
from folioscan.session import brief_shuffles, cut, scratch_path, uncut

PREPARED = "item_id bigint, source string, tokens array<string>, stems array<string>, part int, note string, question boolean, cut boolean, names array<string>, et_al boolean, year int, doi string, arxiv string, abstract array<int>"
COMPARED = ["tokens", "part", "note", "question", "cut", "names", "et_al", "year", "doi", "arxiv", "abstract"]
STEM = 4  # letters of a word that an abbreviation keeps
COMMON = 0.04  # stems in a larger share of titles say nothing about a work
PERMUTATIONS = 8
SURE = 0.9  # confidence from which a link may carry others
PART = 500  # items of a block whose pairs with all of the block are one task's work
TILE = 6  # meetings in blocks, for each item, that are compared at a time; what a comparison shuffles takes this share of the disk
HEAD = 40  # words of an abstract that tell whether two can be alike, before they are read
LEAST_TILE = 1_000_000  # meetings that are compared at a time in any case


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    text = lambda x: x if isinstance(x, str) else None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            title = read_title(text(r.title))
            names, et_al = surnames(text(r.authors))
            arxiv = valid_arxiv(text(r.arxiv_id))
            arxiv = arxiv.split("v")[0] if arxiv else ""
            words = [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in letters(" ".join(abstract(text(r.summary), [letters(text(r.title))])))]
            stems = list(dict.fromkeys(t[:STEM] for t in title["tokens"] if len(t) > 2))
            out.append((r.item_id, r.source, title["tokens"], stems, title["part"], title["note"], title["question"], title["cut"], names, et_al, read_year(text(r.year)), valid_doi(text(r.doi)) or "", arxiv, words))
        names_ = [f.split()[0] for f in PREPARED.split(", ")]
        yield pd.DataFrame(out, columns=names_).astype({"item_id": "int64", "part": "int32", "year": "int32"})


def _slot_of(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def prepare(papers: DataFrame) -> DataFrame:
    """Cleaned rows, one for each ``item_id``; of differing rows of one item the first in the order of their values."""
    used = papers.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), source_key(F.col("source")).alias("source"), *[F.col(c).cast("string").alias(c) for c in ("title", "authors", "year", "summary", "doi", "arxiv_id")])
    rest = [c for c in used.columns if c != "item_id"]
    one = used.groupBy("item_id").agg(F.min(F.struct(*rest)).alias("r")).select("item_id", "r.*")
    return one.mapInPandas(_prepare, PREPARED)


def common_stems(items: DataFrame) -> list[str]:
    """Stems in more than ``COMMON`` of the titles: at most (stems per title) / COMMON, some hundred."""
    n = items.count()
    return sorted(r.s for r in items.select(F.explode("stems").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.lit(max(2.0, COMMON * n))).collect())


def block_keys(items: DataFrame, common: list[str]) -> DataFrame:
    """``item_id, key, open, nameless``: the blocks of each item.

    (surname, title stem of a MinHash permutation); (two MinHash stems) for pairs
    of which one has no authors (``open`` marks those that may only meet such a
    one); the DOI; the arXiv identifier; the opening of the abstract.
    """
    rare = F.array_except("stems", F.array(*[F.lit(s) for s in common]).cast("array<string>"))
    items = items.withColumn("more", F.when(F.size(rare) > 0, rare).otherwise(F.col("stems")))
    minimum = lambda seed: F.array_min(F.transform("more", lambda s: F.struct(F.xxhash64(F.lit(seed), s).alias("h"), s.alias("s"))))["s"]
    items = items.withColumn("mins", F.array_distinct(F.array_compact(F.array(*[minimum(k) for k in range(PERMUTATIONS)]))))
    by_name = F.flatten(F.transform("names", lambda n: F.transform("mins", lambda m: F.concat(F.lit("a/"), n, F.lit("/"), m))))
    two = F.flatten(F.transform("mins", lambda a: F.transform(F.filter("mins", lambda b: b > a), lambda b: F.concat(F.lit("t/"), a, F.lit("/"), b))))
    two = F.when(F.size("mins") > 1, two).otherwise(F.transform("mins", lambda m: F.concat(F.lit("t/"), m, F.lit("/"))))
    exact = F.array_compact(F.array(F.when(F.col("doi") != "", F.concat(F.lit("d/"), "doi")), F.when(F.col("arxiv") != "", F.concat(F.lit("x/"), "arxiv")), F.when(F.size("abstract") >= 10, F.concat(F.lit("s/"), F.concat_ws(" ", F.slice("abstract", 1, 10).cast("array<string>"))))))
    closed = items.select("item_id", F.explode(F.array_distinct(F.concat(by_name, exact))).alias("key"), F.lit(False).alias("open"), F.lit(False).alias("nameless"))
    titled = items.select("item_id", F.explode(F.array_distinct(two)).alias("key"), F.lit(True).alias("open"), (F.size("names") == 0).alias("nameless"))
    return closed.unionByName(titled)


def candidate_blocks(items: DataFrame, common: list[str]) -> tuple[DataFrame, float]:
    """(``item_id, key, open, nameless, parts``, number of meetings in blocks): the blocks, ready to be joined.

    No block is cut or split by other keys, whatever its size. For balance alone
    the left side of a block goes in parts of about ``PART`` items to as many
    tasks, each of which sees the whole right side.
    """
    keys = cut(block_keys(items, common).withColumn("parts", F.lit(1)), "keys")
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(_first()).alias("m"), F.bool_or("open").alias("open"))
    sizes = cut(counted.filter("n > 1"), "blocks")
    meetings = sizes.agg(F.sum(F.when(F.col("open"), F.col("m") * (F.col("n") - 1.0)).otherwise(F.col("n") * (F.col("n") - 1.0) / 2))).first()[0] or 0.0
    large = sizes.filter(F.col("m") > PART).select("key", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    if large.isEmpty():
        uncut(sizes)
        return keys, meetings
    joined = lookup_join(keys.drop("parts"), large, "key", hot_keys(sizes, "key", "n", keys.count()), "left")
    blocks = cut(joined.withColumn("parts", F.coalesce("parts", F.lit(1))), "blocks")
    uncut(keys, sizes)
    return blocks, meetings


def _first() -> Column:
    """An item that may be the left side of a pair."""
    return ~F.col("open") | F.col("nameless")


def _slice_of(column: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), F.col(column)), F.lit(slices))


def pairs_of(blocks: DataFrame, i: int = 0, j: int = 0, slices: int = 1) -> DataFrame:
    """Distinct ``a < b`` that share a block, one item in slice ``i``, the other in ``j``; each pair is in one such tile."""
    left = blocks.filter(_first()).select("key", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"), F.col("item_id").alias("l"), "open")
    right = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("item_id").alias("r"))
    if slices > 1:
        one = lambda x, y: left.filter(_slice_of("l", slices) == x).join(right.filter(_slice_of("r", slices) == y), ["key", "part"])
        met = one(i, j) if i == j else one(i, j).unionByName(one(j, i))
    else:
        met = left.join(right, ["key", "part"])
    met = met.filter("IF(open, l <> r, l < r)")
    return met.select(F.least("l", "r").alias("item_id_a"), F.greatest("l", "r").alias("item_id_b")).distinct()


def candidate_pairs(items: DataFrame, common: list[str]) -> DataFrame:
    """All distinct ``a < b`` that share a block; items of one source may be the bridge between others."""
    return pairs_of(candidate_blocks(items, common)[0])


def _drawn(blocks: DataFrame, meetings: float, most: int) -> DataFrame:
    """Candidate pairs among which are the ``most`` with the smallest hash, without all others being written."""
    share = 8 * most / max(meetings, 1.0)
    while True:
        pairs = pairs_of(blocks)
        if share < 1:
            pairs = pairs.filter(F.xxhash64("item_id_a", "item_id_b") < F.lit(int(-(2**63) + share * 2**64)))
        drawn = cut(pairs, "drawn")
        if share >= 1 or drawn.count() >= most:
            return drawn
        uncut(drawn)
        share *= 8


# --- features

FEATURES = ["intercept", "title_most", "title_least", "title_all", "cut_cover", "names_same", "names_none", "names_other", "year_same", "year_off", "year_far", "doi_same", "doi_other", "arxiv_same", "arxiv_other", "abstract_same", "abstract_other", "part_other", "note_other", "question_other", "title_x_names", "title_x_blank", "id_x_names"]
WEIGHT = {"the": 0.2, "a": 0.2, "an": 0.2, "of": 0.2, "on": 0.2, "and": 0.2, "for": 0.2, "in": 0.2, "with": 0.2}


@lru_cache(maxsize=1 << 18)
def _word_match(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.95
    if min(len(a), len(b)) >= 4 and near(a, b, 1 if min(len(a), len(b)) < 8 else 2):
        return 0.9
    return 0.0


@lru_cache(maxsize=1 << 16)
def _name_match(a: str, b: str) -> bool:
    return a == b or (len(a) > 5 and near(a, b, 1))


def cover(left: list[str], right: list[str], common: set[str]) -> tuple[float, float]:
    """Weighted share of each title's words that the other has, allowing for typos and abbreviations."""
    weight = lambda t: WEIGHT.get(t, 1.0 if t[:STEM] in common else 3.0)
    free, lost, got = list(right), [], 0.0
    got_right = 0.0
    for t in left:
        if t in free:
            free.remove(t)
            got += weight(t)
            got_right += weight(t)
        else:
            lost.append(t)
    for t in lost:
        best, at = 0.0, -1
        for i, u in enumerate(free):
            m = _word_match(t, u)
            if m > best:
                best, at = m, i
        if at >= 0:
            got += best * weight(t)
            got_right += best * weight(free.pop(at))
    return got / max(sum(map(weight, left)), 1e-9), got_right / max(sum(map(weight, right)), 1e-9)


def features(a: dict, b: dict, common: set[str]) -> list[float]:
    """Similarity features of two prepared items."""
    x, y = cover(list(a["tokens"]), list(b["tokens"]), common)
    most, least = max(x, y), min(x, y)
    cut_cover = most if (a["cut"] and x >= y) or (b["cut"] and y >= x) else 0.0
    p, q = list(a["names"]), list(b["names"])
    none = not p or not q
    same = 0.0
    if not none:
        hits = sum(any(_name_match(n, m) for m in q) for n in p)
        shorter = min(len(p), len(q))
        same = hits / (shorter if a["et_al"] or b["et_al"] or abs(len(p) - len(q)) > 0 and shorter > 0 else max(len(p), len(q)))
        same = min(1.0, same)
    years = [i["year"] or (2000 + int(i["arxiv"][:2]) if i["arxiv"] else 0) for i in (a, b)]
    gap = abs(years[0] - years[1]) if all(years) else -1
    k = min(len(a["abstract"]), len(b["abstract"]))
    alike = sum(s == t for s, t in zip(a["abstract"], b["abstract"])) / k if k >= 5 else -1.0
    doi = a["doi"] and b["doi"]
    arxiv = a["arxiv"] and b["arxiv"]
    title = min(1.0, max(least, cut_cover))
    return [1.0, most, least, float(least > 0.97), cut_cover, same, float(none), float(not none and same == 0), float(gap == 0), float(0 < gap <= 2), float(gap > 3), float(bool(doi) and a["doi"] == b["doi"]), float(bool(doi) and a["doi"] != b["doi"]), float(bool(arxiv) and a["arxiv"] == b["arxiv"]), float(bool(arxiv) and a["arxiv"] != b["arxiv"]), float(alike >= 0.85), float(0 <= alike < 0.5), float(a["part"] != b["part"]), float(bool(a["note"]) != bool(b["note"])), float(bool(a["question"]) != bool(b["question"])), title * same, title * float(none), same * float(bool(doi) and a["doi"] == b["doi"] or bool(arxiv) and a["arxiv"] == b["arxiv"])]


def _feature_batches(common: set[str]):
    names = [f"{c}_{s}" for s in "ab" for c in COMPARED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = {n: batch[n].tolist() for n in names}
            rows = []
            for i in range(len(batch)):
                a, b = ({c: columns[f"{c}_{s}"][i] for c in COMPARED} for s in "ab")
                rows.append(features(a, b, common))
            yield pd.DataFrame({"item_id_a": batch["item_id_a"].to_numpy(), "item_id_b": batch["item_id_b"].to_numpy(), "x": rows})

    return run


def _worth_reading() -> Column:
    """False for pairs of which one has no authors, that share no identifier nor opening of an abstract, and under half of their title stems.

    The title is all such pairs could be told by; they are the bulk of the
    candidates, so they are left before any Python sees them.
    """
    nameless = (F.size("names_a") == 0) | (F.size("names_b") == 0)
    opening = lambda s: F.slice(f"abstract_{s}", 1, 5)
    known = [(F.col(f"{c}_a") != "") & (F.col(f"{c}_a") == F.col(f"{c}_b")) for c in ("doi", "arxiv")]
    said = (F.size(opening("a")) == 5) & (opening("a") == opening("b"))
    shorter = F.least(F.size("stems_a"), F.size("stems_b"))
    alike = F.size(F.array_intersect("stems_a", "stems_b")) * 2 >= shorter
    return ~nameless | known[0] | known[1] | said | alike


def worth_reading(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs that :func:`compared` will read, found with the few columns that decide it, so that no others carry whole items along."""
    brief = {"stems": F.col("stems"), "names": F.slice("names", 1, 1), "doi": F.col("doi"), "arxiv": F.col("arxiv"), "abstract": F.slice("abstract", 1, 5)}
    for s in "ab":
        pairs = pairs.join(items.select(F.col("item_id").alias(f"item_id_{s}"), *[c.alias(f"{n}_{s}") for n, c in brief.items()]), f"item_id_{s}")
    return pairs.filter(_worth_reading()).select("item_id_a", "item_id_b")


def compared(pairs: DataFrame, items: DataFrame, common: list[str], model: Classifier | None = None, threshold: float = 0.0) -> DataFrame:
    """``item_id_a, item_id_b, x``: the features of each pair that is worth reading; with ``model``, only of those that may reach the threshold."""
    columns = {c: F.col(c) for c in ["stems", *COMPARED]} | ({} if model is None else _outline(common))
    for s in "ab":
        pairs = pairs.join(items.select(F.col("item_id").alias(f"item_id_{s}"), *[c.alias(f"{n}_{s}") for n, c in columns.items()]), f"item_id_{s}")
    read, out = pairs.filter(_worth_reading()).drop("stems_a", "stems_b"), "item_id_a bigint, item_id_b bigint, x array<double>"
    if model is None:
        return read.mapInPandas(_feature_batches(set(common)), out)
    weights, least, compare = model.weights, model.least_logit(threshold), _feature_batches(set(common))
    wanted = ["item_id_a", "item_id_b", *[f"{c}_{s}" for s in "ab" for c in COMPARED]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(greatest_logit(batch, weights) >= least)).select(wanted)
            for found in compare([kept.to_pandas()] if kept.num_rows else []):
                x = pa.array(found["x"].tolist(), pa.list_(pa.float64()))
                yield pa.record_batch([pa.array(found["item_id_a"]), pa.array(found["item_id_b"]), x], ["item_id_a", "item_id_b", "x"])

    return read.mapInArrow(run, out)


# --- a bound, so that Python reads few pairs word by word


def _outline(common: list[str]) -> dict[str, Column]:
    """What :func:`greatest_logit` knows of an item: of each word its hash, that of its start, its letters as bits, length and weight; and the year."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64)))
    letters_in = lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(bit(c)))
    usual = F.array(*[F.lit(s) for s in common]).cast("array<string>")
    weight = lambda t: F.when(t.isin(*WEIGHT), 0.2).when(F.array_contains(usual, F.substring(t, 1, STEM)), 1.0).otherwise(3.0)
    words = {"hashes": lambda t: F.xxhash64(t), "starts": lambda t: F.xxhash64(F.substring(t, 1, 3)), "bits": letters_in, "lengths": lambda t: F.length(t), "weights": weight}
    dated = F.when(F.col("year") != 0, F.col("year")).when(F.col("arxiv") != "", F.substring("arxiv", 1, 2).cast("int") + 2000).otherwise(0)
    return {n: F.transform("tokens", f) for n, f in words.items()} | {"dated": dated}


def _padded(lists: pa.ListArray, low: int, high: int, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` first values of the lists of rows ``low`` to ``high`` as a matrix, and which of its cells hold one."""
    ends, values = lists.offsets.to_numpy()[low : high + 1], lists.values.to_numpy(zero_copy_only=False)
    sizes = np.minimum(np.diff(ends), most)
    at = np.arange(max(1, sizes.max(initial=0)))
    held = at < sizes[:, None]
    return (values if len(values) else np.zeros(1, values.dtype))[np.where(held, ends[:-1, None] + at, 0)], held


def _greatest_covers(batch: pa.RecordBatch, low: int, high: int) -> list[np.ndarray]:
    """Upper bounds of both results of :func:`cover`: every word counts that the other title has, or may have in another spelling."""
    a, b = ({n: _padded(batch[f"{n}_{s}"], low, high) for n in ("hashes", "starts", "bits", "lengths", "weights")} for s in "ab")
    p, q = ({n: np.expand_dims(v, side) for n, (v, _) in x.items()} for x, side in ((a, 2), (b, 1)))
    both = a["hashes"][1][:, :, None] & b["hashes"][1][:, None, :]
    same = both & (p["hashes"] == q["hashes"])
    shorter = np.minimum(p["lengths"], q["lengths"])
    most = np.where(shorter < 8, 1, 2)  # as in _word_match; each change alters at most two of the letters that occur
    close = (shorter >= 4) & (np.abs(p["lengths"] - q["lengths"]) <= most) & (np.bitwise_count(p["bits"] ^ q["bits"]) <= 2 * most)
    like = both & (close | (shorter >= 3) & (p["starts"] == q["starts"]))
    out = []
    for x, axis in ((a, 2), (b, 1)):
        w = np.where(x["weights"][1], x["weights"][0], 0.0)
        out.append((w * np.where(same.any(axis), 1.0, np.where(like.any(axis), 0.95, 0.0))).sum(1) / np.maximum(w.sum(1), 1e-9))
    return out


def greatest_logit(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """Upper bounds of ``features(a, b) @ weights`` for pairs with their :func:`_outline`.

    Years, marks and identifiers count as they are, titles by
    :func:`_greatest_covers`, and names as well as can be; an abstract agrees no
    better than its first ``HEAD`` words let it.
    """
    n, w = batch.num_rows, dict(zip(FEATURES, map(float, weights)))
    of = lambda c: [batch[f"{c}_{s}"] for s in "ab"]
    numbers = lambda c: [x.to_numpy(zero_copy_only=False) for x in of(c)]
    sizes = lambda c: [np.diff(x.offsets.to_numpy()) for x in of(c)]
    up = lambda name, most: max(w[name], 0.0) * most
    widest = [max(1, x.max(initial=0)) for x in sizes("hashes")]
    step = max(1, 300_000 // (widest[0] * widest[1]))  # some MB a matrix
    covers, differ = [], []
    for low in range(0, n, step):
        high = min(n, low + step)
        covers.append(_greatest_covers(batch, low, high))
        (a, held_a), (b, held_b) = (_padded(x, low, high, HEAD) for x in of("abstract"))
        k = min(a.shape[1], b.shape[1])
        differ.append((held_a[:, :k] & held_b[:, :k] & (a[:, :k] != b[:, :k])).sum(1))
    x, y = (np.concatenate([c[i] for c in covers] or [np.zeros(0)]) for i in (0, 1))
    most, least = np.maximum(x, y), np.minimum(x, y)
    marked = numbers("cut")
    cut_cover = np.where(marked[0] | marked[1], most, 0.0)
    title = np.minimum(1.0, np.maximum(least, cut_cover))
    names = sizes("names")
    none = (names[0] == 0) | (names[1] == 0)
    years = numbers("dated")
    gap = np.where((years[0] != 0) & (years[1] != 0), np.abs(years[0] - years[1]), -1)
    z = w["intercept"] + up("title_most", most) + up("title_least", least) + up("title_all", least > 0.969) + up("cut_cover", cut_cover)
    z = z + w["year_same"] * (gap == 0) + w["year_off"] * ((gap > 0) & (gap <= 2)) + w["year_far"] * (gap > 3)
    shared = np.zeros(n, dtype=bool)
    for c in ("doi", "arxiv"):
        a, b = of(c)
        known = pc.and_(pc.not_equal(a, ""), pc.not_equal(b, "")).to_numpy(zero_copy_only=False)
        one = pc.equal(a, b).to_numpy(zero_copy_only=False)
        z = z + w[f"{c}_same"] * (known & one) + w[f"{c}_other"] * (known & ~one)
        shared |= known & one
    named = up("names_same", 1.0) + up("names_other", 1.0) + up("title_x_names", title) + up("id_x_names", 1.0) * shared
    z = z + np.where(none, w["names_none"] + up("title_x_blank", title), named)
    k = np.minimum(*sizes("abstract"))
    alike = 1.0 - np.concatenate(differ or [np.zeros(0)]) / np.maximum(k, 1)
    open_ = max(0.0, w["abstract_other"])
    z = z + np.where(k < 5, 0.0, np.where(alike < 0.499, w["abstract_other"], np.where(alike < 0.849, open_, max(open_, w["abstract_same"]))))
    a, b = of("note")
    noted = pc.not_equal(pc.equal(a, ""), pc.equal(b, "")).to_numpy(zero_copy_only=False)
    differs = lambda c: np.not_equal(*numbers(c))
    return z + w["part_other"] * differs("part") + w["note_other"] * noted + w["question_other"] * differs("question")


class Classifier:
    """Logistic regression with a ridge penalty, calibrated on held-out labels by a line in the log-odds."""

    def __init__(self) -> None:
        self.weights = np.zeros(len(FEATURES))
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 40) -> np.ndarray:
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
        if len(set(y.tolist())) < 2:
            raise ValueError("labels of both kinds are needed")
        held = np.arange(len(y)) % 4 == 0
        use = ~held if len(set(y[~held].tolist())) == 2 and len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-6
        self.weights = self._newton(x[use], y[use], penalty)
        z = x[held if use.sum() < len(y) else use] @ self.weights
        t = y[held if use.sum() < len(y) else use]
        self.scale, self.shift = self._newton(np.c_[z, np.ones(len(z))], t, np.array([0.05, 0.05]))
        if self.scale <= 0:
            self.scale, self.shift = 1.0, 0.0
        return self

    def least_logit(self, threshold: float) -> float:
        """A bound that ``x @ weights`` reaches wherever the probability reaches the threshold, with room for rounding."""
        if self.scale <= 0 or threshold <= 1e-9:
            return -math.inf
        p = min(threshold, 1 - 1e-9)
        return (math.log(p / (1 - p)) - self.shift) / self.scale - 1e-6

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (x @ self.weights) + self.shift, -30, 30)))


def weak_label(x: list[float], known: bool | None) -> float | None:
    """1, 0 or None for a candidate pair: from the given groups, else by rules that leave most pairs open."""
    f = dict(zip(FEATURES, x))
    marked = f["part_other"] or f["note_other"] or f["question_other"]
    if known is not None:
        return float(known)
    if marked:
        return 0.0
    if f["names_other"]:
        return 0.0
    if f["id_x_names"] > 0.99:
        return 1.0  # a paper may change its title on publication
    if f["title_most"] < 0.55 and not f["abstract_same"]:
        return 0.0
    if f["abstract_other"] and (f["year_far"] or f["doi_other"]):
        return 0.0
    if f["names_same"] > 0.9 and f["title_least"] > 0.9 and (f["doi_same"] or f["arxiv_same"] or f["abstract_same"]):
        return 1.0
    return None


def fit(items: DataFrame, pairs: DataFrame, groups: DataFrame | None, common: list[str], most: int = 20_000) -> Classifier:
    """Fit on at most ``most`` candidate pairs: those with the smallest hash of their items.

    Items of ``groups`` give labels (same group or not); the other pairs get weak
    labels by rule or none. Labels of both kinds are needed.
    """
    sample = pairs.orderBy(F.xxhash64("item_id_a", "item_id_b"), "item_id_a", "item_id_b").limit(most)
    if groups is not None:
        known = groups.select("item_id", "group_id").groupBy("item_id").agg(F.min("group_id").alias("g"))
        for s in "ab":
            sample = sample.join(known.select(F.col("item_id").alias(f"item_id_{s}"), F.col("g").alias(f"g_{s}")), f"item_id_{s}", "left")
    else:
        sample = sample.withColumns({"g_a": F.lit(None).cast("bigint"), "g_b": F.lit(None).cast("bigint")})
    sample = cut(sample, "sample")
    rows = compared(sample.select("item_id_a", "item_id_b"), items, common).join(sample, ["item_id_a", "item_id_b"]).orderBy(F.xxhash64("item_id_a", "item_id_b"), "item_id_a").collect()
    uncut(sample)
    labelled = [(r.x, y) for r in rows if (y := weak_label(list(r.x), None if r.g_a is None or r.g_b is None else r.g_a == r.g_b)) is not None]
    if len({y for _, y in labelled}) < 2:
        raise ValueError("the candidate pairs give labels of one kind only or none; hand in a fitted model")
    return Classifier().fit(np.array([list(x) for x, _ in labelled], dtype=float), np.array([y for _, y in labelled]))


LINKS = "head_a bigint, head_b bigint, confidence double, clash boolean"


def _scorer(spark, model: Classifier):
    shared = spark.sparkContext.broadcast(model)
    calm = [FEATURES.index(f) for f in ("names_other", "part_other", "note_other", "question_other")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.asarray(v) for v in batch["x"]])
            heads = {"head_a": batch["item_id_a"].to_numpy(), "head_b": batch["item_id_b"].to_numpy()}
            clash = (x[:, calm] > 0).any(axis=1)
            yield pd.DataFrame({**heads, "confidence": shared.value.probability(x), "clash": clash})

    return score


def _closed(links: DataFrame, firsts: DataFrame, common: list[str], score) -> DataFrame:
    """Adds links between heads that are surely one with a common third and contradict in nothing, until none is new."""
    tried = links.select("head_a", "head_b")
    while True:
        sure = links.filter(F.col("confidence") >= SURE)
        ends = lambda a, b: sure.select(F.col(f"head_{a}").alias("x"), F.col(f"head_{b}").alias("y"), "confidence")
        both = ends("a", "b").unionByName(ends("b", "a"))
        met = both.alias("p").join(both.alias("q"), F.col("p.x") == F.col("q.x")).filter("p.y < q.y")
        confidence = F.max(F.col("p.confidence") * F.col("q.confidence")).alias("c")
        met = met.groupBy(F.col("p.y").alias("head_a"), F.col("q.y").alias("head_b")).agg(confidence)
        met = cut(met.join(tried, ["head_a", "head_b"], "left_anti"), "met")
        pairs = met.select(F.col("head_a").alias("item_id_a"), F.col("head_b").alias("item_id_b"))
        judged = compared(pairs, firsts, common).mapInPandas(score, LINKS).filter("NOT clash").select("head_a", "head_b")
        added = cut(judged.join(met, ["head_a", "head_b"]).select("head_a", "head_b", F.col("c").alias("confidence")), "added")
        if added.isEmpty():
            return links
        links, tried = links.unionByName(added), tried.unionByName(met.select("head_a", "head_b"))


def _links(items: DataFrame, blocks: DataFrame, meetings: float, common: list[str], score, threshold: float, model: Classifier) -> DataFrame:
    """Pairs that reach the threshold: ``head_a, head_b, confidence``.

    Comparing sends both items along with every pair, far more than the items
    themselves. So pairs are made and compared tile by tile, and what a tile
    shuffled is gone before the next; all tiles together are all pairs. Python
    reads only pairs that :func:`greatest_logit` lets reach the threshold.
    """
    spark, path = items.sparkSession, scratch_path(items.sparkSession, "links")
    slices = math.ceil(math.sqrt(2 * meetings / max(LEAST_TILE, TILE * items.count()))) or 1
    for i in range(slices):
        for j in range(i, slices):
            side = items if slices == 1 else items.filter(_slice_of("item_id", slices).isin(i, j))
            met = cut(pairs_of(blocks, i, j, slices), "pairs")
            pairs = cut(worth_reading(met, side), "pairs")
            uncut(met)
            found = compared(pairs, side, common, model, threshold).mapInPandas(score, LINKS).filter(F.col("confidence") >= threshold)
            found.select("head_a", "head_b", "confidence").write.mode("append").parquet(path)
            uncut(pairs)
    return spark.read.schema("head_a bigint, head_b bigint, confidence double").parquet(path)


def match_classes(
    papers: DataFrame,
    groups: DataFrame | None = None,
    threshold: float = 0.5,
    exclude_groups: bool = True,
    train_pairs: int = 20_000,
    closing: bool = True,
    model: Classifier | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links ``head_a, head_b, confidence``, members ``item_id, source, head``).

    Items of one source alike in all that is compared form a class, named by its
    smallest item; links stand between classes, so that copies cost nothing.
    Arguments and cases as in :func:`match_entities`.
    """
    spark = papers.sparkSession
    with brief_shuffles(spark):
        items = cut(prepare(papers), "items")
        common = common_stems(items)
        classed = items.withColumn("class", _slot_of(["source", *COMPARED]))
        heads = cut(classed.groupBy("class").agg(F.min("item_id").alias("head")), "classes")
        members = classed.select("item_id", "source", "class").join(heads, "class").select("item_id", "source", "head")
        if groups is not None and exclude_groups:
            left_out = groups.select("item_id").filter("item_id IS NOT NULL").distinct()
            members = members.join(left_out, "item_id", "left_anti")
        members = cut(members, "members")
        firsts = cut(items.join(heads.select(F.col("head").alias("item_id")), "item_id", "left_semi"), "firsts")
        uncut(items, heads)
        blocks, meetings = candidate_blocks(firsts, common)
        if model is None:
            drawn = _drawn(blocks, meetings, train_pairs)
            if drawn.isEmpty():
                return spark.createDataFrame([], "head_a bigint, head_b bigint, confidence double"), members
            model = fit(firsts, drawn, groups, common, train_pairs)
            uncut(drawn)
        score = _scorer(spark, model)
        links = _links(firsts, blocks, meetings, common, score, threshold, model)
        uncut(blocks)
        if closing:
            links = _closed(links, firsts, common, score)
        uncut(firsts)
        return links, members


def match_entities(papers: DataFrame, groups: DataFrame | None = None, **options) -> DataFrame:
    """Pairs of items of different sources that are one work: ``item_id_a, item_id_b, confidence``.

    ``groups(group_id, item_id)`` are known duplicates: they label pairs for the
    fit and, with ``exclude_groups``, their items are left out of the result.
    Items alike in all that is compared form one class; classes are matched and
    then resolved into items. ``closing`` links two items that are surely one with
    a third, over and over until no link is added. ``model`` is a fitted
    classifier to be used as it is. Cases: items without title or authors can still
    meet by identifier or abstract; a blank source is a source of its own;
    repeated rows count once; empty tables and tables without any candidate pair
    give no rows; candidate pairs that give no labels of both kinds are an error
    unless a model is handed in.
    """
    links, members = match_classes(papers, groups, **options)
    for s in "ab":
        side = members.select(F.col("head").alias(f"head_{s}"), F.col("item_id").alias(f"id_{s}"), F.col("source").alias(f"source_{s}"))
        links = links.join(side, f"head_{s}")
    apart = links.filter("source_a <> source_b")
    return apart.select(F.least("id_a", "id_b").alias("item_id_a"), F.greatest("id_a", "id_b").alias("item_id_b"), "confidence")


def match_members(links: DataFrame, members: DataFrame) -> DataFrame:
    """``item_id, class_id, n_links``: each item's class and the number of classes of other sources it is linked to."""
    sources = members.groupBy("head").agg(F.first("source").alias("source"))  # a class has one source
    ends = links.select("head_a", "head_b")
    for s in "ab":
        ends = ends.join(sources.select(F.col("head").alias(f"head_{s}"), F.col("source").alias(f"source_{s}")), f"head_{s}")
    ends = ends.filter("source_a <> source_b")
    sides = ends.select(F.col("head_a").alias("head")).unionByName(ends.select(F.col("head_b").alias("head")))
    counted = sides.groupBy("head").agg(F.count(F.lit(1)).alias("n_links"))
    joined = members.select("item_id", "head").join(counted, "head", "left")
    return joined.select("item_id", F.col("head").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


__all__ = ["match_entities", "match_classes", "match_members", "prepare", "candidate_pairs"]
