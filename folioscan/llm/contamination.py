"""Evaluation passages that leaked into a training corpus.

The test items form a BM25 inverted index with block maxima. Every window of
every document queries it. The threshold of an item is the least score that a
real case can have, so retrieval loses none, and all weights are divided by it:
what reaches 1 is retrieved. As that bar does not rise, the pivots of block-max
WAND are known beforehand: they are the blocks of items whose block maxima over
the window's terms sum to 1. Blocks are the order of the posting lists, so one
pass over the lists' blocks finds all pivots, and only postings inside them are
scored. What is retrieved is then checked word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import spread

RUN = 12  # consecutive words that make a case
SHARE = 0.8  # or this share of the item's words in their order ...
STRETCH = 1.25  # ... within a stretch of so many times the item's words

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_COMMAND = re.compile(r"\\[A-Za-z]+\s*\{")
_BROKEN = re.compile(r"[-\u00ad\u2010\u2011][ \t\u00a0]*\r?\n[ \t\u00a0>]*(?=\w)")
_JOINED = re.compile("[\u2019\u00ad\u2010\u2011\u200b-\u200d\u2060\ufeff]+")  # signs that join what they stand between, with - and '
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation and markup; words broken at a line end are rejoined, ligatures resolved."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = text.replace("-", "").replace("'", "")
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _JOINED.sub("", text)))
    return _WORD.findall(text.lower())


class ItemIndex:
    """Block-max BM25 index of test items, with weights divided by each item's threshold.

    Small by construction: all of it is as large as the items' own words, of
    which callers hand in a bounded number a pass.
    """

    def __init__(self, items: list[tuple[int, list[str]]], block: int = 16, k1: float = 1.2, b: float = 0.75):
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.texts = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.int64) for _, w in items]
        n, lengths = len(items), [len(w) for _, w in items]
        mean = sum(lengths) / max(n, 1)
        counts = [Counter(t.tolist()) for t in self.texts]
        df = Counter(t for c in counts for t in c)
        idf = {t: float(np.log1p((n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
        self.blocks = -(-n // block) if n else 0
        postings: dict[int, list[tuple[int, float]]] = {}
        self.ordered: list[float] = []  # the least score of a case of the second kind, in units of the threshold
        for k, c in enumerate(counts):
            weight = {t: idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[k] / mean)) for t, f in c.items()}
            least, ordered = self._least(self.texts[k], c, weight)
            self.ordered.append(ordered / least)
            for t, w in weight.items():
                postings.setdefault(t, []).append((k, w / least))
        # Rows of a sparse matrix by term: postings, and the block maxima over them.
        self.start, self.item, self.weight = self._rows(postings)
        tops = {t: sorted({k // block: max(w for j, w in p if j // block == k // block) for k, _ in p}.items()) for t, p in postings.items()}
        self.top_start, self.top_block, self.top_weight = self._rows(tops)
        self.best = np.zeros(len(self.vocab) + 1)
        for t, p in postings.items():
            self.best[t] = max(w for _, w in p)
        self.block = block
        self.longest = max(lengths, default=1)
        # Hashes of all runs of RUN words, sorted, with their items; a hit is compared word by word.
        self.powers = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(RUN)], dtype=np.uint64)
        made = [self._hashes(t) for t in self.texts]
        hashes = np.concatenate(made) if made else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.run_hash = hashes[order]
        self.run_item = np.repeat(np.arange(n), [len(h) for h in made]).astype(np.int32)[order]
        self.run_start = np.concatenate([np.arange(len(h)) for h in made] or [np.zeros(0)]).astype(np.int32)[order]
        self.least_ordered = np.array(self.ordered) * (1 - 1e-9)
        self.need = np.array([int(np.ceil(SHARE * x - 1e-9)) for x in lengths], dtype=np.int64)
        self.most = np.array([int(STRETCH * x + 1e-9) for x in lengths], dtype=np.int64)

    def _hashes(self, words_: np.ndarray) -> np.ndarray:
        n = len(words_) - RUN + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        w, out = words_.astype(np.uint64), np.zeros(n, dtype=np.uint64)
        for j, p in enumerate(self.powers):
            out += w[j : j + n] * p
        return out

    @staticmethod
    def _least(text: np.ndarray, count: Counter, weight: dict[int, float]) -> tuple[float, float]:
        """The least weight a document holds if it is a case for this item, by a run or not; and if it is one by the ordered share."""
        listed = text.tolist()
        runs = [sum(weight[t] for t in set(listed[i : i + RUN])) for i in range(max(0, len(listed) - RUN) + 1)] if len(listed) >= RUN else []
        # A fifth of the words may be missing; at most that takes away the terms heaviest per occurrence.
        spare, total = len(listed) - int(np.ceil(SHARE * len(listed) - 1e-9)), sum(weight.values())
        for t in sorted(weight, key=lambda t: -weight[t] / count[t]):
            taken = min(spare, count[t])
            total -= weight[t] * taken / count[t]
            spare -= taken
        total = max(total, 1e-9) * (1 - 1e-9)
        return max(min([total, *runs]) * (1 - 1e-9), 1e-10), total

    def _rows(self, rows: dict[int, list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.zeros(len(self.vocab) + 2, dtype=np.int64)
        for t, p in rows.items():
            sizes[t + 1] = len(p)
        flat = [x for t in range(len(self.vocab) + 1) for x in rows.get(t, [])]
        return np.cumsum(sizes), np.array([k for k, _ in flat], dtype=np.int64), np.array([w for _, w in flat])

    @staticmethod
    def _gather(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        low, size = start[terms], start[terms + 1] - start[terms]
        return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())

    def retrieve(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items whose score for the window's terms reaches their threshold, and those scores."""
        terms = np.unique(window)
        terms = terms[terms > 0]
        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        if self.best[terms].sum() < 1:
            return none
        at = self._gather(self.top_start, terms)
        alive = np.bincount(self.top_block[at], self.top_weight[at], self.blocks) >= 1
        if not alive.any():
            return none
        at = self._gather(self.start, terms)
        at = at[alive[self.item[at] // self.block]]
        scores = np.bincount(self.item[at], self.weight[at], len(self.ids))
        found = np.nonzero(scores >= 1)[0]
        return found, scores[found]

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words(text)], dtype=np.int64)

    def _with_runs(self, doc: np.ndarray) -> set[int]:
        """Items that share RUN consecutive words with the document."""
        hashes = self._hashes(doc)
        if not len(hashes) or not len(self.run_hash):
            return set()
        low = np.searchsorted(self.run_hash, hashes)
        got: set[int] = set()
        for i in np.nonzero(self.run_hash[np.minimum(low, len(self.run_hash) - 1)] == hashes)[0].tolist():
            j = int(low[i])
            while j < len(self.run_hash) and self.run_hash[j] == hashes[i]:
                k, at = int(self.run_item[j]), int(self.run_start[j])
                if k not in got and np.array_equal(self.texts[k][at : at + RUN], doc[i : i + RUN]):
                    got.add(k)
                j += 1
        return got

    def _hits(self, doc: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of the document's words that belong to one of ``items``, by item and place."""
        at = self._gather(self.start, doc)
        wanted = np.zeros(len(self.ids), dtype=bool)
        wanted[items] = True
        item = self.item[at]
        kept = wanted[item]
        place = np.repeat(np.arange(len(doc)), self.start[doc + 1] - self.start[doc])[kept]
        order = np.lexsort((place, item[kept]))
        return item[kept][order], place[order]

    def _dense(self, doc: np.ndarray, items: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Those items of which some stretch of the document holds as many words as the ordered share needs, with their places."""
        item, place = self._hits(doc, items)
        need, most = self.need[item], self.most[item]
        # The word that completes the need: as many hits of the item further on, and within its stretch.
        last = np.arange(len(item)) + need - 1
        inside = last < len(item)
        last = np.minimum(last, max(len(item) - 1, 0))
        full = inside & (item[last] == item) & (place[last] - place < most)
        return [(int(k), place[item == k]) for k in np.unique(item[full])]

    def _in_order(self, doc: np.ndarray, k: int, places: np.ndarray) -> int:
        """Most words of the item found in their order within STRETCH times its length, or 0 below SHARE of them."""
        text = self.texts[k]
        need, most = int(self.need[k]), int(self.most[k])
        masks: dict[int, int] = {}
        for i, t in enumerate(text.tolist()):
            masks[t] = masks.get(t, 0) | 1 << i
        full = (1 << len(text)) - 1
        ends = np.searchsorted(places, places + most)  # only the item's own words count, so others are not looked at
        words_ = [masks[t] for t in doc[places].tolist()]
        best = 0
        for s in np.nonzero(ends - np.arange(len(places)) >= need)[0].tolist():
            row = full  # bit-parallel longest common subsequence
            for m in words_[s : int(ends[s])]:
                u = row & m
                row = (row + u | row - u) & full
            best = max(best, len(text) - row.bit_count())
        return best if best >= need else 0

    def _longest_run(self, doc: np.ndarray, k: int) -> int:
        """Most consecutive words that the document and the item share."""
        text, best = self.texts[k], 0
        row = np.zeros(len(text) + 1, dtype=np.int64)
        for t in doc.tolist():
            if t:
                row[1:] = np.where(text == t, row[:-1] + 1, 0)
                best = max(best, int(row.max()))
            else:
                row[:] = 0
        return best

    def overlap(self, text: str | None, k: int) -> tuple[int, int, int]:
        """Words of the ``k``-th item, its longest run in the text, and its most words in order (0 below the share)."""
        doc = self.encode(text)
        placed = dict(self._dense(doc, np.array([k])))
        return len(self.texts[k]), self._longest_run(doc, k), self._in_order(doc, k, placed[k]) if k in placed else 0

    def found(self, text: str | None) -> list[int]:
        """The places in :attr:`ids` of the items that the text holds."""
        doc = self.encode(text)
        if np.count_nonzero(doc) < min(RUN, self.need.min(initial=RUN)):
            return []
        stride = int(np.ceil(STRETCH * self.longest)) + 1
        retrieved: set[int] = set()
        ordered: set[int] = set()
        for low in range(0, max(1, len(doc) - stride), stride):
            items, scores = self.retrieve(doc[low : low + 2 * stride])
            retrieved.update(items.tolist())
            ordered.update(items[scores >= self.least_ordered[items]].tolist())
        if not retrieved:
            return []
        got = self._with_runs(doc) & retrieved
        rest = np.array(sorted(ordered - got), dtype=np.int64)
        if len(rest):
            got |= {k for k, places in self._dense(doc, rest) if self._in_order(doc, k, places)}
        return sorted(got)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    max_items: int = 20_000,
    max_words: int = 2_000_000,
    measure: bool = False,
) -> DataFrame:
    """``doc_key, item_key`` for each document row that holds a test item, whole or in part.

    With ``measure`` also ``n_words`` of the item, its ``longest_run`` in the
    document and its most words ``in_order`` (0 below the share), the greatest
    over rows of one document. An index holds at most ``max_items`` items and
    ``max_words`` words (an item that alone has more is an index of its own),
    some 200 MB, and is sent to the executors; a larger test set takes one pass
    over the documents for each index. Cases: null and empty texts hold nothing
    and, as items, are found nowhere; items with fewer than 12 words are found
    by the ordered share alone; repeated documents and items give one row; of
    differing texts under one item key any may be found; empty tables give no
    rows; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).dropDuplicates()
    docs = spread(documents.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL AND d IS NOT NULL"))
    more = ["n_words", "longest_run", "in_order"] if measure else []
    schema = ", ".join([f"{doc_key} bigint", f"{item_key} bigint", *[f"{c} int" for c in more]])

    def pass_over(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(part))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                found = [(d, k, t) for d, t in zip(batch["d"].tolist(), batch["t"].tolist()) for k in index.found(t)]
                out = [(d, index.ids[k], *(index.overlap(t, k) if measure else ())) for d, k, t in found]
                yield pd.DataFrame(out, columns=[doc_key, item_key, *more]).astype("int64")

        return docs.mapInPandas(find, schema)

    parts: list[DataFrame] = []
    listed: list[tuple[int, list[str]]] = []
    size = 0
    for row in rows.toLocalIterator():
        split = words(row.t) if row.k is not None else []
        if listed and (len(listed) == max_items or size + len(split) > max_words):
            parts.append(pass_over(listed))
            listed, size = [], 0
        if split:
            listed.append((row.k, split))
            size += len(split)
    if listed or not parts:
        parts.append(pass_over(listed))
    result = reduce(DataFrame.unionByName, parts)
    if not measure:
        return result.distinct()
    return result.groupBy(doc_key, item_key).agg(*[F.max(c).alias(c) for c in more])
