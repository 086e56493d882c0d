"""The best representative of each duplicate group, field by field.

Values are fused in the Bayesian way. Sources have accuracies for each field,
estimated from the values they claim; two sources that share false values more
often than chance are taken as dependent, and a dependent source's vote is
discounted. A value's posterior is its likelihood by those votes times a prior
of finite weight, which favours fuller values and values of trusted sources;
the value of greatest posterior survives. Who claims it is then told apart by
completeness, trust, recency and identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscan.llm.mixing import source_key
from folioscan.llm.papers import abstract, letters, valid_arxiv, valid_doi
from folioscan.operators.skew import hot_keys, lookup_join
from folioscan.session import cut

FIELDS = ("summary", "doi", "arxiv_id")
CLAIM = (
    "group_id bigint, item_id bigint, field_name string, value string, plain string, words int, source string, retrieved_at timestamp"
)
COPY_RATE, COPY_PRIOR, FALSE_VALUES, START = 0.8, 0.2, 20, 0.8
MAX_TRUST_ROWS = 10_000
MAX_SOURCES = 2_000  # figures per source and pair of sources reach the driver
TRUST_WEIGHT = 12.0  # log-odds for each step of trust: about the votes of two independent accurate sources
WORDS_WEIGHT = 120.0  # log-odds between an empty abstract and the fullest of the group
OPENING = 6  # texts are compared side by side if they share so many words; shorter ones are looked up by their own words


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in CLAIM.split(", ")]
    text = lambda x: x if isinstance(x, str) else None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            summary = text(r.summary)
            kept = abstract(summary, [letters(t) for t in (r.title, r.group_title) if isinstance(t, str)])
            doi, arxiv = valid_doi(text(r.doi)), valid_arxiv(text(r.arxiv_id))
            at = None if pd.isna(r.retrieved_at) else r.retrieved_at
            found = (
                ("summary", summary if kept else None, " ".join(letters(" ".join(kept))), len(kept)),
                ("doi", doi, doi, 0),
                ("arxiv_id", arxiv, arxiv and arxiv.split("v")[0], 0),
            )
            out += [(r.group_id, r.item_id, f, v, p, n, r.source, at) for f, v, p, n in found if v is not None]
        made = pd.DataFrame(out, columns=names)
        yield made.astype({"group_id": "int64", "item_id": "int64", "words": "int32", "retrieved_at": "datetime64[us]"})


def value_keys(texts: DataFrame) -> DataFrame:
    """``slot, plain, key``: texts of a slot are one value if one is the other's beginning, over its whole length.

    ``texts(slot, plain)`` are distinct. Sorted, a text stands right before those
    that go on from it, so the next one that nothing goes on from is its full
    form. Windows hold the texts of one slot and one opening; a text of at most
    ``OPENING`` words meets the fuller ones by its own words.
    """
    opening = F.substring_index("plain", " ", OPENING)
    rows = texts.withColumn("opening", opening)
    long = rows.filter("plain <> opening")
    w = W.partitionBy("slot", "opening")
    goes_on = F.startswith(F.lead("plain").over(w.orderBy("plain")), F.concat("plain", F.lit(" ")))
    ends = long.withColumn("end", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("plain")))
    back = w.orderBy(F.desc("plain")).rowsBetween(W.unboundedPreceding, W.currentRow)
    full = ends.select("slot", "plain", F.last("end", ignorenulls=True).over(back).alias("full"))
    short = rows.filter("plain = opening").select("slot", "plain")
    starts = F.array_distinct(F.array(*[F.substring_index("full", " ", n) for n in range(1, OPENING + 1)]))
    whole = full.select("slot", "full").distinct().unionByName(short.select("slot", F.col("plain").alias("full")))
    by_start = whole.select("slot", "full", F.explode(starts).alias("plain"))
    # Of several fuller forms of a short text, the longest, then the first.
    longest = by_start.groupBy("slot", "plain").agg(F.min_by("full", F.struct(-F.length("full"), "full")).alias("full"))
    found = full.unionByName(short.join(longest, ["slot", "plain"]).select("slot", "plain", "full"))
    return found.select("slot", "plain", F.xxhash64("full").alias("key"))


def log_copied(same_true: float, same_false: float, different: float, a: float, b: float) -> float:
    """Log-likelihood ratio of copying to independence for two sources of accuracies ``a`` and ``b``."""
    a, b = min(max(a, 0.05), 0.95), min(max(b, 0.05), 0.95)
    m = (a + b) / 2
    alone = (a * b, (1 - a) * (1 - b) / FALSE_VALUES)
    alone = (*alone, 1 - sum(alone))
    kept = 1 - COPY_RATE
    copied = (m * COPY_RATE + alone[0] * kept, (1 - m) * COPY_RATE + alone[1] * kept, alone[2] * kept)
    counts = (same_true, same_false, different)
    return float(sum(n * (np.log(p) - np.log(q)) for n, p, q in zip(counts, copied, alone)))


def dependence(evidence: float) -> float:
    """Posterior probability that two sources are not independent, from the sum of :func:`log_copied` over fields."""
    return float(1 / (1 + (1 - COPY_PRIOR) / COPY_PRIOR * np.exp(-np.clip(evidence, -500, 500))))


def vote(sources: list[str], accuracy: dict[str, float], copying: dict[tuple[str, str], float]) -> float:
    """Log-weight of a value claimed by ``sources``: each vote counts as far as it is independent of those before it."""
    total, before = 0.0, []
    for s in sorted(sources, key=lambda s: (-accuracy.get(s, START), s)):
        a = min(max(accuracy.get(s, START), 0.05), 0.95)
        own = float(np.prod([1 - COPY_RATE * copying.get((min(s, t), max(s, t)), 0.0) for t in before])) if before else 1.0
        total += own * float(np.log(FALSE_VALUES * a / (1 - a)))
        before.append(s)
    return total


class Fusion:
    """Accuracies of sources by field and dependences of pairs of sources; small, sent to the executors."""

    def __init__(self) -> None:
        self.accuracy: dict[str, dict[str, float]] = {}
        self.copying: dict[tuple[str, str], float] = {}
        self._cache: dict[tuple, float] = {}

    def weight(self, field: str, sources: tuple[str, ...]) -> float:
        key = (field, sources)
        if key not in self._cache:
            if len(self._cache) > 100_000:
                self._cache.clear()
            self._cache[key] = vote(list(sources), self.accuracy.get(field, {}), self.copying)
        return self._cache[key]

    def posteriors(self, field: str, kinds: list) -> list[float]:
        """Posterior of a value of each kind ``(sources, prior, n)``: ``n`` values of the slot are of that kind."""
        logs = np.array([self.weight(field, tuple(k["sources"])) + k["prior"] for k in kinds])
        many = np.array([k["n"] for k in kinds], dtype=float)
        unclaimed = max(FALSE_VALUES + 1 - many.sum(), 0.0)  # they share the rest of the domain, at log-weight 0
        top = max(logs.max(), 0.0)
        scaled = np.exp(logs - top)
        return (scaled / ((scaled * many).sum() + unclaimed * np.exp(-top))).tolist()

    def __getstate__(self) -> dict:
        return {"accuracy": self.accuracy, "copying": self.copying, "_cache": {}}


TALLY = "field_name string, a string, b string, met double, posterior double, same_true double, same_false double"


def _tallies(fusion: Fusion):
    """Sums over slots: a source's posterior mass (``a = b``), and how often two sources met and agreed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for field, kinds, slots in zip(batch["field_name"], batch["kinds"], batch["slots"]):
                present = sorted({s for k in kinds for s in k["sources"]})
                for i, a in enumerate(present):
                    for b in present[i + 1 :]:
                        sums.setdefault((field, a, b), np.zeros(4))[0] += slots
                for k, p in zip(kinds, fusion.posteriors(field, kinds)):
                    listed, n = sorted(k["sources"]), slots * k["n"]
                    for i, a in enumerate(listed):
                        sums.setdefault((field, a, a), np.zeros(4))[:2] += n, n * p
                        for b in listed[i + 1 :]:
                            sums.setdefault((field, a, b), np.zeros(4))[2 if p > 0.5 else 3] += n
        yield pd.DataFrame([(*k, *v.tolist()) for k, v in sums.items()], columns=[c.split()[0] for c in TALLY.split(", ")])

    return run


def fuse(make_ups: DataFrame, rounds: int) -> Fusion:
    """Estimate accuracies and dependences over ``make_ups(field_name, kinds, slots)``."""
    fusion = Fusion()
    for _ in range(rounds):
        tally = make_ups.mapInPandas(_tallies(fusion), TALLY).groupBy("field_name", "a", "b")
        sums = tally.agg(*[F.sum(c).alias(c) for c in ("met", "posterior", "same_true", "same_false")]).collect()
        following = Fusion()
        for r in sums:
            if r.a == r.b and r.met:
                following.accuracy.setdefault(r.field_name, {})[r.a] = r.posterior / r.met
        evidence: dict[tuple[str, str], float] = {}
        for r in sums:
            if r.a != r.b:
                of = following.accuracy.get(r.field_name, {})
                apart = max(0.0, r.met - r.same_true - r.same_false)
                ratio = log_copied(r.same_true, r.same_false, apart, of.get(r.a, START), of.get(r.b, START))
                evidence[r.a, r.b] = evidence.get((r.a, r.b), 0.0) + ratio
        following.copying = {pair: dependence(x) for pair, x in evidence.items()}
        fusion = following
    return fusion


def survivors(
    groups: DataFrame,
    papers: DataFrame,
    trust: DataFrame,
    trust_weight: float = TRUST_WEIGHT,
    words_weight: float = WORDS_WEIGHT,
    rounds: int = 3,
) -> DataFrame:
    """The surviving value of each field for each group: the one of maximum posterior.

    Returns ``group_id, field_name, item_id, value, source, words, trust, posterior``.
    Candidates are valid values only. Two abstracts are one value if one is the
    other's beginning over its whole length, two identifiers if they are equal
    up to case, decoration and version. The log-prior of a value is
    ``trust_weight`` for each step of trust of its best claimant for the field
    (an unlisted source stands below the listed, a blank one lowest) plus
    ``words_weight`` times its share of the words of the group's fullest
    abstract; with both 0 the votes alone decide. Of the rows that claim the
    surviving value, the one with most words survives, then of most trust, then
    the latest (null earliest), then of the smallest ``item_id``; values of
    equal posterior are told apart in the same way.

    Cases: a field without valid value gives no row; repeated rows count once,
    differing rows of one item are separate candidates; items without a group
    or a paper are ignored; empty tables give no rows; more than ``MAX_SOURCES``
    distinct sources or ``MAX_TRUST_ROWS`` rows of trust are an error.
    """
    if trust.count() > MAX_TRUST_ROWS:
        raise ValueError(f"the table of trust has over {MAX_TRUST_ROWS} rows")
    listed = trust.select("field_name", source_key(F.col("source")).alias("source"), "trust").filter("source <> ''")
    listed = listed.groupBy("field_name", "source").agg(F.max("trust").alias("trust"))
    steps = F.dense_rank().over(W.partitionBy("field_name").orderBy("trust")) + 1
    listed = listed.withColumn("step", steps)
    members = groups.select("group_id", "item_id").filter("group_id IS NOT NULL AND item_id IS NOT NULL").distinct()
    at = F.col("retrieved_at").cast("timestamp").alias("retrieved_at")
    used = papers.select("item_id", "title", "summary", "doi", "arxiv_id", source_key(F.col("source")).alias("source"), at)
    rows = cut(members.join(used, "item_id").distinct(), "members")
    title = F.max_by("title", F.struct(F.length("title"), "title")).alias("group_title")
    titles = cut(rows.groupBy("group_id").agg(title, F.count(F.lit(1)).alias("n")), "titles")
    total = titles.agg(F.sum("n")).first()[0] or 0
    titled = lookup_join(rows, titles.drop("n"), "group_id", hot_keys(titles, "group_id", "n", total))
    slot = F.concat_ws("/", F.col("group_id").cast("string"), "field_name")
    step = F.coalesce("step", F.when(F.col("source") == "", F.lit(0)).otherwise(F.lit(1)))
    claims = titled.mapInPandas(_claims, CLAIM).join(F.broadcast(listed), ["field_name", "source"], "left")
    claims = cut(claims.withColumns({"slot": slot, "step": step, "spelled": F.xxhash64(slot, "plain")}), "claims")

    # The key of an identifier is its spelling; abstracts get theirs from the distinct spellings of the slot.
    whole = F.col("field_name") == "summary"
    spelled = claims.filter(whole).groupBy("slot", "plain", "spelled").agg(F.count(F.lit(1)).alias("n"))
    spelled = cut(spelled, "spelled")
    n_summaries = spelled.agg(F.sum("n")).first()[0] or 0
    keys = value_keys(spelled.select("slot", "plain")).select(F.xxhash64("slot", "plain").alias("spelled"), "key")
    hot_spelled = hot_keys(spelled, "spelled", "n", n_summaries)
    keyed = lookup_join(claims.filter(whole), cut(keys, "keys"), "spelled", hot_spelled)
    placed = claims.filter(~whole).withColumn("key", F.xxhash64("plain")).unionByName(keyed)

    # From rows to values, kinds of values and slots, each by an aggregate that keeps the best row on the way.
    latest = F.coalesce(F.unix_micros("retrieved_at"), F.lit(-(1 << 62)))
    order = F.struct("words", "step", latest.alias("at"), (-F.col("item_id")).alias("id"))
    row = F.struct("item_id", "value", "source", "words", "trust")
    placed = placed.select("group_id", "field_name", "key", "source", order.alias("order"), row.alias("row"))
    best_row = [F.max("order").alias("order"), F.max_by("row", "order").alias("row")]
    sources = F.array_sort(F.collect_set("source")).alias("sources")
    top_step = F.max("order.step").alias("step")
    votes = placed.groupBy("group_id", "field_name", "key").agg(sources, top_step, *best_row)
    of_kind = ["sources", "step", F.col("order.words").alias("words")]
    kinds = votes.groupBy("group_id", "field_name", *of_kind).agg(F.count(F.lit(1)).alias("n"), *best_row)
    # At most (sets of sources) x (steps) x (lengths of abstracts) kinds make up a slot, whatever the number of its rows.
    listed_kinds = F.collect_list(F.struct("sources", "step", "words", "n", "order", "row")).alias("k")
    slots = kinds.groupBy("group_id", "field_name").agg(F.array_sort(listed_kinds).alias("k"))
    fullest = F.greatest(F.array_max(F.transform("k", lambda k: k["words"])), F.lit(1))
    share = lambda k: F.round(k["words"] / F.col("fullest"), 3)
    prior = lambda k: F.lit(float(trust_weight)) * k["step"] + F.lit(float(words_weight)) * share(k)
    slots = slots.withColumn("fullest", fullest).withColumn("priors", F.transform("k", prior))
    # Priors count from the best of the slot, so that the votes for it, not its rank, give the confidence.
    slots = slots.withColumn("priors", F.transform("priors", lambda p: F.round(p - F.array_max("priors"), 6)))
    weighed = F.zip_with("k", "priors", lambda k, p: F.struct(k["sources"].alias("sources"), p.alias("prior"), k["n"].alias("n")))
    slots = cut(slots.select("group_id", "field_name", "k", weighed.alias("kinds")), "slots")
    make_ups = cut(slots.groupBy("field_name", "kinds").agg(F.count(F.lit(1)).alias("slots")), "make_ups")
    named = make_ups.select(F.explode("kinds.sources").alias("s")).select(F.explode("s").alias("s")).distinct().count()
    if named > MAX_SOURCES:
        raise ValueError(f"{named} sources; at most {MAX_SOURCES} can be weighed against each other")
    fusion = fuse(make_ups, rounds)

    @F.pandas_udf("array<double>")
    def posteriors(fields: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([fusion.posteriors(f, k) for f, k in zip(fields, kinds)])

    scored = slots.withColumn("p", posteriors("field_name", "kinds"))
    rated = F.zip_with("k", "p", lambda k, p: F.struct(p.alias("posterior"), k["order"].alias("order"), k["row"].alias("row")))
    best = scored.select("group_id", "field_name", F.array_max(rated).alias("b"))
    return best.select("group_id", "field_name", "b.row.*", "b.posterior")


def survivor_records(best: DataFrame) -> DataFrame:
    """One row per group: the surviving values, the source of the fullest, and the mean confidence."""
    value = {f: F.max(F.when(F.col("field_name") == f, F.col("value"))) for f in FIELDS}
    worth: Column = F.when(F.col("field_name") == "summary", 2).when(F.col("field_name") == "doi", 1).otherwise(0)
    source = F.max_by("source", F.struct(worth, "posterior")).alias("source")
    return best.groupBy("group_id").agg(*[v.alias(f) for f, v in value.items()], source, F.avg("posterior").alias("confidence"))
