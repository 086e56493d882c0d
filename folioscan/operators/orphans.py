"""References to records that do not exist: direct orphans per period and what they taint."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.skew import hot_keys, lookup_join
from folioscan.session import cut

MAX_MONTHS = 62  # months are the bits of one long
COMPACT = 16  # rounds of the fixpoint between two compactions of what is known


class Calendar:
    """A row of months: places of times in it, masks of months as longs, names of months."""

    def __init__(self, start: str = "2024-01", months: int = 12):
        if not 1 <= months <= MAX_MONTHS:
            raise ValueError(f"from 1 to {MAX_MONTHS} months, not {months}")
        self.start, self.months = start, months
        self.year, self.month = (int(x) for x in start.split("-"))

    def place(self, at: str) -> Column:
        """Place of a time's month: 0 also before the first, ``months`` after the last."""
        offset = (F.year(at) - self.year) * 12 + F.month(at) - self.month
        return F.least(F.greatest(offset, F.lit(0)), F.lit(self.months))

    @staticmethod
    def bits(mask: int) -> Column:
        return F.lit(mask).cast("bigint")

    def since(self, place: Column) -> Column:
        """Mask of the months from a place on."""
        every = (1 << self.months) - 1
        masks = F.array(*[self.bits(every & ~((1 << m) - 1)) for m in range(self.months + 1)])
        return F.element_at(masks, place + 1)

    def name(self, place: int) -> str:
        year, month = divmod(self.year * 12 + self.month - 1 + place, 12)
        return f"{year:04d}-{month + 1:02d}"

    def first(self, mask: Column) -> Column:
        """Name of the first month of a mask."""
        names = F.array(*[F.lit(self.name(m)) for m in range(self.months)])
        return F.element_at(names, F.bit_count(mask.bitwiseAND(-mask) - 1) + 1)


def live_months(arrivals: DataFrame, removals: DataFrame, calendar: Calendar) -> DataFrame:
    """``tag, live``: the months at whose end the tag is live, as a mask.

    Live means that the latest arrival or removal up to then is an arrival (an
    arrival wins a tie). ``arrivals(tag, at)``, ``removals(tag, at)``; null tags
    and times are ignored.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp")) * 2  # the lowest bit says which kind of event
    marked = arrivals.select("tag", (micros + 1).alias("k"), calendar.place("at").alias("m"))
    marked = marked.unionByName(removals.select("tag", micros.alias("k"), calendar.place("at").alias("m")))
    marked = marked.filter(F.col("tag").isNotNull() & F.col("k").isNotNull())
    # The latest event of each month in one aggregate, then a running maximum over as many columns.
    per_month = [F.max(F.when(F.col("m") == m, F.col("k"))).alias(f"k{m}") for m in range(calendar.months)]
    latest = marked.groupBy("tag").agg(*per_month)
    mask = calendar.bits(0)
    for m in range(calendar.months):
        upto = F.col("k0") if m == 0 else F.greatest(*[F.col(f"k{i}") for i in range(m + 1)])
        mask = mask.bitwiseOR(F.when(upto % 2 != 0, calendar.bits(1 << m)).otherwise(calendar.bits(0)))
    return latest.select("tag", mask.alias("live"))


def _merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("tag").agg(F.bit_or("fresh").alias("mask"))


def _tainted(direct: DataFrame, edges: DataFrame, hot: DataFrame, calendar: Calendar, max_rounds: int | None) -> DataFrame:
    """``tag, mask``: the months in which a record is tainted, by the fixpoint over ``edges(source_tag, target_tag, m0)``.

    A round adds what is fresh as a table of its own; what is known of the tags
    it reached is read from all of them, and only those tags are shuffled.
    """
    deltas = [cut(direct.groupBy(F.col("source_tag").alias("tag")).agg(F.bit_or("gone").alias("fresh")), "taint")]
    for n in itertools.count():
        frontier = deltas[-1].select(F.col("tag").alias("target_tag"), "fresh")
        if frontier.isEmpty():
            return _merged(deltas)
        if n == max_rounds:
            raise RuntimeError(f"references are still being tainted after {max_rounds} rounds")
        reached = lookup_join(edges, frontier, "target_tag", hot)
        passed = F.bit_or(F.col("fresh").bitwiseAND(calendar.since(F.col("m0")))).alias("got")
        got = cut(reached.groupBy(F.col("source_tag").alias("tag")).agg(passed), "reached")
        if len(deltas) >= COMPACT:
            deltas = [cut(_merged(deltas).withColumnRenamed("mask", "fresh"), "taint")]
        known = _merged([d.join(got.select("tag"), "tag", "left_semi") for d in deltas])
        fresh = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("mask", calendar.bits(0))))
        deltas.append(cut(got.join(known, "tag", "left").select("tag", fresh.alias("fresh")).filter("fresh <> 0"), "taint"))


def orphan_references(
    references: DataFrame,
    arrivals: DataFrame,
    removals: DataFrame,
    calendar: Calendar | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """Direct and inherited orphan references in the months of a calendar (2024 by default).

    ``references(ref_table, source_tag, target_tag, at)`` may repeat; a reference
    is a distinct table, source and target, dated by its earliest ``at``. It is
    a *direct* orphan in a month (from its own on) at whose end the target is not
    live. A record with a direct orphan is tainted from that month; references to
    tainted records are *inherited* orphans and taint their own sources in turn,
    until nothing new is tainted. Months are the bits of one long, so a round
    is a join of the references to the records tainted anew and a ``bit_or``.
    There is no bound to the rounds unless ``max_rounds`` is set; then an end
    not reached by it is an error.

    Returns ``ref_table, source_tag, target_tag, first_month, kind, months, mask``:
    in how many months, and in which, as bits from the first month on.
    Cases: null sources and null targets are no references; a reference
    without a date counts from the first month; one dated after the last is no
    case; cycles end, since masks only grow; empty tables give no rows.
    """
    calendar = calendar or Calendar()
    columns = ["ref_table", "source_tag", "target_tag"]
    when = F.coalesce(calendar.place("at"), F.lit(0))
    named = references.filter(F.col("target_tag").isNotNull() & F.col("source_tag").isNotNull())
    refs = cut(named.groupBy(*columns).agg(F.min(when).alias("m0")), "references")
    per_target = cut(refs.groupBy("target_tag").agg(F.count(F.lit(1)).alias("n")), "targets")
    total = per_target.agg(F.sum("n")).first()[0] or 0
    hot = cut(hot_keys(per_target, "target_tag", "n", total), "hot")
    live = live_months(arrivals, removals, calendar).withColumnRenamed("tag", "target_tag")
    live = per_target.select("target_tag").join(live, "target_tag")
    judged = lookup_join(refs, live, "target_tag", hot, "left")
    gone = F.bitwise_not(F.coalesce("live", calendar.bits(0))).bitwiseAND(calendar.since(F.col("m0")))
    judged = cut(judged.select(*columns, "m0", gone.alias("gone")), "judged")
    edges = cut(judged.groupBy("source_tag", "target_tag").agg(F.min("m0").alias("m0")), "edges")
    tainted = _tainted(judged.filter("gone <> 0"), edges, hot, calendar, max_rounds)

    def orphans(df: DataFrame, mask: Column, kind: str) -> DataFrame:
        rows = df.select(*columns, mask.alias("mask")).filter("mask <> 0")
        named_ = [calendar.first(F.col("mask")).alias("first_month"), F.lit(kind).alias("kind")]
        return rows.select(*columns, *named_, F.bit_count("mask").alias("months"), "mask")

    through = lookup_join(judged, tainted.withColumnRenamed("tag", "target_tag"), "target_tag", hot)
    inherited = F.col("mask").bitwiseAND(calendar.since(F.col("m0"))).bitwiseAND(F.bitwise_not("gone"))
    return orphans(judged, F.col("gone"), "direct").unionByName(orphans(through, inherited, "inherited"))


def orphan_report(orphans: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """``ref_table, month, kind, n_refs, n_targets``: the orphan references of each month, and their targets.

    A reference that is an orphan for half a year is counted in each of its
    months. Months are counted as columns over targets, then over tables, so
    that no row is multiplied before it is aggregated; months without orphans
    are not listed.
    """
    calendar = calendar or Calendar()
    has = lambda mask, m: F.when(F.col(mask).bitwiseAND(calendar.bits(1 << m)) != 0, 1).otherwise(0)
    months = range(calendar.months)
    per_target = orphans.groupBy("ref_table", "kind", "target_tag")
    per_target = per_target.agg(F.bit_or("mask").alias("any"), *[F.sum(has("mask", m)).alias(f"r{m}") for m in months])
    refs = [F.sum(f"r{m}").alias(f"r{m}") for m in months]
    targets = [F.sum(has("any", m)).alias(f"t{m}") for m in months]
    wide = per_target.groupBy("ref_table", "kind").agg(*refs, *targets)
    fields = lambda m: (F.lit(calendar.name(m)).alias("month"), F.col(f"r{m}").alias("n_refs"), F.col(f"t{m}").alias("n_targets"))
    listed = wide.select("ref_table", "kind", F.explode(F.array(*[F.struct(*fields(m)) for m in months])).alias("x"))
    return listed.select("ref_table", "x.month", "kind", "x.n_refs", "x.n_targets").filter("n_refs > 0")
