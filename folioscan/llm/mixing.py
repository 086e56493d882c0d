"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.skew import running_sum
from folioscan.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_TARGETS = 10_000  # rows of the table of targets, which is sent to the executors
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def source_key(source: Column) -> Column:
    """Sources compare without case and blanks; blank or null gives ``''``."""
    return F.coalesce(F.lower(F.regexp_replace(source, r"(?U)[\s\p{Z}\p{C}]+", "")), F.lit(""))


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` over whole texts, by a public byte-level vocabulary (its path is a parameter)."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # under 1 MB

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["t"]]
            yield pd.DataFrame({"doc_id": batch["k"].to_numpy(), "source": batch["s"].to_numpy(), "n_tokens": sizes})

    rows = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), source_key(F.col(source)).alias("s"))
    return spread(rows).mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def _closing_time(demands: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources of (weight, most tokens) have given ``budget`` together."""
    left, active, now = budget, sorted(((most / w, w) for w, most in demands if w > 0 and most > 0)), 0.0
    weight = sum(w for _, w in active)
    for ends, w in active:
        if weight * (ends - now) >= left:
            return now + left / weight
        left -= weight * (ends - now)
        now, weight = ends, weight - w
    return now


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17, rows_per_bucket: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Select documents for every mix in ``targets``; returns (selection, shares).

    Documents of a source are shuffled by a hash; each gets as virtual finish
    time the tokens of its source up to and with it over the source's weight,
    and later repeats follow after the whole source. The mix is the longest
    prefix in the order of finish times whose tokens fit the budget
    (``budget_factor`` times the tokens of all documents). A document is used at
    most ``max_repeats`` times in all.

    selection: ``mix_name, doc_id, source, repeat_no, n_tokens, finish_time, end_token``.
    shares: ``mix_name, source, target_share, actual_share, n_tokens, n_rows, max_used, exhausted``.

    Cases: null, empty and wordless texts have no size and are not chosen; a
    source with no documents reaches share 0, and its part goes to the others; a
    source without a target is not used; a source of weight 0 or null or with
    ``max_repeats`` below 1 gives nothing; repeated document rows are separate
    rows of the same size, repeated target rows count once; if all sources run
    out, the mix stays below its budget.
    """
    spark = documents.sparkSession
    sized = cut(count_tokens(documents, tokenizer=tokenizer), "tokens")
    totals = {r.source: (r.t, r.n) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).join(targets.select(source_key(F.col("source")).alias("source")).distinct(), "source").collect()}
    if targets.count() > MAX_TARGETS:
        raise ValueError(f"the table of targets has over {MAX_TARGETS} rows")
    everything = sized.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = targets.select("mix_name", "budget_factor", source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").distinct().collect()
    plan = []  # one row for each target: as many as the table of targets, which names sources by hand
    for mix in sorted({r.mix_name for r in wanted if r.mix_name is not None}):
        rows = [r for r in wanted if r.mix_name == mix]
        budget = max((r.budget_factor or 0) for r in rows) * everything
        weights = [(r.source, float(r.target_weight or 0), int(r.max_repeats or 0)) for r in rows]
        end = _closing_time([(w, max(0, m) * totals.get(s, (0, 0))[0]) for s, w, m in weights], budget)
        whole = sum(w for _, w, _ in weights if w > 0) or 1.0
        plan += [(mix, s, w, m, budget, end, w / whole, *totals.get(s, (0, 0))) for s, w, m in weights]
    columns = "mix_name string, source string, weight double, max_repeats int, budget double, closing double, target_share double"
    goals = spark.createDataFrame(plan, f"{columns}, supply bigint, n_docs bigint")
    # The order within a source and its running sums, the same for all mixes.
    most = max([n for _, n in totals.values()], default=0)
    buckets = max(1, -(-most // rows_per_bucket))
    shuffled = sized.filter("n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    shuffled = shuffled.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * buckets).cast("int"))
    queued = cut(running_sum(shuffled.join(F.broadcast(goals.select("source").distinct()), "source"), ["source"], "bucket", [F.shiftrightunsigned("h", 11), "h", "doc_id", "n_tokens"], "n_tokens", "upto"), "queue")
    # Copies of a document in a mix: those that can finish before the closing time and one more, exact selection follows.
    due = queued.join(F.broadcast(goals.filter("weight > 0 AND max_repeats > 0")), "source")
    last = F.least(F.col("max_repeats").cast("double"), F.floor(F.greatest(F.col("closing") * F.col("weight") - F.col("upto"), F.lit(0.0)) / F.col("supply")) + 2).cast("int")
    copies = due.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), last)))
    copies = copies.withColumn("finish_time", (F.col("upto") + (F.col("repeat_no") - 1) * F.col("supply")) / F.col("weight"))
    # By the closing time at most the budget has finished; one further document of each source may still fit.
    early = copies.filter("finish_time <= closing").select("mix_name", "doc_id", "source", "repeat_no", "n_tokens", "finish_time", "budget", "closing")
    after = copies.filter("finish_time > closing").groupBy("mix_name", "source").agg(F.min("finish_time").alias("f")).groupBy("mix_name").agg(F.max("f").alias("limit"))
    late = copies.join(F.broadcast(after), "mix_name").filter("finish_time > closing AND finish_time <= limit").select(*early.columns)
    ranked = early.unionByName(late)
    # Buckets of about equal rows: by the hash order, a source of n rows and T tokens finishes n w / T of them a unit of time,
    # until its last repeat. The rows of all sources up to a time follow from that without looking at any.
    flow = F.struct((F.col("n_docs") * F.col("weight") / F.col("supply")).alias("rate"), (F.col("n_docs") * F.col("max_repeats")).alias("most"))
    flows = goals.filter("weight > 0 AND max_repeats > 0 AND supply > 0").groupBy("mix_name").agg(F.collect_list(flow).alias("flows"))
    rows_before = F.aggregate("flows", F.lit(0.0), lambda n, f: n + F.least(f["rate"] * F.col("finish_time"), f["most"].cast("double")))
    ranked = ranked.join(F.broadcast(flows), "mix_name")
    ranked = ranked.withColumn("bucket", F.floor(rows_before / rows_per_bucket).cast("int")).drop("flows")
    ordered = running_sum(ranked, ["mix_name"], "bucket", ["finish_time", "source", "doc_id", "repeat_no"], "n_tokens", "end_token")
    chosen = cut(ordered.filter("end_token <= budget").select("mix_name", "doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", "finish_time", "end_token"), "mix")
    used = chosen.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), F.max("repeat_no").alias("max_used"))
    size = used.groupBy("mix_name").agg(F.sum("n_tokens").alias("size"))
    shares = goals.join(used, ["mix_name", "source"], "left").join(size, "mix_name", "left").select("mix_name", "source", "target_share", (F.coalesce(F.col("n_tokens"), F.lit(0)) / F.col("size")).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("max_used", F.lit(0)).alias("max_used"), (F.col("supply") * F.greatest("max_repeats", F.lit(0)) <= F.col("closing") * F.col("weight")).alias("exhausted"))
    return chosen, shares


__all__ = ["count_tokens", "mix_sources", "source_key", "TOKENIZER"]
