"""Sinks: tables, JSON lines, small JSON documents, versioned tables and a leaderboard."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Observation

from folioscan.operators.incremental import Swap
from folioscan.sources.readers import path_exists


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> int:
    """JSON lines through the engine's commit protocol; the row count comes from the same job."""
    seen = Observation()
    # After the sort: what is below one is computed twice, for its ranges and for its rows.
    (df.orderBy(order) if order else df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_json(spark: SparkSession, obj, path: str, indent: int = 2) -> None:
    """A small document, written aside and renamed over the old one."""
    Swap(spark, path.rsplit("/", 1)[0]).put(json.dumps(obj, ensure_ascii=False, indent=indent) + "\n", path)


def read_json(spark: SparkSession, path: str, default=None):
    if not path_exists(spark, path):
        return default
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_version(df: DataFrame, root: str, meta: dict | None = None) -> int:
    """Write the next version of a table and make it current; readers of the old one are not disturbed."""
    spark = df.sparkSession
    current = read_json(spark, f"{root}/CURRENT", {"version": 0})
    version = current["version"] + 1
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
    write_json(spark, {"version": version} | (meta or {}), f"{root}/CURRENT")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{read_json(spark, f'{root}/CURRENT')['version']}")


def fetch_summary(plan: DataFrame, fetched: DataFrame, now: int) -> dict:
    """Counts of a fetch: reasons of what was left, failures, and an exit code (2 nothing worked, 1 some failed)."""
    reasons = {r.reason: r.n for r in plan.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    ok, bad = fetched.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    return {"skip_reasons": {k: v for k, v in reasons.items() if k == "cache_valid"}, "refresh_reasons": {k: v for k, v in reasons.items() if k != "cache_valid"}, "fetched": ok or 0, "failed": bad or 0, "generated_at_utc": now, "exit_code": 0 if not bad else 1 if ok else 2}


def leaderboard_markdown(board: DataFrame, top: int = 20) -> str:
    """The best ``top`` rows of a leaderboard as a table, and the best combination."""
    rows = board.limit(top).collect()
    names = [c for c in board.columns if c not in ("cand_idx", "route_idx")]
    out = ["| # | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for n, r in enumerate(rows, 1):
        out.append(f"| {n} | " + " | ".join(f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |")
    if rows:
        out += ["", "Best: " + ", ".join(f"{c}={rows[0][c]}" for c in names)]
    return "\n".join(out) + "\n"
