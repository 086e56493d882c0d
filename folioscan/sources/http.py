"""A data source that fetches documents over HTTP; failures are rows, not failed tasks."""

from __future__ import annotations

import hashlib
import os
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "folioscan/0.1"
FETCHED = "url string, ok boolean, content string, error string, code string, duration_ms int"


def tls_context(ca_bundle: str | None = None) -> ssl.SSLContext:
    """A verifying context: the given bundle, the environment's, the system's store, certifi, else the default. Never unverified."""
    for path in (ca_bundle, os.environ.get("SSL_CERT_FILE"), os.environ.get("REQUESTS_CA_BUNDLE")):
        if path:
            return ssl.create_default_context(cafile=path)
    for name in ("truststore", "certifi"):
        try:
            module = __import__(name)
        except ImportError:
            continue
        return module.SSLContext(ssl.PROTOCOL_TLS_CLIENT) if name == "truststore" else ssl.create_default_context(cafile=module.where())
    return ssl.create_default_context()


def error_code(error: BaseException) -> str:
    """A code for the kind of failure."""
    if isinstance(error, ValueError) and type(error).__name__ == "JSONDecodeError":
        return "PARSE_ERROR"
    seen = f"{error} {getattr(error, 'reason', '')}".lower()
    if isinstance(error, ssl.SSLError) or isinstance(getattr(error, "reason", None), ssl.SSLError) or "certificate verify failed" in seen:
        return "TLS_ERROR"
    if isinstance(error, urllib.error.HTTPError):
        return f"HTTP_{error.code}"
    return "URL_ERROR" if isinstance(error, urllib.error.URLError) else "REQUEST_ERROR"


# The answers after which a status-aware request is repeated.
REPEATED = (429, 500, 502, 503, 504)


def fetch(
    url: str,
    timeout: float = 30,
    tries: int = 3,
    wait: float = 0.5,
    context: ssl.SSLContext | None = None,
    opener: Callable | None = None,
    status_aware: bool = False,
) -> dict:
    """One document as a row. Waits grow with the tries.

    ``status_aware`` repeats after the answers of :data:`REPEATED` only, with
    waits of up to ten seconds at the default ``wait``; other refusals end at once.
    """
    began, opener = time.time(), opener or urllib.request.urlopen
    request, last = urllib.request.Request(url, headers={"User-Agent": AGENT}), None
    spent = lambda: int((time.time() - began) * 1000)
    for n in range(1, tries + 1):
        try:
            with opener(request, timeout=timeout, **({"context": context} if context else {})) as answer:
                body = answer.read().decode("utf-8", errors="replace")
            return {"url": url, "ok": True, "content": body, "error": "", "code": "", "duration_ms": spent()}
        except urllib.error.HTTPError as e:
            last = e
            if status_aware and e.code not in REPEATED:
                break
            pause = min(4 * wait * n, 20 * wait) if status_aware else wait * n
        except Exception as e:  # noqa: BLE001 - any failure becomes a row
            last, pause = e, wait * n
        if n < tries:
            time.sleep(pause)
    return {"url": url, "ok": False, "content": "", "error": str(last), "code": error_code(last), "duration_ms": spent()}


def _fetcher(options: dict) -> Callable[[str], dict]:
    """:func:`fetch` with the options of a reader, which may be texts."""
    context = tls_context(options.get("cabundle"))
    aware = str(options.get("status_aware", "false")).lower() == "true"
    timeout, tries, wait = float(options.get("timeout", 30)), int(options.get("tries", 3)), float(options.get("wait", 0.5))
    return lambda url: fetch(url, timeout, tries, wait, context if url.startswith("https") else None, status_aware=aware)


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        urls = [u for u in self.options.get("urls", "").split("\n") if u]
        workers = max(1, int(self.options.get("workers", 8)))
        return [_Part(urls[k::workers]) for k in range(min(workers, max(1, len(urls))))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        get = _fetcher(self.options)
        for url in partition.urls:
            row = get(url)
            yield tuple(row[c] for c in ("url", "ok", "content", "error", "code", "duration_ms"))


class HttpSource(DataSource):
    """``spark.read.format("folioscan_http").option("urls", "\\n".join(...))``; a partition is one worker."""

    @classmethod
    def name(cls) -> str:
        return "folioscan_http"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetch_frame(urls: DataFrame, column: str = "url", workers: int = 8, **options) -> DataFrame:
    """The same for a DataFrame of URLs of any size: ``workers`` partitions fetch side by side; options as of the source."""
    import pandas as pd

    def run(batches):
        get = _fetcher(options)
        for batch in batches:
            yield pd.DataFrame([get(u) for u in batch[column]], columns=["url", "ok", "content", "error", "code", "duration_ms"])

    return urls.select(column).repartition(workers).mapInPandas(run, FETCHED)


def payload_urls(tags: DataFrame, base: str) -> DataFrame:
    """``tag, full_label, part, url`` of the three documents of each tag."""
    # The parts and the ends of their addresses.
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(e).alias("end")) for p, e in (("structure", "structure"), ("statement", "content/statement"), ("full", "content/full"))])
    return tags.select("tag", "full_label", F.explode(parts).alias("x")).select("tag", "full_label", "x.part", F.concat(F.lit(f"{base}/data/tag/"), "tag", F.lit("/"), "x.end").alias("url"))


def assemble_payloads(asked: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """Payload rows of the fetched parts, with the hash of statement and full text."""
    got = asked.join(fetched, "url").groupBy("tag", "full_label").pivot("part", ["structure", "statement", "full"]).agg(F.first(F.struct("ok", "url", "content", "error", "duration_ms")))
    text = lambda p: F.coalesce(F.col(f"{p}.content"), F.lit(""))
    return got.select("tag", "full_label", F.lit(now).cast("bigint").alias("fetched_at_utc"), "structure", "statement", "full", F.sha2(F.concat_ws("\n", text("statement"), text("full")), 256).alias("content_hash"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def payload_hash(statement: str, full: str) -> str:
    return hashlib.sha256(f"{statement}\n{full}".encode()).hexdigest()
