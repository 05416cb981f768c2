"""Fetching with retries. The transport is handed in, so tests and offline runs need no network."""

from __future__ import annotations

import hashlib
import os
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from hustings.config import DEFAULTS, SECRET_KEYS, Settings


@dataclass(frozen=True)
class Reply:
    """What a transport gives: status (0: no connection, -1: timeout), text and the URL that answered."""

    status: int
    text: str = ""
    url: str = ""


Transport = Callable[[str, float], Reply]


def urlopen_transport(url: str, timeout: float) -> Reply:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "hustings/0.1"}), timeout=timeout) as r:
            return Reply(r.status, r.read().decode("utf-8", "replace"), r.geturl())
    except urllib.error.HTTPError as e:
        return Reply(e.code, "", url)
    except TimeoutError:
        return Reply(-1, "", url)
    except OSError:
        return Reply(0, "", url)


def without_secrets(url: str) -> str:
    """The URL without the query keys that hold secrets; the driver's and workers' twin of ``sanitized_url``."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    p = urlsplit(url)
    return urlunsplit(p._replace(query=urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in SECRET_KEYS])))


def fetch(url: str, transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, str]:
    """(text, URL without secrets, error type or ''): rate limits wait longer at each attempt, so do lost connections."""
    safe, error = without_secrets(url), ""
    for attempt in range(1, s.scrape_retry_max_attempts + 1):
        r = transport(url, s.scrape_request_timeout_seconds)
        safe = without_secrets(r.url or url)
        if r.status == 200:
            return r.text, safe, ""
        error = {0: "connection_error", -1: "timeout"}.get(r.status, f"http_{r.status}")
        if r.status not in (0, -1, 429):
            break
        if attempt < s.scrape_retry_max_attempts:
            sleep((s.rate_limit_backoff_seconds if r.status == 429 else int(s.scrape_retry_backoff_seconds)) * attempt)
    return "", safe, error


def fetch_all(urls: DataFrame, transport: Transport, s: Settings = DEFAULTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, text, request_url, error_type) of each distinct URL, fetched once, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b["url"].to_pylist():
                text, safe, error = fetch(url, transport, s, sleep)
                yield pa.RecordBatch.from_pydict({"url": [url], "text": [text], "request_url": [safe], "error_type": [error]})

    return urls.select("url").filter("url <> ''").distinct().mapInArrow(run, "url string, text string, request_url string, error_type string")


def download(url: str, to: str, read: Callable[[str], Iterator[bytes]]) -> tuple[str, str]:
    """(path, md5): written beside the target and moved there only if the content is new."""
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    digest = hashlib.md5()
    fd, part = tempfile.mkstemp(dir=os.path.dirname(to) or ".", suffix=".tmp")
    try:
        with os.fdopen(fd, "wb") as f:
            for chunk in read(url):
                digest.update(chunk)
                f.write(chunk)
        if not (os.path.exists(to) and local_md5(to) == digest.hexdigest()):
            os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return to, digest.hexdigest()


def local_md5(path: str, chunk: int = 8 << 20) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            digest.update(block)
    return digest.hexdigest()
