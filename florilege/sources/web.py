"""HTTP with the standard library: text, JSON, paged records, site maps, and whether links answer.

Transports are made of plain values, so tasks can open their own connections; every function takes a timeout.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.parse import parse_qsl, urlencode, urlsplit
from urllib.request import Request, urlopen
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.urls import safe_address
from florilege.sources.paged import Fetch, roots

AGENT = "florilege"
#: Statuses after which a link that refuses HEAD is asked for as a whole.
REFUSED = (403, 405)


def body(url: str, timeout: float = 30, accept: str = "*/*", method: str = "GET") -> tuple[bytes, int, dict[str, str], str]:
    """Content, status, headers in lower case, and the address that answered."""
    request = Request(safe_address(url), headers={"User-Agent": AGENT, "Accept": accept}, method=method)
    with urlopen(request, timeout=timeout) as answer:
        return answer.read(), answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.geturl()


def text(url: str, timeout: float = 30) -> tuple[str, int, dict[str, str]]:
    """What is no UTF-8 is replaced."""
    content, status, headers, _ = body(url, timeout)
    return content.decode("utf-8", "replace"), status, headers


def record(url: str, timeout: float = 60) -> tuple[object, dict[str, str]]:
    """JSON with its headers."""
    content, _, headers, _ = body(url, timeout, "application/json")
    return json.loads(content.decode("utf-8")), headers


def address(base: str, endpoint: str, **parameters) -> str:
    """An endpoint's address with the parameters that aren't None."""
    return f"{base.rstrip('/')}/{endpoint}?{urlencode({k: v for k, v in parameters.items() if v is not None})}"


def pages(base: str, fields: str | None = None, per_page: int = 100, total: str = "x-wp-totalpages", timeout: float = 60, pause_s: float = 0.03) -> Fetch:
    """A transport for paged.scan: the number of pages is told by a header."""

    def fetch(endpoint: str, page: int) -> tuple[list[dict], int]:
        found, headers = record(address(base, endpoint, per_page=per_page, page=page, _fields=fields), timeout)
        time.sleep(pause_s)
        return found, int(headers.get(total, "1") or 1)

    return fetch


#: What a connection fails with: refusals, answers that break off, and addresses that are none.
FAILURES = (OSError, HTTPException, ValueError)


def site_map(base: str, timeout: float = 30, most: int = 50_000) -> list[str]:
    """Distinct addresses of a site's maps, from the usual places and robots.txt; maps that can't be read are passed over. A site
    with more than `most` maps ends with an error; paged.crawl takes any number."""

    def fetched(url: str) -> str | None:
        try:
            return text(url, timeout)[0]
        except FAILURES:
            return None

    waiting, seen, found = roots(base.rstrip("/"), fetched(f"{base.rstrip('/')}/robots.txt")), set(), set()
    while waiting:
        url = waiting.pop(0)
        if url in seen:
            continue
        if len(seen) >= most:
            raise ValueError(f"more than {most} maps")
        seen.add(url)
        try:
            root = ElementTree.fromstring((fetched(url) or "").encode())
        except ElementTree.ParseError:
            continue
        for node in root.iter():
            if isinstance(node.tag, str) and node.tag.rsplit("}", 1)[-1] in ("sitemap", "url"):
                loc = next((c.text.strip() for c in node if isinstance(c.tag, str) and c.tag.rsplit("}", 1)[-1] == "loc" and c.text), None)
                if loc:
                    waiting.append(loc) if node.tag.endswith("sitemap") else found.add(loc)
    return sorted(found)


def answer(url: str, timeout: float = 12) -> tuple[int | None, str, str | None]:
    """Status, final address and error of a link: by its head, or as a whole where heads are refused."""
    status, final = None, ""
    for method in ("HEAD", "GET"):
        try:
            _, status, _, final = body(url, timeout, method=method)
            return status, final, None
        except HTTPError as e:
            status, final = e.code, e.geturl()
            if status not in REFUSED:
                return status, final, None
        except FAILURES as e:
            return status, final, repr(e)[:200]
    return status, final, None


def checked(links: DataFrame, timeout: float = 12, pause_s: float = 0.02, tasks: int = 4) -> DataFrame:
    """links (url) with status, final and error, each address asked for once, by a few tasks."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                rows.append((url, *answer(url, timeout)))
                time.sleep(pause_s)
            out = pd.DataFrame(rows, columns=["url", "status", "final", "error"])
            yield out.astype({"status": "Int32"})

    return links.select("url").where(F.col("url").isNotNull()).distinct().repartition(tasks, "url").mapInPandas(ask, "url string, status int, final string, error string")


def parameters(url: str) -> dict[str, str]:
    """The query of an address."""
    return dict(parse_qsl(urlsplit(url).query, keep_blank_values=True))


def texts(spark: SparkSession, urls: list[str], timeout: float = 30) -> DataFrame:
    """(url, text, error) of a list of addresses."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, text(url, timeout)[0], None))
                except FAILURES as e:
                    rows.append((url, None, repr(e)[:200]))
            yield pd.DataFrame(rows, columns=["url", "text", "error"])

    return spark.createDataFrame([(u,) for u in urls], "url string").mapInPandas(read, "url string, text string, error string")
