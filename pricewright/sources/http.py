"""Polite fetching: robots rules, a pause per host, a cache, retries. Runs where partitions are by host."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FetchError(Exception):
    pass


def _open(url: str, agent: str, timeout: float) -> str:
    with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


@dataclass
class Fetcher:
    """get(url) gives a page's text, or raises FetchError."""

    agent: str = "pricewright"
    pause: float = 2.0
    tries: int = 3
    keep: float = 6 * 3600
    cache: str = ""
    read: Callable[[str, str, float], str] = _open
    sleep: Callable[[float], None] = time.sleep
    rules: dict[str, RobotFileParser] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)

    def allowed(self, url: str) -> bool:
        at = urlsplit(url)
        if at.netloc not in self.rules:
            rules = RobotFileParser()
            try:
                rules.parse(self.read(f"{at.scheme}://{at.netloc}/robots.txt", self.agent, 10).splitlines())
            except Exception:  # without rules everything is allowed
                rules.parse([])
            self.rules[at.netloc] = rules
        return self.rules[at.netloc].can_fetch(self.agent, url)

    def _kept(self, url: str) -> Path | None:
        return Path(self.cache, hashlib.sha1(url.encode()).hexdigest()) if self.cache else None

    def get(self, url: str) -> str:
        kept = self._kept(url)
        if kept and kept.exists() and time.time() - kept.stat().st_mtime < self.keep:
            return kept.read_text()
        if not self.allowed(url):
            raise FetchError(f"robots.txt forbids {url}")
        host = urlsplit(url).netloc
        for n in range(self.tries):
            wait = self.last.get(host, 0) + self.pause * random.uniform(1, 1.25) - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last[host] = time.monotonic()
            try:
                body = self.read(url, self.agent, 20)
            except Exception as e:
                if n + 1 == self.tries:
                    raise FetchError(str(e)) from e
                self.sleep(2**n)
                continue
            if kept:
                kept.parent.mkdir(parents=True, exist_ok=True)
                kept.write_text(body)
            return body
        raise FetchError(url)


def fetch(urls: DataFrame, fetcher: Fetcher | None = None) -> DataFrame:
    """(url, html) of the addresses that could be fetched; a host's are in one partition, so that its pause holds."""
    tool = fetcher or Fetcher()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for u in part.url:
                try:
                    got.append((u, tool.get(u)))
                except FetchError:
                    continue
            yield pd.DataFrame(got, columns=["url", "html"])

    return urls.select("url").distinct().repartition(F.regexp_extract("url", "//([^/]+)", 1)).mapInPandas(run, "url string, html string")
