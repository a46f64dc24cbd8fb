"""A REST search of repositories as a Python data source, their activity, and their copies; clients are injected, so tests
need no network."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "name string, url string, stars int, owner string"
PAGE = 100
API = "https://api.github.com"


def fetch(get: Callable, url: str, tries: int = 3, sleep: Callable = time.sleep) -> dict | None:
    """200 is returned; 403 waits for the reset, or a minute if none is told, and counts for nothing; 404 is null; else
    2, 4, 8 seconds and again."""
    k = 0
    while k < tries:
        status, headers, body = get(url)
        if status == 200:
            return body
        if status == 404:
            return None
        if status == 403:
            now = time.time()
            wait = int(headers.get("X-RateLimit-Reset", now + 60)) - int(now)
            if wait > 0:
                sleep(wait + 1)
            continue
        k += 1
        sleep(2**k)
    return None


def pages(search: Callable[[int | None], list[dict]], quota: int) -> Iterator[dict]:
    """By stars, downwards: each page asks for fewer than the last one's fewest, until a short page or the quota."""
    below, seen = None, 0
    while seen < quota:
        page = search(below)
        yield from page
        seen += len(page)
        if len(page) < PAGE:
            return
        below = min(r["stars"] for r in page)


def recent(get: Callable, owner: str, name: str, since: str, **options) -> bool:
    """Whether there is a commit since then; not so if that cannot be told."""
    return bool(fetch(get, f"{API}/repos/{owner}/{name}/commits?since={since}&per_page=1", **options))


def merge_rate(get: Callable, owner: str, name: str, **options) -> float:
    """The share of merged ones among the last hundred requests; 0 without any."""
    found = fetch(get, f"{API}/repos/{owner}/{name}/pulls?state=all&per_page={PAGE}", **options) or []
    return sum(r.get("merged_at") is not None for r in found) / len(found) if found else 0.0


def with_activity(repos: DataFrame, get: Callable, since: str, least: float = 0.1, delay: float = 0.1) -> DataFrame:
    """Repos (name, url, stars, owner) with `active`: a commit since then and enough merged requests."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            found = []
            for owner, name in zip(batch["owner"], batch["name"]):
                found.append(bool(owner and name) and recent(get, owner, name, since) and merge_rate(get, owner, name) >= least)
                time.sleep(delay)
            yield batch.assign(active=found)

    return repos.select("name", "url", "stars", "owner").mapInPandas(run, SCHEMA + ", active boolean")


def git_clone(url: str, path: str) -> None:
    subprocess.run(["git", "clone", url, path], check=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)


def cloned(repos: DataFrame, folder: str, clone: Callable[[str, str], None] = git_clone) -> DataFrame:
    """(name, status) of copies of repos (name, url) in a folder that all executors share: cloned, exists, or why not."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            told = []
            for name, url in zip(batch["name"], batch["url"]):
                path = f"{folder}/{name}"
                if os.path.exists(path):
                    told.append("exists")
                    continue
                try:
                    clone(url, path)
                    told.append("cloned")
                except Exception as e:  # noqa: BLE001
                    told.append(f"failed: {e}")
            yield batch[["name"]].assign(status=told)

    return repos.filter("url <> ''").select("name", "url").mapInPandas(run, "name string, status string")


def acquire(spark: SparkSession, language: str, search: Callable, get: Callable, since: str, folder: str, quota: int = 100, clone: Callable[[str, str], None] = git_clone) -> DataFrame:
    """Finds repositories, writes all and the active ones as JSON, and copies the active ones: (name, status)."""
    rows = [(r["name"], r["url"], r["stars"], r["owner"]) for r in pages(lambda below: search(language, below), quota)]
    repos = spark.createDataFrame(rows, SCHEMA)
    with_activity(repos, get, since).write.mode("overwrite").json(f"{folder}/{language}_checked")
    known = spark.read.schema(SCHEMA + ", active boolean").json(f"{folder}/{language}_checked")
    known.drop("active").write.mode("overwrite").json(f"{folder}/{language}_metadata")
    known.filter("active").drop("active").write.mode("overwrite").json(f"{folder}/{language}_active_metadata")
    return cloned(spark.read.schema(SCHEMA).json(f"{folder}/{language}_active_metadata"), f"{folder}/{language}", clone)


class Repositories(DataSource):
    """Options language and quota; `search(language, below)` is set on the class."""

    search: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).search)


class _Reader(DataSourceReader):
    def __init__(self, options, search):
        self.language, self.quota, self.search = options.get("language", "c"), int(options.get("quota", "100")), search

    def read(self, partition):
        if self.search is None:
            raise ValueError("no client: set Repositories.search")
        for r in pages(lambda below: self.search(self.language, below), self.quota):
            yield (r["name"], r["url"], r["stars"], r["owner"])
