"""Paged record services as a Spark data source: a partition per page, retries, and a table of pages that failed.

The transport is a function (endpoint, page) -> (records, total pages); offline ones read files. source() makes a data source of
one, for batches and for streams. A stream's offset is the last page it has read, so a scan that ends goes on from its
checkpoint when it is started again, and reads what has been added since.
"""

from __future__ import annotations

import http.client
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from florilege.operators.stored import opened, qualified, shared_dir, stored

Fetch = Callable[[str, int], tuple[list[dict], int]]

#: What a transport fails with: connections, answers that break off, and answers that are no JSON.
FAILURES = (OSError, http.client.HTTPException, json.JSONDecodeError, UnicodeDecodeError)
SCHEMA = "page long, record string, error string"
#: Partitions of a scan at most; a service isn't asked by more tasks at once, and a task's start costs more than a page.
TASKS = 32


def asked(fetch: Fetch, endpoint: str, page: int, attempts: int = 3, wait_s: float = 2.0) -> tuple[list[dict], int]:
    """A page's answer; the last failure is raised after some attempts, with longer waits between them."""
    for k in range(1, attempts + 1):
        try:
            return fetch(endpoint, page)
        except FAILURES:
            if k == attempts:
                raise
            time.sleep(wait_s * k)
    raise ValueError("at least one attempt is needed")


def dealt(pages: list[int]) -> list[InputPartition]:
    """A partition per page, or where there are more than TASKS pages, that many runs of pages."""
    size = -(-len(pages) // TASKS) or 1
    return [InputPartition(pages[k : k + size]) for k in range(0, len(pages), size)]


def source(fetch: Fetch, name: str) -> type[DataSource]:
    """A data source over a transport: format(name) with options endpoint, attempts, wait_s, start (of the pages after the first,
    those from here on are read), most_pages, and for batches total (asked for where it isn't given)."""

    class Reader:
        def __init__(self, options: dict):
            self.endpoint = options["endpoint"]
            self.attempts, self.wait_s = int(options.get("attempts", 3)), float(options.get("wait_s", 2.0))
            self.start, self.most = int(options.get("start", 1)), int(options.get("most_pages", 0))
            self.known = int(options.get("total", 0))

        def total(self) -> int:
            """Pages there are; where the first can't be read, the scan ends with its failure."""
            total = self.known or asked(fetch, self.endpoint, 1, self.attempts, self.wait_s)[1]
            return min(total, self.most or total)

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            for page in partition.value:
                try:
                    records, _ = asked(fetch, self.endpoint, page, self.attempts, self.wait_s)
                    rows = [{"page": page, "record": json.dumps(r), "error": None} for r in records]
                except FAILURES as e:
                    if page == 1:
                        raise
                    rows = [{"page": page, "record": None, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page", pa.int64()), ("record", pa.string()), ("error", pa.string())]))

    class Batch(Reader, DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return dealt([1, *range(max(2, self.start), self.total() + 1)])

    class Stream(Reader, DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"page": 0}

        def latestOffset(self) -> dict:
            return {"page": self.total()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return dealt(list(range(start["page"] + 1, end["page"] + 1)))

        def commit(self, end: dict) -> None:
            pass

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Batch(dict(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(dict(self.options))

    return Pages


def _registered(spark: SparkSession, fetch: Fetch) -> str:
    name = f"pages_{uuid.uuid4().hex}"
    spark.dataSource.register(source(fetch, name))
    return name


def _parsed(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    records = raw.where("record IS NOT NULL").select("page", F.from_json("record", schema).alias("r")).select("page", "r.*")
    return records, raw.where("error IS NOT NULL").select("page", "error")


def scan(spark: SparkSession, endpoint: str, fetch: Fetch, schema: str, attempts: int = 3, wait_s: float = 2.0, most_pages: int | None = None, start: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records, skipped pages). The first page must come; a later one that fails every attempt is listed as skipped.

    start: of the pages after the first, those from here on are read.
    """
    _, total = asked(fetch, endpoint, 1, attempts, wait_s)
    options = {"endpoint": endpoint, "attempts": attempts, "wait_s": wait_s, "start": start, "most_pages": most_pages or 0, "total": total}
    raw = spark.read.format(_registered(spark, fetch)).options(**options).load()
    return _parsed(stored(raw, f"scan-{endpoint.strip('/').replace('/', '-')}"), schema)


def followed(spark: SparkSession, endpoint: str, fetch: Fetch, schema: str, folder: str, attempts: int = 3, wait_s: float = 2.0, most_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skipped pages) of a scan that keeps what it has read, and how far it got, below folder.

    Called again it reads the pages behind those of earlier calls only, whether these came to their end or not: each page's rows
    are there once. Pages that were skipped stay so; give them to scan.
    """
    options = {"endpoint": endpoint, "attempts": attempts, "wait_s": wait_s, "most_pages": most_pages or 0}
    stream = spark.readStream.format(_registered(spark, fetch)).options(**options).load()
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/pages").trigger(availableNow=True).start()
    running.awaitTermination()
    return _parsed(spark.read.schema(SCHEMA).parquet(f"{folder}/pages"), schema)


def folder_pages(spark: SparkSession, folder: str) -> Fetch:
    """An offline transport: folder/endpoint/page=<number>/ holds a page's records as JSON lines, and the number of pages is the
    largest there; a page that isn't there fails as a connection does."""
    uri = qualified(spark, folder)

    def fetch(endpoint: str, page: int) -> tuple[list[dict], int]:
        from pyarrow import fs

        system, root = opened(uri)
        of = lambda path: [x for x in system.get_file_info(fs.FileSelector(path)) if x.base_name[:1] not in "._"]
        total = max(int(x.base_name.partition("=")[2]) for x in of(f"{root}/{endpoint}")) if page == 1 else 0
        records = []
        for part in sorted(of(f"{root}/{endpoint}/page={page}"), key=lambda x: x.path):
            with system.open_input_stream(part.path, compression=None) as file:
                records += [json.loads(line) for line in file.read().decode().splitlines() if line]
        return records, total

    return fetch


def resumed(spark: SparkSession, endpoint: str, fetch: Fetch, schema: str, cached: DataFrame, total: int, per_page: int, near: int = 25, key: str = "id", **options) -> tuple[DataFrame, DataFrame | None]:
    """(records, skipped pages) of a scan that goes on where a cache (the records' columns) ended.

    A cache that lacks `near` of `total` records at most is taken as it is. Else the first page is read again, then pages from
    the cache's end on, and new records are added to those that are there.
    """
    held = cached.count()
    if held >= total - near:
        return cached, None
    found, skipped = scan(spark, endpoint, fetch, schema, start=max(2, held // per_page + 1), **options)
    new = without_repeats(found, key).join(cached.select(key), key, "left_anti").select(*cached.columns)
    return cached.unionByName(new), skipped


def continued(spark: SparkSession, fetch: Callable[[str | None], tuple[list[str], str | None]], most: int = 1_000_000, held: int = 100_000) -> DataFrame:
    """(place, id) of a listing whose pages name the next one by a token: each needs the one before, so they are read in turn. The
    ids are written whenever so many are held, so the driver never has the whole listing."""
    folder = f"{shared_dir(spark)}/florilege/listing-{uuid.uuid4().hex}"
    ids: list[str] = []
    token, place = None, 0
    for _ in range(most):
        found, token = fetch(token)
        ids += found
        if token is None or len(ids) >= held:
            spark.createDataFrame([(place + k, i) for k, i in enumerate(ids)], "place long, id string").write.mode("append").parquet(folder)
            place, ids = place + len(ids), []
        if token is None:
            return spark.read.schema("place long, id string").parquet(folder)
    raise ValueError("the listing doesn't end")


def folder_tokens(spark: SparkSession, folder: str) -> Callable[[str | None], tuple[list[str], str | None]]:
    """An offline listing: folder/page=<number>/ holds ids as JSON lines; a page's token is its number, and the next one's that of
    the next page there is."""
    pages = folder_pages(spark, folder)

    def fetch(token: str | None) -> tuple[list[str], str | None]:
        number = int(token or 1)
        found, _ = pages(".", number)
        try:
            pages(".", number + 1)
        except OSError:
            return [r["id"] for r in found], None
        return [r["id"] for r in found], str(number + 1)

    return fetch


def batches(listed: DataFrame, size: int = 50) -> DataFrame:
    """(batch, ids) of (place, id), `size` ids each, joined for a request."""
    numbered = listed.select(F.floor(F.col("place") / size).alias("batch"), F.struct("place", "id").alias("x"))
    return numbered.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), "|").alias("ids"))


def roots(base: str, robots: str | None) -> list[str]:
    """Where site maps may begin: two usual places, and what robots.txt names."""
    named = [line.split(":", 1)[1].strip() for line in (robots or "").splitlines() if line.lower().startswith("sitemap:")]
    return list(dict.fromkeys([f"{base}/wp-sitemap.xml", f"{base}/sitemap.xml", *named]))


def without_repeats(records: DataFrame, key: str = "id") -> DataFrame:
    """The first record of each id by page: pages shift while they are read."""
    from florilege.operators.dedup import first_seen

    return first_seen(records, [key], ["page"])


def crawl(spark: SparkSession, roots: list[str], documents: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Distinct addresses of nested site maps: documents (url, loc, is_index) as fetched; unreachable ones have no rows. Maps
    nested deeper than most_rounds end the crawl with an error."""
    frontier = spark.createDataFrame([(r,) for r in roots], "url string").distinct()
    visited, found = frontier, None
    for _ in range(most_rounds):
        rows = stored(documents.join(frontier, "url").select("loc", "is_index"), "sitemap")
        pages = rows.where("NOT is_index").select(F.col("loc").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        frontier = stored(rows.where("is_index").select(F.col("loc").alias("url")).distinct().join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            return found.distinct()
        visited = visited.unionByName(frontier)
    raise ValueError(f"site maps are nested deeper than {most_rounds}")
