"""A data source for paged listings. A port fetches a page; offline it is a function of the page's number."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A page: rows, and whether more may follow.
Fetch = Callable[[str, int], tuple[list[dict], bool]]


def fetch_files(root: str, page: int) -> tuple[list[dict], bool]:
    """Pages kept as files: root/0.json, root/1.json, ... each a list of objects."""
    from pathlib import Path

    path = Path(root) / f"{page}.json"
    if not path.exists():
        return [], False
    return json.loads(path.read_text()), True


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], fetch: Fetch):
        self.options, self.columns, self.fetch = options, columns, fetch

    def partitions(self) -> list[InputPartition]:
        """A partition a listing: pages of one listing follow one another."""
        return [InputPartition(x) for x in self.options["listings"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, seen, most = 0, set(), int(self.options.get("maxpages", "1000000"))
        while page < most:
            rows, more = self.fetch(partition.value, page)
            for r in rows:
                text = json.dumps(r, sort_keys=True)
                if r.get("id") is None or r["id"] not in seen:  # pages may overlap
                    seen.add(r.get("id"))
                    yield (partition.value, str(r["id"]) if r.get("id") is not None else None, text)
            if not more or not rows:
                return
            page += 1


class PagedSource(DataSource):
    """format("paged") with options listings (comma-joined) and maxpages: listing, id, row as JSON."""

    fetch: Fetch = staticmethod(fetch_files)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "listing string, id string, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options), [f.name for f in schema], type(self).fetch)


def register(spark: SparkSession, fetch: Fetch | None = None, name: str = "paged") -> None:
    kind = type("Paged", (PagedSource,), {"name": classmethod(lambda cls: name)} | ({"fetch": staticmethod(fetch)} if fetch else {}))
    spark.dataSource.register(kind)
