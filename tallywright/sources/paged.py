"""A paged provider as a Spark data source: one task an account, which follows continuations to the end.

A fetch is all or nothing: an account's pages are held until the last one has come, at most `cap` of them, and
a fetch that doesn't end within the cap or fails on the way gives one row with its error and no page.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "account_id long, page_no int, page string, error string"
PAGE_CAP = 60


class Account(InputPartition):
    def __init__(self, account_id: int):
        super().__init__(account_id)
        self.account_id = account_id


class PagedReader(DataSourceReader):
    def __init__(self, client: str, accounts: list[int], date_from: str, cap: int):
        self.client, self.accounts, self.date_from, self.cap = client, accounts, date_from, cap

    def partitions(self) -> list[Account]:
        return [Account(a) for a in self.accounts]

    def read(self, partition: Account) -> Iterator[tuple]:
        module, name = self.client.split(":")
        fetch: Callable[[int, str, str | None], tuple[str, str | None]] = getattr(importlib.import_module(module), name)
        pages, key = [], None
        try:
            while len(pages) < self.cap:
                page, key = fetch(partition.account_id, self.date_from, key)
                pages.append(page)
                if not key:
                    break
        except Exception as e:  # a provider's refusal is a result, not a failed job: the other accounts go on
            yield partition.account_id, None, None, f"{type(e).__name__} on page {len(pages) + 1}"
            return
        if key:
            yield partition.account_id, None, None, f"not ended after {self.cap} pages"
            return
        for n, page in enumerate(pages):
            yield partition.account_id, n, page, None


class PagedSource(DataSource):
    """Options: client ("module:function" of account, date_from, continuation, which gives a page as JSON and the next continuation), accounts (ids by comma), date_from, cap."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        o = self.options
        return PagedReader(o["client"], [int(a) for a in o["accounts"].split(",") if a], o.get("date_from", ""), int(o.get("cap", PAGE_CAP)))


def read_paged(spark: SparkSession, client: str, accounts: list[int], date_from: str = "", cap: int = PAGE_CAP) -> DataFrame:
    """(account_id, page_no, page, error); land the pages and give them to feed.read_pages, or parse `page` at once."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(client=client, accounts=",".join(map(str, accounts)), date_from=date_from, cap=cap).load()
