"""A live connector as a Spark data source: paged listings to read, streams of changes, and puts with commit.

The user supplies a pager, which lists one root after another by pages with a
cursor, and a store, which stages and publishes objects. Spark does the rest: a
root is a partition, or several if the pager names cursors to cut it at, filters
on the root reach the pager, a stream remembers the cursor of each root in its
checkpoint, and a write publishes the objects of all tasks or of none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

ROOT = "root"


class Pager(Protocol):
    """Lists the entries of a store; made anew in every task."""

    def roots(self) -> Sequence[str]: ...

    def page(self, root: str, cursor: str | None) -> tuple[Sequence[tuple], str, bool]:
        """Rows after ``cursor`` (from the start if None), the cursor behind them, and whether more follow at once."""

    def latest(self, root: str) -> str:
        """The cursor behind all entries there are now."""

    # Optional: ``cuts(root) -> Sequence[str]``, cursors in order at which a root is cut into parts that are listed
    # side by side. Paging from the start must come to each of them exactly.


class Store(Protocol):
    """Takes objects; made anew in every task and once for the commit."""

    def stage(self, batch: str, row) -> str:
        """Keep a row's object aside and return its name there."""

    def publish(self, batch: str, names: Sequence[str]) -> None: ...

    def discard(self, batch: str, names: Sequence[str]) -> None: ...


@dataclass
class RootPart(InputPartition):
    """All entries of a root, or those from one cursor to another."""

    root: str
    start: str | None = None
    end: str | None = None


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


def _pages(pager: Pager, part: RootPart) -> Iterator[tuple]:
    """Rows of a part with their root in front; ``end`` is the cursor behind its last page."""
    cursor, more = part.start, part.start is None or part.start != part.end
    while more:
        rows, cursor, more = pager.page(part.root, cursor)
        for row in rows:
            yield (part.root, *row)
        more = more and cursor != part.end


class _Reader(DataSourceReader):
    def __init__(self, make_pager: Callable[[], Pager]):
        self._make_pager, self._wanted = make_pager, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo((name,), value) if name == ROOT:
                    self._only({value})
                case In((name,), values) if name == ROOT:
                    self._only(set(values))
                case _:
                    yield f

    def _only(self, roots: set) -> None:
        self._wanted = roots if self._wanted is None else self._wanted & roots

    def partitions(self) -> list[RootPart]:
        pager, parts = self._make_pager(), []
        cuts_of = getattr(pager, "cuts", lambda root: ())
        for root in pager.roots():
            if self._wanted is None or root in self._wanted:
                cuts = [None, *cuts_of(root), None]
                parts += [RootPart(root, start, end) for start, end in zip(cuts, cuts[1:])]
        return parts

    def read(self, partition: RootPart) -> Iterator[tuple]:
        yield from _pages(self._make_pager(), partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the cursors of all roots; a root that appears later begins at its start."""

    def __init__(self, make_pager: Callable[[], Pager]):
        self._make_pager = make_pager

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        pager = self._make_pager()
        return {root: pager.latest(root) for root in pager.roots()}

    def partitions(self, start: dict, end: dict) -> list[RootPart]:
        return [RootPart(root, start.get(root), cursor) for root, cursor in end.items() if start.get(root) != cursor]

    def read(self, partition: RootPart) -> Iterator[tuple]:
        yield from _pages(self._make_pager(), partition)


class _Writer(DataSourceWriter):
    """Every task stages its rows; the driver publishes the names of all tasks, or discards them."""

    def __init__(self, make_store: Callable[[], Store]):
        self._make_store, self._batch = make_store, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        store, names = self._make_store(), []
        for row in iterator:
            names.append(store.stage(self._batch, row))
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        store = self._make_store()
        for message in messages:
            if message is not None:
                store.publish(self._batch, message.names)

    def abort(self, messages: list[Staged | None]) -> None:
        store = self._make_store()
        for message in messages:
            if message is not None:
                store.discard(self._batch, message.names)


def register_connector(
    spark: SparkSession,
    name: str,
    schema: str,
    make_pager: Callable[[], Pager] | None = None,
    make_store: Callable[[], Store] | None = None,
) -> None:
    """Make ``spark.read.format(name)``, ``readStream`` and ``write`` use a pager and a store.

    Rows have ``root string`` and the columns of ``schema``, in the pager's order. Filters on ``root`` leave out
    whole partitions; the rest stays with Spark. What is staged has names only in the driver, not contents.
    """
    columns, title = f"{ROOT} string, {schema}", name

    class Connector(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> _Reader:
            return _Reader(make_pager)

        def streamReader(self, schema) -> _StreamReader:
            return _StreamReader(make_pager)

        def writer(self, schema, overwrite: bool) -> _Writer:
            return _Writer(make_store)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Connector)
