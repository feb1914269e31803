"""Official gazettes as a Spark source: spark.read or spark.readStream.format("radar_gazettes").

Options: base (address of the service), config (JSON: queryGroups or queryTerms, pageSize and so on), since (yyyy-MM-dd, for reads without a filter and as
the start of a stream), overlap (days, for streams). One partition a term group. A failed request fails its task, which Spark repeats;
with failures=skip the group gives no rows. Entries without a readable date have no published_at and pass only a read without bounds.

A read takes bounds on published_at: a gazette counts from noon of its day, so `published_at >= x` is exactly a first day, which goes into the request and leaves
nothing for Spark to filter. Other filters stay with Spark.

A stream's offset says for every group the newest day and how many entries its window had, so entries that a day gets later start a batch of their own. A batch
holds the entries of the days from `overlap` before its start to its end: it repeats some, which the keyed state or the history behind it drop, and loses
none that come at most `overlap` days late. A batch that is repeated after a crash asks for the same days.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .gazettes import request, request_groups
from .http import fetched

ENTRY = "query_ord int, item_ord bigint, url string, territory_id string, territory_name string, state_code string, date string, edition string, excerpts array<string>, published_at timestamp"
#: Noon three hours behind UTC.
NOON = timedelta(hours=15)
FIRST_DAY = date(1970, 1, 1)


def _instant(day: str | None) -> datetime | None:
    try:
        return datetime.combine(date.fromisoformat(day), datetime.min.time(), timezone.utc) + NOON
    except (TypeError, ValueError):
        return None


def first_day(at: datetime, itself: bool) -> date:
    """The first day whose gazettes are published at `at` or later (`itself`), or later only."""
    at = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc) - NOON
    day = at.date()
    whole = at == datetime.combine(day, datetime.min.time(), timezone.utc)
    return day if whole and itself else day + timedelta(days=1)


class Group(InputPartition):
    def __init__(self, ord: int, terms: list[str], since: date | None, until: date | None = None):
        self.ord, self.terms, self.since, self.until = ord, terms, since, until


class _Service:
    """Requests of the groups of a configuration."""

    def __init__(self, options: dict):
        self.base, self.config, self.skip = options["base"], json.loads(options.get("config", "{}")), options.get("failures") == "skip"
        self.since = date.fromisoformat(options["since"]) if options.get("since") else None
        self.overlap = int(options.get("overlap", 2))
        self.groups = request_groups(self.config)

    def entries(self, group: Group) -> Iterator[tuple]:
        """Entries of the days of a group; whatever the service gives beyond them is left out."""
        asked = request(self.base, group.terms, datetime.combine(group.since or FIRST_DAY, datetime.min.time()), self.config)
        try:
            status, _, body = fetched(asked["url"], asked["timeout"], asked["retries"])
            if not 200 <= status < 300:
                raise OSError(f"the service answered {status}")
            found = json.loads(body).get("gazettes") or []
        except (OSError, ValueError):
            if self.skip:
                return
            raise
        for i, g in enumerate(found):
            at = _instant(g.get("date"))
            if (group.since is None and group.until is None) or (at and (group.since or FIRST_DAY) <= at.date() <= (group.until or date.max)):
                yield (group.ord, i, *(g.get(k) for k in ("url", "territory_id", "territory_name", "state_code", "date", "edition")), g.get("excerpts") or [], at)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = _Service(options)
        self.since = self.service.since

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("published_at",) and isinstance(f.value, datetime):
                self.since = max(self.since or FIRST_DAY, first_day(f.value, isinstance(f, GreaterThanOrEqual)))
            else:
                yield f

    def partitions(self) -> list[Group]:
        return [Group(i, terms, self.since) for i, terms in enumerate(self.service.groups)]

    def read(self, partition: Group) -> Iterator[tuple]:
        return self.service.entries(partition)


class _Stream(DataSourceStreamReader):
    """Offsets: {group: [newest day, entries of its window]}; the driver asks each group once a trigger for them."""

    def __init__(self, options: dict):
        self.service = _Service(options)

    def initialOffset(self) -> dict:
        day = (self.service.since or FIRST_DAY) - timedelta(days=1)
        return {str(i): [day.isoformat(), 0] for i in range(len(self.service.groups))}

    def _window(self, day: str) -> date:
        return max(self.service.since or FIRST_DAY, date.fromisoformat(day) - timedelta(days=self.service.overlap))

    def latestOffset(self) -> dict:
        out = {}
        for i, terms in enumerate(self.service.groups):
            days = [e[6] for e in self.service.entries(Group(i, terms, self.service.since or FIRST_DAY)) if e[9]]
            newest = max(days, default=self.initialOffset()[str(i)][0])
            out[str(i)] = [newest, sum(d >= self._window(newest).isoformat() for d in days)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return [Group(int(i), self.service.groups[int(i)], self._window(start[i][0]), date.fromisoformat(end[i][0])) for i in sorted(end) if end[i] != start[i]]

    def read(self, partition: Group) -> Iterator[tuple]:
        return self.service.entries(partition)

    def commit(self, end: dict) -> None:
        pass


class GazetteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "radar_gazettes"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def _options(base: str, config: dict, more: dict) -> dict:
    return {"base": base, "config": json.dumps(config)} | {k: str(v) for k, v in more.items()}


def gazettes(spark: SparkSession, base: str, config: dict, **more) -> DataFrame:
    """Entries (ENTRY) of all groups; a lower bound on published_at goes into the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GazetteSource)
    return spark.read.format("radar_gazettes").options(**_options(base, config, more)).load()


def gazette_stream(spark: SparkSession, base: str, config: dict, **more) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(GazetteSource)
    return spark.readStream.format("radar_gazettes").options(**_options(base, config, more)).load()
