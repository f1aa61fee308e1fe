"""Event taxonomies: type to id, group, domain, gate; as data, applied as literal maps (no join, no shuffle)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventType:
    name: str
    type_id: int
    group: str
    domain: int
    positive: bool = False
    gate: float = 0.0


def _map(pairs: list[tuple[object, object]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


@dataclass(frozen=True)
class Taxonomy:
    types: tuple[EventType, ...]
    unknown_group: str = "Others"

    def _look_up(self, key: Column, field: str, by: str, default: object) -> Column:
        pairs = [(getattr(t, by), getattr(t, field)) for t in self.types]
        return F.coalesce(F.try_element_at(_map(pairs), key), F.lit(default))

    def type_id(self, name: Column) -> Column:
        """0 for unknown types."""
        return self._look_up(name, "type_id", "name", 0)

    def group(self, name: Column) -> Column:
        return self._look_up(name, "group", "name", self.unknown_group)

    def group_of_id(self, type_id: Column) -> Column:
        return self._look_up(type_id, "group", "type_id", self.unknown_group)

    def domain(self, name: Column) -> Column:
        """-1 for unknown types."""
        return self._look_up(name, "domain", "name", -1)

    def gate(self, type_id: Column) -> Column:
        return self._look_up(type_id, "gate", "type_id", 0.0)

    def positive(self, name: Column) -> Column:
        return F.coalesce(name.isin(*self.positives()), F.lit(False))

    def names(self, domain: int | None = None) -> list[str]:
        return [t.name for t in self.types if domain is None or t.domain == domain]

    def positives(self, domain: int | None = None) -> list[str]:
        return [t.name for t in self.types if t.positive and (domain is None or t.domain == domain)]

    def mode(self, name: str) -> list[str]:
        """Types of a data mode: `ads_only` (domain 0) or `all_events`."""
        if name == "ads_only":
            return self.names(0)
        if name == "all_events":
            return self.names()
        raise ValueError(f"unknown mode: {name}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.name, t.type_id, t.group, t.domain, t.positive, t.gate) for t in self.types], "name string, type_id int, grp string, domain int, positive boolean, gate double")


#: The five-domain taxonomy of logged event types.
FIVE_DOMAINS = Taxonomy(
    (
        EventType("NativeClick", 1, "Ad", 0, True),
        EventType("SearchClick", 2, "Ad", 0, True),
        EventType("EdgePageTitle", 3, "Browsing", 1, False, 0.4),
        EventType("EdgeSearchQuery", 4, "Search", 2, False, 1.0),
        EventType("OrganicSearchQuery", 5, "Search", 2, False, 1.0),
        EventType("UET", 6, "Browsing", 1, False, 1.0),
        EventType("OutlookSenderDomain", 7, "Others", 4),
        EventType("UETShoppingCart", 8, "Purchase", 3, False, 1.0),
        EventType("UETShoppingView", 9, "Browsing", 1, False, 1.0),
        EventType("AbandonCart", 10, "Purchase", 3, False, 1.0),
        EventType("EdgeShoppingCart", 11, "Purchase", 3, False, 1.0),
        EventType("EdgeShoppingPurchase", 12, "Purchase", 3, False, 1.0),
        EventType("ChromePageTitle", 13, "Browsing", 1, False, 0.4),
        EventType("MSN", 14, "Browsing", 1, False, 0.1),
    )
)

#: The three-domain taxonomy of the batch pipeline (one type is positive in another domain than its vocabulary's).
THREE_DOMAINS: dict[int, tuple[str, ...]] = {
    0: ("NativeImpression", "NativeClick", "NativeConversion", "SearchImpression", "SearchClick"),
    1: ("ChromePageTitle", "EdgePageTitle", "EdgeSearchQuery", "OrganicSearchQuery", "MSN"),
    2: ("UET", "UETShoppingCart", "UETShoppingView", "AbandonCart", "EdgeShoppingCart", "EdgeShoppingPurchase"),
}
THREE_DOMAIN_POSITIVES: dict[int, tuple[str, ...]] = {
    0: ("NativeClick", "NativeConversion", "SearchClick"),
    1: ("ChromePageTitle", "EdgePageTitle", "EdgeSearchQuery", "OrganicSearchQuery", "MSN", "UET"),
    2: ("UETShoppingCart", "UETShoppingView", "EdgeShoppingCart", "EdgeShoppingPurchase", "AbandonCart"),
}

#: The five types of the `events` stream table.
STREAM = Taxonomy(
    (
        EventType("click", 1, "Ad", 0, True),
        EventType("view", 3, "Browsing", 1, False, 0.4),
        EventType("signup", 4, "Search", 2, False, 1.0),
        EventType("purchase", 8, "Purchase", 3, False, 1.0),
        EventType("error", 7, "Others", 4),
    )
)
