"""Venue specs: a venue is declared as data, not as code.

A ``VenueSpec`` says where a venue's pages live (host, seed), how links to event
pages are selected, and where the event JSON sits in an event page. Registries
are small dimension DataFrames built from specs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class LinkSpec:
    """Elements ``tag`` (optionally with ``attr == value``) whose attribute ``take`` is a link."""

    tag: str = "a"
    attr: str | None = None
    value: str | None = None
    take: str = "href"


@dataclass(frozen=True)
class ScriptSpec:
    """The raw-text element that carries the page's event JSON."""

    tag: str = "script"
    attr: str | None = "id"
    value: str | None = "__NEXT_DATA__"


@dataclass(frozen=True)
class JsonSpec:
    """Where the event stands in a page's JSON: the path of object keys, and the name there of each event field."""

    path: tuple[str, ...] = ("props", "pageProps", "data")
    fields: tuple[tuple[str, str], ...] = (("title", "title"), ("slug", "slug"), ("price", "price"), ("firstDate", "firstDate"), ("lastDate", "lastDate"))


@dataclass(frozen=True)
class VenueSpec:
    name: str
    seed_url: str
    links: LinkSpec | None = None
    script: ScriptSpec | None = None
    currency: str = "DKK"
    data: JsonSpec = JsonSpec()
    # Optional per-venue step on the extracted rows (DataFrame -> DataFrame), e.g. a
    # venue that writes its price in øre; it must return the same columns.
    post: Callable | None = field(default=None, compare=False)

    @property
    def host(self) -> str:
        rest = self.seed_url.split("://", 1)[-1]
        return rest.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].split(":", 1)[0]


# The reference's registered venues. The first has no logic (it yields
# no rows and succeeds); the second selects links by attribute and reads the page's
# embedded JSON from the script with this id.
DEFAULT_VENUES = (
    VenueSpec(name="richter", seed_url="https://richter-gladsaxe.dk"),
    VenueSpec(
        name="vega",
        seed_url="https://vega.dk",
        links=LinkSpec(tag="[^\\s>]+", attr="data-theme", value="secondary"),
        script=ScriptSpec(),
    ),
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("venue", T.StringType(), False),
        T.StructField("base_url", T.StringType(), False),
        T.StructField("host", T.StringType(), False),
        T.StructField("has_links", T.BooleanType(), False),
        T.StructField("has_script", T.BooleanType(), False),
        T.StructField("currency", T.StringType(), False),
    ]
)


def registry_frame(spark: SparkSession, specs=DEFAULT_VENUES) -> DataFrame:
    """Registry dimension; its size is the number of specs, so it is safe to broadcast."""
    rows = [(s.name, s.seed_url, s.host, s.links is not None, s.script is not None, s.currency) for s in specs]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def find_venue(name: str, specs=DEFAULT_VENUES) -> VenueSpec:
    """The spec for one venue; an unknown name is an error, never a silent no-op."""
    for s in specs:
        if s.name == name:
            return s
    known = ", ".join(sorted(s.name for s in specs))
    raise KeyError(f"unknown venue {name!r}; known venues: {known}")
