"""Queries over trees kept as rows (id, parent, kind, name)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matcher:
    """Conditions on a node: its kind, its name, its parent, a child."""

    kind: str | None = None
    name: str | None = None
    inside: "Matcher | None" = None
    has: "Matcher | None" = None


def _matching(nodes: DataFrame, matcher: Matcher) -> DataFrame:
    found = nodes
    if matcher.kind is not None:
        found = found.where(F.col("kind") == matcher.kind)
    if matcher.name is not None:
        found = found.where(F.col("name") == matcher.name)
    if matcher.inside is not None:
        outer = _matching(nodes, matcher.inside).select(F.col("id").alias("parent"))
        found = found.join(outer, "parent", "left_semi")
    if matcher.has is not None:
        inner = _matching(nodes, matcher.has).select(F.col("parent").alias("id"))
        found = found.join(inner, "id", "left_semi")
    return found


def match(nodes: DataFrame, matcher: Matcher, bind: str = "root") -> DataFrame:
    """id, name and binding of the nodes that match."""
    return _matching(nodes, matcher).select("id", "name", F.lit(bind).alias("binding"))


class QueryShell:
    """Named matchers and options of a session: set, let and match."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.named: dict[str, Matcher] = {}
        self.options: dict[str, str] = {"bind-root": "true"}

    def set(self, option: str, value: str) -> None:
        if option not in self.options:
            raise ValueError(f"unknown option {option}")
        self.options[option] = value

    def let(self, name: str, matcher: Matcher) -> None:
        self.named[name] = matcher

    def match(self, matcher: Matcher | str, bind: str | None = None) -> DataFrame:
        found = _matching(self.nodes, self.named[matcher] if isinstance(matcher, str) else matcher)
        names = ([bind] if bind else []) + (["root"] if self.options["bind-root"] == "true" else [])
        return found.select("id", "name", F.explode(F.array(*map(F.lit, names))).alias("binding"))
