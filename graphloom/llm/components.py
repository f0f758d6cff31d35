"""Connected components of links between nodes, without gathering them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.operators.components import link_components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component's name is its smallest node."""
    return link_components(links, a, b)[0]
