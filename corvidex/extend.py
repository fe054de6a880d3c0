"""What users plug in: rerankers, embedders, resolvers, stores and types, each a function of DataFrames or Columns under a
name; and independent jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("reranker", "embedder", "resolver", "vector_store", "graph_store")


@dataclass
class Registry:
    """Plug-ins by kind and name. A reranker takes (candidates, query) and gives key, score; an embedder takes a text Column
    and gives an array Column; a resolver takes (calls, symbols) and gives links; a store is any object with its methods."""

    held: dict[tuple[str, str], Any] = field(default_factory=dict)

    def add(self, kind: str, name: str, plug: Any) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        self.held[kind, name] = plug

    def get(self, kind: str, name: str) -> Any:
        if (kind, name) not in self.held:
            known = sorted(n for k, n in self.held if k == kind)
            raise KeyError(f"no {kind} {name}; there are {', '.join(known) or 'none'}")
        return self.held[kind, name]

    def resolve(self, calls: DataFrame, symbols: DataFrame) -> DataFrame:
        """The links of all resolvers, the first of the same (call, id) by the resolvers' names."""
        out = None
        for (kind, name), plug in sorted(self.held.items(), key=lambda x: x[0]):
            if kind == "resolver":
                links = plug(calls, symbols).select("call", "id").withColumn("by", F.lit(name))
                out = links if out is None else out.unionByName(links)
        if out is None:
            raise KeyError("no resolver")
        return out.groupBy("call", "id").agg(F.min("by").alias("by"))


#: The registry that the package itself uses.
registry = Registry()


@dataclass
class Types:
    """Entity and edge types of users: the fields of each, and between which entities an edge may lie."""

    entities: Mapping[str, Mapping[str, str]]
    edges: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def typed(self, rows: DataFrame, kind: str, properties: str = "properties") -> DataFrame:
        """Rows of a type (``kind`` column) with the JSON of their properties read by the type's fields; unknown types keep none."""
        for name, fields in self.entities.items():
            schema = ", ".join(f"{k} {v}" for k, v in fields.items())
            rows = rows.withColumn(name, F.when(F.col(kind) == name, F.from_json(properties, schema)))
        return rows

    def allowed(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """The edges (src, dst, relation) whose ends have the kinds (id, kind) that their relation asks for."""
        k = lambda end: nodes.select(F.col("id").alias(end), F.col("kind").alias(f"k_{end}"))
        good = F.lit(False)
        for relation, (a, b) in self.edges.items():
            good = good | ((F.col("relation") == relation) & (F.col("k_src") == a) & (F.col("k_dst") == b))
        return edges.join(k("src"), "src").join(k("dst"), "dst").where(good).select(*edges.columns)


def side_by_side(spark: SparkSession, jobs: Mapping[str, Callable[[], Any]], at_once: int = 4) -> dict[str, tuple[str, Any]]:
    """Run independent Spark jobs from a few driver threads: by name ("done", result) or ("failed", message). One that fails
    doesn't stop the others."""

    def guarded(job: Callable[[], Any]) -> tuple[str, Any]:
        try:
            return "done", job()
        except Exception as e:  # told by its name
            return "failed", f"{type(e).__name__}: {e}"[:500]

    with ThreadPoolExecutor(at_once) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(guarded), job) for name, job in jobs.items()}
        return {name: x.result() for name, x in waiting.items()}


def in_order(spark: SparkSession, steps: list[Mapping[str, Callable[[], Any]]]) -> dict[str, tuple[str, Any]]:
    """Groups of jobs, one group after the other; jobs of a group side by side."""
    out: dict[str, tuple[str, Any]] = {}
    for group in steps:
        out |= side_by_side(spark, group)
    return out
