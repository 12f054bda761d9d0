"""A graph whose vertices carry vectors, and the questions that can be asked of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .functions.vectors import UNITS
from .operators import cliques, graph, similarity
from .session import materialise, within_time
from .sources import text, vectors


class VectorGraph:
    """vertices(id), raw edges(u, v) and vectors(id, vec).

    Edges are made canonical; ``unit`` says that vectors have unit length. Similarities are computed once and kept as a
    checkpoint, for all thresholds.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, vectors: DataFrame, unit: bool = False):
        self.vertices, self.raw, self.vectors, self.unit = vertices, edges, vectors, unit
        self.edges = graph.canonical(edges)

    @classmethod
    def load(cls, spark: SparkSession, graph_path: str, vector_path: str, mode: str = "PERMISSIVE") -> VectorGraph:
        v, e = text.read_graph(spark, graph_path, mode)
        return cls(v, e, vectors.read_vectors(spark, vector_path, v.count()))

    @cached_property
    def sim_edges(self) -> DataFrame:
        return materialise(similarity.sim_edges(self.edges, self.vectors, self.unit))

    def audit(self) -> DataFrame:
        return graph.audit(self.raw, self.vertices)

    def tau(self, percentile: int) -> float:
        """The edge similarity at a percentile, by floor rank."""
        return similarity.tau_value(self.sim_edges, percentile) / UNITS

    def order(self) -> DataFrame:
        """Core numbers, and an order with few neighbours ahead of each vertex."""
        return graph.degeneracy_order(self.edges)

    def structural(self) -> DataFrame:
        return cliques.structural(self.sim_edges, self.vertices)

    def pairsim(self, tau: float) -> DataFrame:
        return cliques.pairsim_cliques(self.sim_edges, self.vertices, round(tau * UNITS))

    def msc(self, tau: float, algorithm: str = "auto", seconds: float | None = None, **options) -> DataFrame:
        """The maximal sets; with ``seconds`` they are whole within that time, or OutOfTime is raised."""
        find = lambda: cliques.msc(self.sim_edges, round(tau * UNITS), algorithm, **options)
        return find() if seconds is None else within_time(self.sim_edges.sparkSession, seconds, find)

    def counted(self, tau: float, algorithm: str = "canonical") -> tuple[DataFrame, dict[str, int]]:
        """The maximal sets and what the search for them counted."""
        return cliques.counted(self.sim_edges, round(tau * UNITS), algorithm)
