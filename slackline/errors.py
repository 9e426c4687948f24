"""Errors at the edge of the library. Inside plans, problems are rows with a code; raise_first() turns them into exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame


class NetworkError(ValueError):
    """A network that cannot be built or analysed."""

    code = "error"

    def __init__(self, network_id: object, element: str | None = None) -> None:
        super().__init__(f"{self.code}: network {network_id}" + (f", {element}" if element else ""))
        self.network_id, self.element = network_id, element


class GraphError(NetworkError):
    """Found when a network is put together."""


class AnalysisError(NetworkError):
    """Found when a network is to be analysed."""


def _kind(base: type, code: str) -> type:
    return type("".join(w.capitalize() for w in code.split("_")) + "Error", (base,), {"code": code})


GRAPH_CODES = ("duplicate_activity", "duplicate_node", "invalid_duration", "self_dependency", "duplicate_dependency", "missing_reference", "empty_graph")
ANALYSIS_CODES = ("negative_duration", "missing_duration", "cycle", "disconnected_components", "isolated_activity", "missing_pert_estimate", "pert_estimate_not_numeric", "pert_estimate_invalid", "pert_ordering")
KINDS: dict[str, type] = {c: _kind(GraphError, c) for c in GRAPH_CODES} | {c: _kind(AnalysisError, c) for c in ANALYSIS_CODES}


def raise_first(issues: DataFrame) -> None:
    """Raises the first issue (network_id, code, element) by network, code and element, if there is any."""
    row = issues.orderBy("network_id", "code", "element").first()
    if row is not None:
        raise KINDS.get(row["code"], NetworkError)(row["network_id"], row["element"])
