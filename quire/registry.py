"""Named pipelines, and operators registered for SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Spec:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    category: str = "analysis"
    order: int = 100
    enabled: bool = True
    inputs: tuple[str, ...] = field(default=())


class Registry:
    """Pipelines by name; a name is registered once."""

    def __init__(self):
        self._specs: dict[str, Spec] = {}

    def register(self, spec: Spec) -> Spec:
        if spec.name in self._specs:
            raise ValueError(f"{spec.name} is registered")
        self._specs[spec.name] = spec
        return spec

    def unregister(self, name: str) -> bool:
        return self._specs.pop(name, None) is not None

    def get(self, name: str) -> Spec | None:
        return self._specs.get(name)

    def specs(self, category: str | None = None, only_enabled: bool = True) -> list[Spec]:
        return sorted((s for s in self._specs.values() if (s.enabled or not only_enabled) and category in (None, s.category)), key=lambda s: s.order)


def register_functions(spark: SparkSession) -> None:
    """Marker detection as a table function for SQL: detect_markers(text)."""
    from pyspark.sql.functions import udtf

    from .operators.documents import markers_of

    @udtf(returnType="marker string, number int, start int, end int, family string")
    class DetectMarkers:
        def eval(self, text: str):
            yield from markers_of(text or "")

    spark.udtf.register("detect_markers", DetectMarkers)
