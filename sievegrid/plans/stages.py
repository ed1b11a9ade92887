"""A small stage graph: each stage is reused while the fingerprint of all that made it is unchanged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sievegrid.sources.readers import fingerprint, read_document, write_document


@dataclass
class Stage:
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    checks: Callable[[DataFrame], dict[str, bool]] | None = None


def run_stages(spark: SparkSession, root: str, stages: list[Stage], sources: dict[str, str]) -> dict[str, str]:
    """(stage: built or reused). Provenance is written last, so a stage that broke off is built again; a failed check stops the run.

    sources: fingerprints of inputs outside the graph; they are part of every stage's.
    """
    prints: dict[str, str] = {}
    tables: dict[str, DataFrame] = {}
    done: dict[str, str] = {}
    for stage in stages:
        missing = [n for n in stage.needs if n not in tables]
        if missing:
            raise ValueError(f"{stage.name} needs {missing} first")
        prints[stage.name] = fingerprint({"stage": stage.name, "settings": stage.settings, "sources": sources, "needs": {n: prints[n] for n in stage.needs}})
        path = f"{root}/{stage.name}"
        kept = read_document(spark, f"{path}/provenance")
        if kept == {"fingerprint": prints[stage.name]}:
            done[stage.name] = "reused"
        else:
            stage.build(tables).write.mode("overwrite").parquet(f"{path}/table")
            failed = [k for k, ok in (stage.checks(spark.read.parquet(f"{path}/table")) if stage.checks else {}).items() if not ok]
            if failed:
                raise ValueError(f"{stage.name} failed {failed}")
            write_document(spark, f"{path}/provenance", {"fingerprint": prints[stage.name]})
            done[stage.name] = "built"
        tables[stage.name] = spark.read.parquet(f"{path}/table")
    return done
