"""A report's tables from one plan: steps by name, shared ones computed once, results kept under what they were made of.

A step is a table made of sources and of other steps. A step's digest is of its name, its settings and the digests of what it needs,
so a change reaches what depends on it and nothing else. Kept tables are not built again. Of what has to be built, a source or step
that several need is staged once and read by all of them; one that a single step needs stays part of that step's plan, where Catalyst
prunes it. Staged tables are deleted when the tables are whole, or when building fails.

An unknown, repeated or circular need raises before any job runs. A table may be empty; its columns are kept.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.plans import runs
from sievegrid.session import discard, recording, stage


@dataclass(frozen=True)
class Step:
    """build takes the needed tables in the order of ``needs``; steps with ``table`` are tables of the report."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    table: bool = True
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Made:
    tables: dict[str, DataFrame]
    digests: dict[str, str]
    reused: set[str]
    shared: set[str]


def _ordered(steps: list[Step], sources: dict[str, str], wanted: list[str]) -> list[Step]:
    """The wanted steps and all that they need, needs first."""
    counted = Counter([s.name for s in steps] + list(sources))
    repeated = sorted(n for n, c in counted.items() if c > 1)
    if repeated:
        raise ValueError(f"named twice: {repeated}")
    known = {s.name: s for s in steps}
    unknown = sorted({n for s in steps for n in s.needs if n not in counted} | {n for n in wanted if n not in known})
    if unknown:
        raise ValueError(f"unknown: {unknown}")
    done: dict[str, Step] = {}
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done or name in sources:
            return
        if name in open_:
            raise ValueError(f"{name} needs itself")
        open_.add(name)
        for need in known[name].needs:
            visit(need)
        done[name] = known[name]

    for name in wanted:
        visit(name)
    return list(done.values())


def step_digests(steps: list[Step], sources: dict[str, str]) -> dict[str, str]:
    """Digest by step; steps in an order in which needs come first, sources: their digests."""
    known = dict(sources)
    for s in steps:
        told = json.dumps([s.name, s.settings, [known[n] for n in s.needs]], sort_keys=True, default=str)
        known[s.name] = hashlib.sha256(told.encode()).hexdigest()
    return {s.name: known[s.name] for s in steps}


def build_tables(spark: SparkSession, root: str, steps: list[Step], sources: dict[str, DataFrame], digests: dict[str, str], wanted: list[str] | None = None) -> Made:
    """The report's tables, or those that are ``wanted``, kept below ``root`` under their digests. digests: of the sources."""
    if set(digests) != set(sources):
        raise ValueError(f"sources without digest, or digests without source: {sorted(set(digests) ^ set(sources))}")
    asked = list(dict.fromkeys(wanted if wanted is not None else [s.name for s in steps if s.table]))
    order = _ordered(steps, digests, asked)
    made = step_digests(order, digests)
    tables = {name: found for name in asked if (found := runs.kept(spark, root, name, made[name])) is not None}
    reused = set(tables)
    missing = {name for name in asked if name not in reused}
    for s in reversed(order):  # what the missing tables need; kept ones end a branch
        if s.name in missing:
            missing |= {n for n in s.needs if n not in sources and n not in reused}
    uses = Counter(n for s in order if s.name in missing for n in s.needs)
    shared = {n for n, c in uses.items() if c > 1 and n not in asked}
    read: dict[str, DataFrame] = dict(tables)
    with recording() as paths:
        try:
            for name in sorted(uses):
                if name in sources:
                    read[name] = stage(sources[name], name) if name in shared else sources[name]
            for s in order:
                if s.name not in missing:
                    continue
                df = s.build(*[read[n] for n in s.needs])
                if s.name in asked:
                    tables[s.name] = read[s.name] = runs.publish(df, root, s.name, made[s.name])
                else:
                    read[s.name] = stage(df, s.name) if s.name in shared else df
        finally:
            discard(spark, paths)
    return Made({n: tables[n] for n in asked}, {n: made[n] for n in asked}, reused, shared)


def manifest(spark: SparkSession, made: Made) -> DataFrame:
    """(name, digest, rows, columns) of the report's tables; rows come from the files' footers."""
    rows = [(n, made.digests[n], df.count(), len(df.columns)) for n, df in made.tables.items()]  # a row a table
    return spark.createDataFrame(rows, "name string, digest string, rows long, columns long")


def long_cells(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """(name, entity, measure, value): every measure of a table as rows; keys that are null show as "-"."""
    measures = [c for c in df.columns if c not in keys]
    entity = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-")) for k in keys])
    text = lambda c: F.col(f"`{c}`").cast("double") if dict(df.dtypes)[c] != "boolean" else F.col(f"`{c}`").cast("int").cast("double")
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), text(m).alias("value")) for m in measures])).alias("c")
    return df.select(F.lit(name).alias("name"), entity.alias("entity"), cell).select("name", "entity", "c.measure", "c.value")
