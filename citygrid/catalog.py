"""All queries of the library by name, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citygrid.bindings import BINDINGS, frame
from citygrid.operators import OPERATORS, attributes, colours, features, groups, lineage, meshes, outlines, palette, params, places, rings, scenes, sources, spatial, telemetry, terrain, texts, streams  # noqa: F401


def run(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """An operator over the views of ``sf_dir``; inputs that are operators run first, each once."""
    op, made = OPERATORS[name], {} if made is None else made
    for i in op.inputs:
        if i not in made:
            made[i] = run(spark, sf_dir, i, made) if i in OPERATORS else frame(spark, sf_dir, i)
    return op(**{i: made[i] for i in op.inputs})


def sql(name: str) -> str:
    """The oracle of an operator over the given tables, as one statement."""
    parts: dict[str, str] = {}

    def add(n: str) -> None:
        key = f"b_{n}"
        if key in parts or n not in OPERATORS and n not in BINDINGS:
            return
        if n in OPERATORS:
            inputs, text = OPERATORS[n].inputs, OPERATORS[n].oracle
        else:
            given, text = BINDINGS[n]
            inputs, text = given.split(), text if isinstance(text, str) else text[1]
            if not text:  # a view that no oracle reads
                return
        for i in inputs:
            add(i)  # streams are no views of an oracle
        parts[key] = text.format(**{i: f"b_{i}" if i in OPERATORS or i in BINDINGS else i for i in inputs})

    add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in parts.items()) + f"\nSELECT * FROM b_{name}"


def told(name: str) -> bool:
    """Whether SQL says what an operator and all its inputs are."""
    return name not in OPERATORS or bool(OPERATORS[name].oracle) and all(map(told, OPERATORS[name].inputs))


QUERIES = {n: (lambda spark, sf_dir, n=n: run(spark, sf_dir, n)) for n in OPERATORS}
SQL = {n: sql(n) for n in OPERATORS if told(n)}
