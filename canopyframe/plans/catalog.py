"""Registry that ties each query to its DuckDB oracle.

``columns`` lists the output as ``name[:code]``: a number rounds to that many
digits, ``i`` is a 64-bit integer, ``s`` a string, ``b`` a boolean, ``d`` a date
and ``t`` a timestamp. The same select list is put around both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from canopyframe.plans.carriers import carrier, with_carriers

Source = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Callable[[Source], DataFrame]
    columns: str
    oracle: str | None
    carriers: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(key: str, columns: str, oracle: str | None = None, carriers: str = ""):
    """Decorator: the function gets ``src(carrier_name)`` and returns a DataFrame."""
    def wrap(build):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(build, columns, oracle, tuple(carriers.split()))
        return build
    return wrap


def select_list(columns: str) -> list[str]:
    """SQL select expressions valid in Spark and DuckDB."""
    out = []
    for item in columns.split():
        name, _, code = item.partition(":")
        if code.isdigit():
            out.append(f"round(cast({name} as double), {code}) + 0.0e0 as {name}")
        else:
            kind = {"": None, "i": "bigint", "s": "varchar(1000000)", "b": "boolean", "d": "date",
                    "t": "timestamp"}[code]
            out.append(name if kind is None else f"cast({name} as {kind}) as {name}")
    return out


def spark_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTRY[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = entry.build(lambda name: carrier(spark, sf_dir, name))
        return df.selectExpr(*[e.replace("varchar(1000000)", "string") for e in select_list(entry.columns)])
    return run


def oracle_query(key: str) -> str | None:
    entry = REGISTRY[key]
    if entry.oracle is None:
        return None
    inner = with_carriers(entry.oracle, *entry.carriers) if entry.carriers else entry.oracle
    names = ", ".join(e.replace("varchar(1000000)", "varchar") for e in select_list(entry.columns))
    return f"select {names} from ({inner}) as result"
