"""Every query by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from . import connectivity, cube, detection, dialect, evidence, inference, nulls, reports, signals


def _texts() -> dict[str, str]:
    return {**inference.texts(), **signals.texts(), **connectivity.texts(), **reports.texts(), **detection.texts()}


def _run(sql: str) -> Callable:
    return lambda spark, sf_dir: dialect.run(spark, sf_dir, sql)


def queries() -> dict[str, Callable]:
    return {name: _run(sql) for name, sql in _texts().items()} | signals.frames() | nulls.frames() | connectivity.frames() | evidence.frames() | reports.frames() | detection.frames() | {"cube_label_null_maxt": cube.cube_label_null}


def oracle_sql() -> dict[str, str]:
    return {name: dialect.duckdb_text(sql) for name, sql in _texts().items()} | signals.oracles() | nulls.oracles() | evidence.oracles() | detection.oracles() | reports.oracles() | connectivity.oracles() | {"cube_label_null_maxt": cube.ORACLE}
