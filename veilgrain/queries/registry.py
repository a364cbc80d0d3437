"""Registry of named queries with their reference SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from veilgrain.functions.scalar import stable_round
from veilgrain.session import sized_session
from veilgrain.sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sized(fn: QueryFn) -> QueryFn:
    """Run the query in a session sized for the line items it reads."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(sized_session(spark, tables.table(spark, sf, "lineitem").count()), sf)

    return run


def r(c: Column, digits: int = 6) -> Column:
    return stable_round(c, digits)


def R(expr: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`r`."""
    return f"(floor(({expr})*1e{digits}+0.5001)/1e{digits})"


def U(*parts: str) -> str:
    """SQL counterpart of ``keyed_uniform`` for SQL string expressions."""
    key = "||'|'||".join(parts)
    return f"((('0x'||substr(md5({key}),1,12))::BIGINT+0.5)/281474976710656.0)"


def W(word: str, *parts: str) -> str:
    """SQL counterpart of ``word_uniform``: uniform number ``word`` (a SQL integer) of a key."""
    key = "||'|'||".join(parts)
    hashed = f"sha256({key}||'|w'||(({word}) // 8))"
    return f"((('0x'||substr({hashed}, CAST(1 + 8 * (({word}) % 8) AS BIGINT), 8))::BIGINT+0.5)/4294967296.0)"


def GAUSS(*parts: str) -> str:
    return f"(sqrt(-2.0*ln({U(*parts, repr('g1'))}))*cos(6.283185307179586*{U(*parts, repr('g2'))}))"


def LAPLACE(scale: str, *parts: str) -> str:
    u = f"({U(*parts, repr('l1'))}-0.5)"
    return f"(-sign({u})*ln(1.0-2.0*abs({u}))*{scale})"


def GEOM(alpha: str, *parts: str) -> str:
    u1, u2 = U(*parts, repr("d1")), U(*parts, repr("d2"))
    return f"(floor(ln({u1})/ln({alpha}))-floor(ln({u2})/ln({alpha})))"
