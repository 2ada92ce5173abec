"""Metric views (DSL-03): sources, joins, dimensions and measures compiled to one aggregation.

    source: orders
    joins: [{source: customer, on: {c_custkey: o_custkey}}]
    filter: "orders_o_totalprice > 0"
    dimensions: {segment: customer_c_mktsegment}
    measures: {revenue: "sum(orders_o_totalprice)", average: "MEASURE(revenue) / MEASURE(orders)", orders: "count(1)"}
    semi_additive: {balance: {value: ..., order: ..., entity: [...]}}

Columns are named source_column.  A measure may refer to others by MEASURE(name); a ratio is then a
ratio of sums, not a mean of ratios.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidSpec
from ..operators.joins import JoinStep, declared_join

KEYS = {"source", "joins", "filter", "dimensions", "measures", "semi_additive"}


def load(text: str) -> dict:
    import yaml

    spec = yaml.safe_load(text)
    if not isinstance(spec, dict):
        raise InvalidSpec("a metric view is a mapping")
    return spec


def metric_view(spec: Mapping, sources: Mapping[str, DataFrame], dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    if unknown := set(spec) - KEYS:
        raise InvalidSpec(f"unknown keys {sorted(unknown)}")
    for name, given, have in (("dimensions", dimensions, spec.get("dimensions", {})), ("measures", measures, {**spec.get("measures", {}), **spec.get("semi_additive", {})})):
        if missing := [x for x in given if x not in have]:
            raise InvalidSpec(f"no {name} {missing}; there are {sorted(have)}")
    steps = [JoinStep(j["source"], {k: v if "_" in v and v.split("_", 1)[0] in sources else f"{spec['source']}_{v}" for k, v in j["on"].items()}, j.get("how", "left")) for j in spec.get("joins", [])]
    rows = declared_join(sources, spec["source"], steps)
    if spec.get("filter"):
        rows = rows.where(F.expr(spec["filter"]))
    dims = [F.expr(spec["dimensions"][d]).alias(d) for d in dimensions]
    plain = [m for m in measures if m in spec.get("measures", {})]
    out = rows.groupBy(*dims).agg(*(F.expr(_expand(spec["measures"], m, ())).alias(m) for m in plain)) if plain else None
    for m in (m for m in measures if m not in plain):
        own = spec["semi_additive"][m]
        last = rows.groupBy(*dims, *(F.expr(e).alias(f"__e{i}") for i, e in enumerate(own["entity"]))).agg(F.max_by(F.expr(own["value"]), F.expr(own["order"])).alias("__v"))
        value = last.groupBy(*dimensions).agg(F.sum("__v").alias(m))
        if out is None:
            out = value
        elif dimensions:
            right = value.select(*(F.col(d).alias(f"__{d}") for d in dimensions), m)
            out = out.join(right, [out[d].eqNullSafe(right[f"__{d}"]) for d in dimensions], "full").drop(*(f"__{d}" for d in dimensions))
        else:
            out = out.crossJoin(value)
    if out is None:
        raise InvalidSpec("no measures")
    return out.select(*dimensions, *measures)


def _expand(measures: Mapping[str, str], name: str, above: tuple[str, ...]) -> str:
    if name in above:
        raise InvalidSpec(f"measures refer to each other: {' -> '.join((*above, name))}")

    def one(m: re.Match) -> str:
        if m[1] not in measures:
            raise InvalidSpec(f"MEASURE({m[1]}) is not there")
        return f"({_expand(measures, m[1], (*above, name))})"

    return re.sub(r"MEASURE\((\w+)\)", one, measures[name])
