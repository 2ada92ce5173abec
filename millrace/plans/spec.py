"""Declarative pipelines (DSL-01): a mapping of nodes, checked as a whole before anything runs.

    tokens: {catalog: /data}
    templates: {clean: {transform: {rules: {...}}}}
    nodes:
      - name: orders
        sources: [{table: raw_orders}]          # tables given to run(), or earlier nodes
        select: {order_id: "upper(o_id)"}
        filter: "order_id is not null"
        rules: {positive: "amount > 0"}
        quarantine: drop                        # drop | flag | table
        expectations: [{name: known, rule: "...", action: fail}]
        cdc: {keys: [order_id], sequence_by: updated_at, scd: 1}
        template: clean

Several sources of a node are joined in order; the first is the preserved side.  Unknown keys,
unknown tokens, missing sources and cycles raise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidSpec
from ..operators import history, quality
from ..operators.joins import JoinStep, declared_join

TOP = {"tokens", "templates", "nodes"}
NODE = {"name", "sources", "select", "filter", "rules", "quarantine", "expectations", "cdc", "template"}
SOURCE = {"table", "as", "on", "how"}
CDC = {"keys", "sequence_by", "apply_as_deletes", "except_column_list", "ignore_null_updates", "track_history_columns", "scd"}
EXPECTATION = {"name", "rule", "action"}


def _only(given: Mapping, allowed: set[str], where: str) -> None:
    if not isinstance(given, Mapping):
        raise InvalidSpec(f"{where} must be a mapping")
    if unknown := set(given) - allowed:
        raise InvalidSpec(f"unknown keys {sorted(unknown)} in {where}")


def substitute(value, tokens: Mapping[str, str]):
    """Puts tokens in for ``${name}`` everywhere; an unknown one raises."""
    if isinstance(value, str):
        def one(m: re.Match) -> str:
            if m[1] not in tokens:
                raise InvalidSpec(f"unknown token {m[1]}")
            return str(tokens[m[1]])

        return re.sub(r"\$\{(\w+)\}", one, value)
    if isinstance(value, Mapping):
        return {k: substitute(v, tokens) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, tokens) for v in value]
    return value


def validate(spec: Mapping, tables: set[str]) -> list[dict]:
    """The nodes in an order in which they can run."""
    _only(spec, TOP, "the specification")
    templates = spec.get("templates", {})
    nodes = {}
    for raw in spec.get("nodes", []):
        _only(raw, NODE, f"node {raw.get('name') if isinstance(raw, Mapping) else raw}")
        if "template" in raw and raw["template"] not in templates:
            raise InvalidSpec(f"unknown template {raw['template']}")
        node = substitute({**templates.get(raw.get("template"), {}), **raw}, spec.get("tokens", {}))
        _only(node, NODE, f"node {node.get('name')}")
        name = node.get("name")
        if not name or name in nodes or name in tables:
            raise InvalidSpec(f"node name {name!r} is missing or taken")
        if not node.get("sources"):
            raise InvalidSpec(f"node {name} has no sources")
        for k, s in enumerate(node["sources"]):
            _only(s, SOURCE, f"a source of {name}")
            if "table" not in s or k and not s.get("on"):
                raise InvalidSpec(f"a source of {name} needs a table, and a join's sources need on")
        for e in node.get("expectations", []):
            _only(e, EXPECTATION, f"an expectation of {name}")
        if "cdc" in node:
            _only(node["cdc"], CDC, f"cdc of {name}")
            if not {"keys", "sequence_by"} <= set(node["cdc"]):
                raise InvalidSpec(f"cdc of {name} needs keys and sequence_by")
        if node.get("quarantine", "drop") not in ("drop", "flag", "table"):
            raise InvalidSpec(f"quarantine of {name}: {node['quarantine']!r}")
        nodes[name] = node
    if not nodes:
        raise InvalidSpec("no nodes")
    order: list[dict] = []
    done, doing = set(tables), []

    def visit(name: str) -> None:
        if name in done:
            return
        if name not in nodes:
            raise InvalidSpec(f"no table or node {name}")
        if name in doing:
            raise InvalidSpec(f"nodes depend on each other: {' -> '.join([*doing, name])}")
        doing.append(name)
        for s in nodes[name]["sources"]:
            visit(s["table"])
        doing.pop()
        done.add(name)
        order.append(nodes[name])

    for name in nodes:
        visit(name)
    return order


def run(spec: Mapping, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All nodes as lazy frames; a node with quarantine "table" also gives ``<name>__quarantine``."""
    out = dict(tables)
    for node in validate(spec, set(tables)):
        name, first, *more = node["name"], *node["sources"]
        if more:
            alias = lambda s: s.get("as", s["table"])
            df = declared_join({alias(s): out[s["table"]] for s in node["sources"]}, alias(first), [JoinStep(alias(s), s["on"], s.get("how", "left")) for s in more])
        else:
            df = out[first["table"]]
        df = df.select(*(F.expr(e).alias(c) for c, e in node["select"].items())) if node.get("select") else df
        df = df.where(F.expr(node["filter"])) if node.get("filter") else df
        if node.get("rules"):
            quality.require_unambiguous(df, {k: f"coalesce({v}, false)" for k, v in node["rules"].items()})
            checked = quality.with_failures(df, node["rules"])
            if node.get("quarantine", "drop") == "flag":
                df = checked.withColumn("is_quarantined", F.size("dq_failures") > 0).drop("dq_failures")
            else:
                df, bad = quality.split_valid(df, node["rules"])
                if node.get("quarantine") == "table":
                    out[f"{name}__quarantine"] = bad
        if node.get("expectations"):
            df, _ = quality.expect(df, [quality.Expectation(**e) for e in node["expectations"]])
        if node.get("cdc"):
            c = node["cdc"]
            df = history.apply_cdc(None, df, c["keys"], c["sequence_by"], deletes=c.get("apply_as_deletes"), exclude=c.get("except_column_list", ()), ignore_null_updates=c.get("ignore_null_updates", False), track=c.get("track_history_columns"), scd=c.get("scd", 1))
        out[name] = df
    return {k: v for k, v in out.items() if k not in tables}
