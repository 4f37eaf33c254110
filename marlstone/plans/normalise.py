"""One spelling for plans."""

from __future__ import annotations

import json
import re

#: What a metric's source may be called.
SOURCES = {
    "equity_daily_basic": "equity_daily_basic", "daily_basic": "equity_daily_basic",
    "price_panel": "price_panel", "price": "price_panel", "prices": "price_panel", "price_history": "price_panel",
    "price_history_panel": "price_panel", "ohlcv": "price_panel", "ohlcv_panel": "price_panel",
    "return_panel": "return_panel", "return": "return_panel", "returns": "return_panel", "pct_return": "return_panel", "price_return": "return_panel",
    "volume_panel": "volume_panel", "volume": "volume_panel", "volumes": "volume_panel",
}
#: Keys that a metric takes over from its plan.
INHERITED = ("start_date", "end_date", "date", "trade_date", "fields", "market", "adjust", "shape", "mode", "align")
CONDITION = re.compile(r"^\s*(\w+)\s*(>=|<=|!=|==|=|>|<|contains|like)\s*(.+?)\s*$")


def first(spec: dict, *names: str, default=None):
    return next((spec[n] for n in names if spec.get(n) not in (None, "")), default)


def as_list(value) -> list:
    if value in (None, ""):
        return []
    if isinstance(value, str):
        return [x.strip() for x in value.split(",") if x.strip()]
    return list(value) if isinstance(value, list | tuple) else [value]


#: Keys under which an operation's name may stand.
NAMES = ("op", "type", "operation", "action")


def normalise(plan: dict | str) -> dict:
    """A plan with universe {type, symbols}, metrics, operations, limit, top_k and max_entities."""
    plan = json.loads(plan) if isinstance(plan, str) else dict(plan)
    inner = plan.get("plan", plan)
    plan = json.loads(inner) if isinstance(inner, str) else dict(inner)
    output = plan.get("output") or {}
    output = {"fields": output} if isinstance(output, list) else output
    for key, names in (("shape", ("shape", "mode")), ("fields", ("fields", "columns"))):
        if plan.get(key) is None and (value := first(output, *names)) is not None:
            plan[key] = value
    if plan.get("fields") is None and plan.get("output_fields") is not None:
        plan["fields"] = plan["output_fields"]
    universe = plan.get("universe", plan.get("symbols"))
    universe = {"type": "symbols", "symbols": universe} if isinstance(universe, str | list) else dict(universe or {})
    kind = str(universe.get("type") or "symbols").lower()
    universe["type"] = "symbols" if kind in ("symbols", "symbol_list", "tickers") else kind
    universe["symbols"] = [str(s).upper() for s in as_list(first(universe, "symbols", "tickers"))]
    metrics = first(plan, "metrics", "metric", default=[])
    if isinstance(metrics, dict) and not any(k in metrics for k in ("source", "name", "metric")):
        metrics = [{"source": k} | (v if isinstance(v, dict) else {}) for k, v in metrics.items()]
    metrics = [n for m in ([metrics] if isinstance(metrics, dict | str) else metrics) for n in named_metrics(m)]
    given = first(plan, "operations", "ops", default=[])
    if isinstance(given, dict):
        given = [given] if any(k in given for k in NAMES) else [{k: v} for k, v in given.items()]
    operations = [n for op in ([given] if isinstance(given, str) else given) for n in operation(op)]
    for sort in as_list(first(output, "sort", "order_by")):
        operations += operation({"sort": sort})
    if not operations and (by := first(plan, "rank_by", "order_by")):
        operations = [{"op": "rank", "field": by, "descending": first(plan, "order", default="desc") != "asc"}]
    return {
        "universe": universe,
        "metrics": [metric(m, plan) for m in metrics],
        "operations": operations,
        "limit": plan.get("limit"),
        "top_k": int(plan.get("top_k") or 10),
        "max_entities": int(plan.get("max_entities") or 120),
    }


def named_metrics(spec: dict | str) -> list[dict | str]:
    """A metric as it is; one that names no source but has sources as keys as one for each of them."""
    if not isinstance(spec, dict) or first(spec, "source", "name", "metric", "action", "type") is not None:
        return [spec]
    keyed = [{"source": k} | (v if isinstance(v, dict) else {}) for k, v in spec.items() if str(k).lower() in SOURCES or str(k).lower() in SOURCES.values()]
    return keyed or [spec]


def metric(spec: dict | str, plan: dict) -> dict:
    spec = {"source": spec} if isinstance(spec, str) else dict(spec)
    spec = {k: plan[k] for k in INHERITED if plan.get(k) is not None} | spec
    day = first(spec, "date", "trade_date")
    source = str(first(spec, "source", "name", "metric", "action", "type", default="")).lower()
    return {
        "source": SOURCES.get(source, source),
        "start": first(spec, "start_date", "start", "from", default=day),
        "end": first(spec, "end_date", "end", "to", default=day),
        "align": str(first(spec, "align", "date_align", default="previous")).lower(),
        "shape": first(spec, "shape", "mode"),
        "fields": as_list(spec.get("fields")),
    }


def operation(op: dict | str) -> list[dict]:
    """One operation in its usual spelling, from any of the others; a map of filters gives several."""
    if isinstance(op, str):
        found = CONDITION.match(op)
        if not found:
            raise ValueError(f"no operation: {op}")
        return [{"op": "filter", "field": found[1], "operator": found[2], "value": found[3].strip("'\"")}]
    name = str(first(op, *NAMES, default="")).strip().lower()
    if not name:
        name = next((k for k in ("filter", "sort", "order_by", "max_by", "min_by", "rank", "count", "list", "select_fields", "aggregate", "compute") if k in op), "")
        if not name:
            raise ValueError(f"no operation: {op}")
        value = op.get(name)
        if name == "filter" and isinstance(value, str):
            return operation(value)
        if name == "filter" and isinstance(value, list):
            return [n for v in value for n in operation(v if isinstance(v, str) else {"filter": v})]
        if name == "filter" and isinstance(value, dict) and isinstance(value.get("condition"), str) and len(value) == 1:
            return operation(value["condition"])
        if name == "filter" and isinstance(value, dict) and "field" not in value:
            tests = [(f, t if isinstance(t, dict) else {"eq": t}) for f, t in value.items()]
            return [{"op": "filter", "field": f, "operator": o, "value": v} for f, t in tests for o, v in t.items()]
        if name == "compute" and not isinstance(value, dict):
            raise ValueError(f"compute needs names and their expressions: {value}")
        if name == "compute":
            calls = {f: re.match(r"pct_change\((\w+)\)$", str(e).replace(" ", "")) for f, e in value.items()}
            return [{"op": "pct_change", "column": m[1], "output": f, "as_ratio": True} if m else {"op": "add_column", "column": f, "expression": value[f]} for f, m in calls.items()]
        if name in ("sort", "order_by"):
            items = value.items() if isinstance(value, dict) and "field" not in value else [(value, None)]
            return [n for v, o in items for n in operation({"op": "sort", **(v if isinstance(v, dict) else {"field": v}), **({"order": o} if o else {})})]
        op = {"op": name, **(value if isinstance(value, dict) else {"fields" if name in ("list", "select_fields") else "field": value})}
        return operation(op)
    field = first(op, "field", "by", "column")
    if name == "filter" and not field and CONDITION.match(str(op.get("condition") or "")):
        return operation(op["condition"])
    if name == "filter":
        test = str(first(op, "operator", "comparison", "comparator", "condition", default="eq")).lower()
        return [{"op": "filter", "field": field, "operator": test, "value": first(op, "value", "threshold", "target", "equals")}] if field else []
    if name in ("sort", "rank"):
        order = first(op, "order", "direction")
        if name == "sort" and isinstance(field, str) and (suffix := re.match(r"(.+)_(asc|desc)$", field)):
            field, order = suffix[1], order or suffix[2]
        down = str(order).lower() == "desc" if order else (op.get("ascending") is False if name == "sort" else True)
        return [{"op": name, "field": field, "descending": down, "top": op.get("top_k")}]
    if name in ("max_by", "min_by"):
        return [{"op": name, "field": field, "top": op.get("top_k")}]
    if name in ("pct_change", "return", "returns"):
        if op.get("column"):
            return [{"op": "pct_change", "column": op["column"], "output": first(op, "as", "output_field", default=f"pct_change_{op['column']}"), "as_ratio": bool(op.get("as_ratio"))}]
        return [
            {
                "op": "pct_change", "start": first(op, "start_field", "from_field", default="start_close"),
                "end": first(op, "end_field", "to_field", default="end_close"), "output": first(op, "as", "output_field", default="return_pct"),
            }
        ]
    if name in ("aggregate", "count"):
        return [{"op": "aggregate", "function": str(first(op, "function", "func", default="count")).lower(), "field": first(op, "field")}]
    if name in ("list", "select_fields"):
        return [{"op": name, "fields": as_list(first(op, "fields", "columns")), "top": first(op, "limit", "top_k")}]
    if name == "add_column":
        return [{"op": name, "column": first(op, "column", "as", "output_field"), "expression": op.get("expression")}]
    raise ValueError(f"unknown operation: {name}")
