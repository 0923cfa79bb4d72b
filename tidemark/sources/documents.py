"""Small documents: run metadata, SLA profiles and rules, consumer profiles, settings.

They are read and validated on the driver, as they configure queries, and become frames where a query
joins them. YAML needs a parser; where none is installed, only JSON is read.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.columns import TOPIC_IDS
from tidemark.schemas import CRITERION, LATENCY_RULE

OPERATORS = ("eq", "lte", "lt", "gte", "gt")
#: Measurements that a criterion may name. Fixed values.
MEASUREMENTS = ("latency_p95_ms", "latency_p99_ms", "freshness_gap_p95_ms", "throughput_average_rps", "cpu_average_cores")


def load_document(path: str | Path) -> dict[str, Any]:
    """A JSON or YAML file that holds an object."""
    path = Path(path)
    if not path.is_file():
        raise ValueError(f"no such file: {path}")
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"no YAML parser is installed for {path}") from None
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"not an object: {path}")
    return found


def nested(document: Any, path: list[str]) -> Any:
    """The value at a path of keys; None where a step is missing."""
    for key in path:
        if not isinstance(document, dict) or key not in document:
            return None
        document = document[key]
    return document


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; objects are merged key by key, `extends` is left out."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        if key == "extends":
            continue
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def inherited(documents: Mapping[str, Mapping[str, Any]], name: str, join: Mapping[str, str] | None = None) -> dict[str, Any]:
    """A document with what it `extends`, parents first. A cycle or an unknown name is an error."""
    chain: list[str] = []
    at: Any = name
    while at:
        if at in chain:
            raise ValueError(f"documents extend each other: {' -> '.join([*chain, at])}")
        if at not in documents:
            raise ValueError(f"unknown document {at!r}; there are {', '.join(sorted(documents))}")
        chain.append(at)
        at = documents[at].get("extends")
    out: dict[str, Any] = {}
    for step in reversed(chain):
        out = merged(out, documents[step])
    return out


def sla_profile(documents: Mapping[str, Mapping[str, Any]], name: str) -> dict[str, Any]:
    """An SLA profile with its parents': criteria and latency rules are appended, other values replaced."""
    out = inherited(documents, name)
    chain, at = [], name
    while at:
        chain.insert(0, documents[at])
        at = documents[at].get("extends")
    out["criteria"] = [c for d in chain for c in d.get("criteria") or []]
    rules = [r for d in chain for r in (d.get("latency") or {}).get("rules") or []]
    if any(d.get("latency") for d in chain):
        out["latency"] = {**(out.get("latency") or {}), "rules": rules}
    check_profile(out)
    return out


def check_profile(profile: Mapping[str, Any]) -> None:
    criteria, latency = profile.get("criteria"), profile.get("latency")
    if not isinstance(criteria, list):
        raise ValueError("criteria must be a list")
    if not criteria and not latency:
        raise ValueError("a profile has criteria or latency rules")
    seen: set[str] = set()
    for c in criteria:
        ident = str(c.get("id") or "") if isinstance(c, dict) else ""
        if not ident or ident in seen:
            raise ValueError(f"criteria need ids of their own: {c!r}")
        seen.add(ident)
        source = c.get("source") or "audit"
        if source == "audit":
            if not isinstance(c.get("path"), list) or not c["path"]:
                raise ValueError(f"criterion {ident!r} needs a path")
        elif source == "measurement":
            if c.get("measurement") not in MEASUREMENTS:
                raise ValueError(f"criterion {ident!r} names no measurement")
        else:
            raise ValueError(f"criterion {ident!r} has an unknown source {source!r}")
        if (c.get("operator") or "lte") not in OPERATORS:
            raise ValueError(f"criterion {ident!r} has an unknown operator")
        if "threshold" not in c:
            raise ValueError(f"criterion {ident!r} needs a threshold")
    if latency is not None:
        if not isinstance(latency, dict) or not isinstance(latency.get("rules"), list) or not latency["rules"]:
            raise ValueError("latency.rules must be a list that isn't empty")
        check_rules(latency["rules"])


def check_rules(rules: list[dict[str, Any]], topics: Mapping[str, int] = TOPIC_IDS) -> list[dict[str, Any]]:
    """Latency rules in full; ids are unique and a topic stands in one rule at most."""
    out, ids, used = [], set(), set()
    for rule in rules:
        if not isinstance(rule, dict):
            raise ValueError(f"a latency rule is an object: {rule!r}")
        ident = str(rule.get("id") or "")
        if not ident or ident in ids:
            raise ValueError("latency rules need ids of their own")
        ids.add(ident)
        names = rule.get("topics")
        if not isinstance(names, list) or not names:
            raise ValueError(f"latency rule {ident!r} needs topics")
        if unknown := sorted(set(names) - set(topics)):
            raise ValueError(f"latency rule {ident!r} has unknown topics {unknown}")
        if again := sorted(set(names) & used):
            raise ValueError(f"topics stand in more than one latency rule: {again}")
        used |= set(names)
        most, allowed = rule.get("max_ms"), rule.get("allowed_exceed_percent")
        if not isinstance(most, int | float) or most < 0:
            raise ValueError(f"latency rule {ident!r} needs a max_ms of 0 or more")
        if not isinstance(allowed, int | float) or not 0 <= allowed <= 100:
            raise ValueError(f"latency rule {ident!r} needs an allowed_exceed_percent of 0 to 100")
        out.append({"id": ident, "title": str(rule.get("title") or ident), "topics": list(names), "topic_ids": [topics[n] for n in names],
                    "max_ms": round(most), "allowed_exceed_percent": Decimal(str(allowed))})
    return out


def latency_rules(spark: SparkSession, profile: Mapping[str, Any]) -> DataFrame:
    """schemas.LATENCY_RULE of a profile; empty if it has no latency part."""
    rules = check_rules((profile.get("latency") or {}).get("rules") or [])
    return spark.createDataFrame([tuple(r.values()) for r in rules], LATENCY_RULE)


def criteria(spark: SparkSession, profile: Mapping[str, Any]) -> DataFrame:
    rows = [
        (c["id"], c.get("title") or c["id"], c.get("source") or "audit", [str(x) for x in c.get("path") or []], c.get("measurement"),
         c.get("operator") or "lte", float(c["threshold"]), c.get("unit") or "", bool(c.get("required", True)))
        for c in profile.get("criteria") or []
    ]
    return spark.createDataFrame(rows, CRITERION)


def flattened(document: Mapping[str, Any], prefix: tuple[str, ...] = ()) -> list[tuple[str, float]]:
    """(dotted path, number) of every number in a document."""
    out: list[tuple[str, float]] = []
    for key, value in document.items():
        at = (*prefix, str(key))
        if isinstance(value, Mapping):
            out += flattened(value, at)
        elif isinstance(value, int | float) and not isinstance(value, bool):
            out.append((".".join(at), float(value)))
    return out


class Settings:
    """A small table of settings, read again for every micro-batch; the fallback where it can't be."""

    def __init__(self, spark: SparkSession, path: str, fallback: Mapping[str, Any]):
        self.spark, self.path, self.fallback = spark, path, dict(fallback)

    def get(self) -> dict[str, Any]:
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.json(self.path).orderBy("version", ascending=False).first()
        except AnalysisException:
            return dict(self.fallback)
        return self.fallback | {k: v for k, v in row.asDict().items() if v is not None} if row else dict(self.fallback)
