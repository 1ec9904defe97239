"""The theme: sections, vendors, change types and sources of a deployment, checked when loaded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("theme", "corpus", "sources")
SOURCE = "source_id string, type string, url string, vendor string, priority int, enabled boolean, live_collect boolean, backfill_supported boolean"


class ThemeError(ValueError):
    """A theme that cannot be used."""


def load(text: str) -> dict:
    """A theme from JSON, or from YAML, of which readers take far longer."""
    try:
        return check(json.loads(text) or {})
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            yaml = None
        if yaml is None:
            raise
    return check(yaml.safe_load(text) or {})


def check(theme: dict) -> dict:
    """The theme itself, if it has all sections, vendors, change types, and sources with their own id and a type."""
    for section in SECTIONS:
        if section not in theme:
            raise ThemeError(f"missing section: {section}")
    for part in ("vendors", "change_types"):
        if not theme["corpus"].get(part):
            raise ThemeError(f"corpus.{part} is empty")
    seen = set()
    for source in theme["sources"]:
        if not source.get("id") or not source.get("type"):
            raise ThemeError(f"source without id or type: {source}")
        if source["id"] in seen:
            raise ThemeError(f"duplicate source id: {source['id']}")
        seen.add(source["id"])
    return theme


def sources_frame(spark: SparkSession, theme: dict) -> DataFrame:
    """Sources as rows; switches that are not given are on, the priority is 5."""
    rows = [(s["id"], s["type"], s.get("url"), s.get("vendor"), int(s.get("priority", 5)), bool(s.get("enabled", True)), bool(s.get("live_collect", True)), bool(s.get("backfill_supported", True))) for s in theme["sources"]]
    return spark.createDataFrame(rows, SOURCE)
