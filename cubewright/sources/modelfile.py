"""Metadata of a tabular model file (TOM JSON) and of a report layout, as frames for the rules."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..model import Cardinality, Relationship

_HIDDEN = ("LocalDateTable_", "DateTableTemplate_")


def _text(value: Any) -> str:
    return "\n".join(value) if isinstance(value, list) else value or ""


def _title(single: dict) -> str | None:
    """The literal title of a visual."""
    for item in (single.get("vcObjects") or {}).get("title", []):
        value = (((item.get("properties") or {}).get("text") or {}).get("expr") or {}).get("Literal", {}).get("Value")
        if value:
            return value.strip("'").replace("''", "'")
    return None


def _filter_target(item: dict) -> tuple[str | None, str | None]:
    """(table, column) that a report filter is on."""
    for kind in ("Column", "Measure", "HierarchyLevel"):
        part = (item.get("expression") or {}).get(kind)
        if part:
            return ((part.get("Expression") or {}).get("SourceRef") or {}).get("Entity"), part.get("Property") or part.get("Level")
    return None, None


def relationships(model: dict) -> list[Relationship]:
    """Relationships of a TOM document; the many side is ``from`` unless it says otherwise."""
    out = []
    for r in model.get("model", model).get("relationships", []):
        sides = (r.get("fromCardinality", "many"), r.get("toCardinality", "one"))
        out.append(
            Relationship(
                r["fromTable"], r["fromColumn"], r["toTable"], r["toColumn"], Cardinality.parse(":".join(sides)),
                r.get("crossFilteringBehavior") == "bothDirections", r.get("isActive", True),
            )
        )
    return out


def model_frames(spark: SparkSession, text: str, layout: str | None = None) -> dict[str, DataFrame]:
    """Frames tables, columns, measures, relationships, visuals, pages, bookmarks and filters of a TOM document and a report layout.

    A table is calculated if one of its partitions is, a column if its type says so; their
    formulas are metadata.  filters: those of the whole report.
    """
    model = json.loads(text)
    body = model.get("model", model)
    tables = [t for t in body.get("tables", []) if not t["name"].startswith(_HIDDEN)]
    links = body.get("relationships", [])
    report = json.loads(layout) if layout else {}
    visuals, pages = [], []
    for section in report.get("sections", []):
        name = section.get("displayName") or section.get("name") or ""
        pages.append((name,))
        for container in section.get("visualContainers", []):
            config = container.get("config") or "{}"
            config = json.loads(config) if isinstance(config, str) else config
            single = config.get("singleVisual", {})
            fields = [p["queryRef"] for ps in single.get("projections", {}).values() for p in ps if p.get("queryRef")]
            visuals.append((name, config.get("name") or "", single.get("visualType") or "", fields, _title(single)))
    settings = report.get("config") or "{}"
    settings = json.loads(settings) if isinstance(settings, str) else settings
    marks = [(b.get("displayName") or b.get("name") or "", b.get("explorationState", {}).get("activeSection") or "") for b in settings.get("bookmarks", [])]
    filters = report.get("filters") or "[]"
    filters = json.loads(filters) if isinstance(filters, str) else filters
    frame = spark.createDataFrame
    made = {t["name"]: [p["source"] for p in t.get("partitions", []) if (p.get("source") or {}).get("type") == "calculated"] for t in tables}
    return {
        "tables": frame([(n, bool(p), _text(p[0].get("expression")) if p else None) for n, p in made.items()], "table string, calculated boolean, formula string"),
        "columns": frame(
            [(t["name"], c["name"], c.get("dataType") or "", c.get("type") == "calculated", _text(c.get("expression")) or None) for t in tables for c in t.get("columns", [])],
            "table string, column string, data_type string, calculated boolean, formula string",
        ),
        "measures": frame([(t["name"], m["name"], _text(m.get("expression")), m.get("formatString") or "") for t in tables for m in t.get("measures", [])], "table string, measure string, formula string, format string"),
        "relationships": frame(
            [(r["fromTable"], r["fromColumn"], r["toTable"], r["toColumn"], r.get("isActive", True)) for r in links],
            "from_table string, from_column string, to_table string, to_column string, active boolean",
        ),
        "visuals": frame(visuals, "page string, visual string, visual_type string, fields array<string>, title string"),
        "filters": frame([(f.get("name") or "", *_filter_target(f)) for f in filters], "filter string, table string, column string"),
        "pages": frame(pages, "page string"),
        "bookmarks": frame(marks, "bookmark string, page string"),
    }
