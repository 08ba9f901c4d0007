"""The declared data model: entities, variables, rules and keys.

A model is driver-side metadata only (a few hundred variables at most); every
row of data stays in DataFrames.  A model is read from the same JSON layout
the reference pipeline uses (``entities[].variables[]`` with ``label``,
``format``, ``type``, ``catalog_bl``, ``catalog``; ``entities[].rules[]``),
plus optional ``primary_key`` / ``foreign_keys`` / ``priority`` per entity.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

from pyspark.sql import types as T

log = logging.getLogger(__name__)

# Configuration ``format`` -> staging type.  Integers stage as
# DECIMAL(38,0) (a 128-bit integer accepts ``1.0``, ``1e3`` and 20 digits) and
# are narrowed to INT only at publish.
FORMAT_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "integer": T.DecimalType(38, 0),
    "double": T.DoubleType(),
}

# Target-store types used when publishing.
PUBLISH_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
}

# String columns longer than this do not fit the target store,
# except the free-text labels listed next to it.
STRING_LIMIT = 255
UNLIMITED_TEXT_LABELS = ("exploration_description_st",)


def normalize_format(fmt: str | None) -> str:
    """Lower-case a format; unknown formats fall back to string with a warning."""
    f = str(fmt).lower()
    if f not in FORMAT_TYPES:
        log.warning("Format %r not found, will be interpreted as string", fmt)
        return "string"
    return f


def spark_type(fmt: str) -> T.DataType:
    return FORMAT_TYPES[normalize_format(fmt)]


@dataclass(frozen=True)
class CatalogRef:
    """Where the code list of a categorical variable lives."""
    filename: str
    column_name: str = "code"


@dataclass(frozen=True)
class Variable:
    label: str
    format: str = "string"
    type: str | None = None
    catalog_bl: bool = False
    catalog: CatalogRef | None = None

    @property
    def fmt(self) -> str:
        return normalize_format(self.format)

    @property
    def dtype(self) -> T.DataType:
        return FORMAT_TYPES[self.fmt]

    @property
    def is_categorical(self) -> bool:
        return self.type == "Categorical"

    @property
    def checks_catalog(self) -> bool:
        """Catalog check applies when flagged and the format is not boolean."""
        return bool(self.catalog_bl) and self.fmt != "boolean" and self.catalog is not None


@dataclass(frozen=True)
class Rule:
    expression: str


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass
class Entity:
    name: str
    variables: list[Variable]
    rules: list[Rule] = field(default_factory=list)
    primary_key: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    priority: int | None = None

    @property
    def labels(self) -> list[str]:
        return [v.label for v in self.variables]

    def variable(self, label: str) -> Variable:
        for v in self.variables:
            if v.label == label:
                return v
        raise KeyError(f"{self.name} has no variable {label}")

    @property
    def schema(self) -> T.StructType:
        """Staging schema in declared order."""
        return T.StructType([T.StructField(v.label, v.dtype, True) for v in self.variables])

    @property
    def publish_schema(self) -> T.StructType:
        return T.StructType([T.StructField(v.label, PUBLISH_TYPES[v.fmt], v.label not in self.primary_key)
                             for v in self.variables])


@dataclass
class DataModel:
    entities: list[Entity]
    metadata: dict = field(default_factory=dict)
    version: str = "Non-versioned"
    uuid: str | None = None
    cohort: dict = field(default_factory=dict)

    def entity(self, name: str) -> Entity:
        for e in self.entities:
            if e.name == name:
                return e
        raise KeyError(name)

    @property
    def use_case(self) -> str:
        return str(self.metadata.get("use_case", "use_case")).replace(" ", "_")

    def load_order(self) -> list[Entity]:
        """Parents before children (topological over foreign keys); ties by
        declared priority, entities without one last (99), then by name."""
        by_name = {e.name: e for e in self.entities}
        prio = {e.name: (e.priority if e.priority is not None else 99) for e in self.entities}
        deps = {e.name: {fk.parent for fk in e.foreign_keys if fk.parent in by_name and fk.parent != e.name}
                for e in self.entities}
        done: list[str] = []
        pending = set(by_name)
        while pending:
            ready = sorted((n for n in pending if deps[n] <= set(done)), key=lambda n: (prio[n], n))
            if not ready:
                raise ValueError(f"foreign keys form a cycle among {sorted(pending)}")
            done.append(ready[0])
            pending.remove(ready[0])
        return [by_name[n] for n in done]

    def children_of(self, parent: str) -> list[tuple[Entity, ForeignKey]]:
        return [(e, fk) for e in self.entities for fk in e.foreign_keys if fk.parent == parent]

    # ------------------------------------------------------------------ JSON
    # The configuration layout existing models are written in.
    # Top level: cdmb_version, uuid, cohort, metadata (use_case, project),
    # entities.  Entity: name, variables, rules (expression).  Variable: label,
    # format, type, catalog_bl, catalog (column_name, filename).  Added here,
    # optional: primary_key, foreign_keys (columns, parent, parent_columns),
    # priority.
    @classmethod
    def from_dict(cls, cfg: dict, strict: bool = False) -> "DataModel":
        """``strict`` (used for files) also asks for the use case and every variable's format."""
        if "entities" not in cfg:
            raise ValueError("the configuration has no list of entities")
        if strict and not cfg.get("metadata", {}).get("use_case"):
            raise ValueError("the configuration's metadata name no use case")
        entities = []
        for i, ent in enumerate(cfg["entities"]):
            if "name" not in ent or "variables" not in ent:
                raise ValueError(f"entity {i} lacks its name or its variables")
            variables = []
            for var in ent["variables"]:
                if "label" not in var:
                    raise ValueError(f'variable without "label" in {ent["name"]}')
                if strict and "format" not in var:
                    raise ValueError(f'variable {ent["name"]}.{var["label"]} has no format')
                if "catalog_bl" not in var:
                    log.warning('"catalog_bl" is not defined for %s.%s', ent["name"], var["label"])
                cat = var.get("catalog")
                ref = None
                if var.get("catalog_bl") is True and str(var.get("format")).lower() != "boolean":
                    if not cat or "column_name" not in cat or "filename" not in cat:
                        raise ValueError(f'{ent["name"]}.{var["label"]} needs a catalog with file and column name')
                    ref = CatalogRef(cat["filename"], cat["column_name"])
                variables.append(Variable(var["label"], var.get("format", "string"), var.get("type"),
                                          var.get("catalog_bl") is True, ref))
            if "rules" not in ent:
                log.warning('"rules" is not defined for entity %s', ent["name"])
            rules = [Rule(r["expression"]) for r in ent.get("rules", [])]
            fks = [ForeignKey(tuple(fk["columns"]), fk["parent"], tuple(fk.get("parent_columns", fk["columns"])))
                   for fk in ent.get("foreign_keys", [])]
            entities.append(Entity(ent["name"], variables, rules, tuple(ent.get("primary_key", ())), fks,
                                   ent.get("priority", i)))
        return cls(entities, cfg.get("metadata", {}), cfg.get("cdmb_version", "Non-versioned"),
                   cfg.get("uuid"), cfg.get("cohort", {}))

    @classmethod
    def from_json(cls, path: str) -> "DataModel":
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f), strict=True)
