"""The declared contract (A4): fields, pairs and rule tables as data.

A contract comes from two documents (mappings, usually YAML): one listing the
form's fields, one listing the answer/explanation pairs and the cross-field
checks.  Nothing in the operators names a field; they read this object and
generate column expressions, or join the small dimension tables built here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FIELD_TYPES = ("structured", "free_text", "metadata")
PII_CLASSES = ("direct_identifier", "quasi_identifier", "sensitive_commercial", "none")


@dataclass(frozen=True)
class FieldSpec:
    id: str
    type: str
    form_ref: str = ""
    label: str = ""
    pii_class: str = "none"
    value_domain: tuple[str, ...] = ()
    test: str | None = None
    justification_for: str | None = None
    routing: Mapping[str, str] = field(default_factory=dict)
    role: str | None = None

    def __post_init__(self) -> None:
        if self.type not in FIELD_TYPES:
            raise ValueError(f"{self.id}: unknown field type {self.type!r}")
        if self.pii_class not in PII_CLASSES:
            raise ValueError(f"{self.id}: unknown pii class {self.pii_class!r}")

    @property
    def is_outcome(self) -> bool:
        return self.role == "outcome"


@dataclass(frozen=True)
class PairSpec:
    id: str
    structured: str
    free_text: str
    test: str
    outside_leaning: str
    priority: str | None = None
    contradiction: str = ""
    cues: tuple[str, ...] = ()

    @property
    def high_priority(self) -> bool:
        return self.priority == "high"


def flatten_cues(cues: Mapping[str, Any] | None) -> tuple[str, ...]:
    """G1: the cue lists of one pair as lower-cased terms, in order.

    Only list-valued entries are term lists; a bare string is a pattern kept
    for documentation and is ignored.
    """
    lists = [v for v in (cues or {}).values() if isinstance(v, (list, tuple))]
    terms = (str(term).lower().strip() for values in lists for term in values)
    return tuple(t for t in terms if t)


@dataclass(frozen=True)
class FormSpec:
    fields: tuple[FieldSpec, ...]
    pairs: tuple[PairSpec, ...] = ()
    cross_field_checks: tuple[Mapping[str, Any], ...] = ()
    premise_template: str = "The record answers '{label}' with: {value}"

    @classmethod
    def from_documents(
        cls,
        fields_doc: Mapping[str, Any],
        pairs_doc: Mapping[str, Any] | None = None,
        *,
        test_key: str = "test",
    ) -> "FormSpec":
        """Build the contract; ``test_key`` names the property holding the test."""
        pairs_doc = pairs_doc or {}
        fields = tuple(
            FieldSpec(
                id=f["id"],
                type=f["type"],
                form_ref=str(f.get("form_ref") or ""),
                label=str(f.get("label") or ""),
                pii_class=f.get("pii_class", "none"),
                value_domain=tuple(f.get("value_domain") or ()),
                test=f.get(test_key),
                justification_for=f.get("justification_for"),
                routing={
                    str(k): v
                    for k, v in (f.get("routing") or {}).items()
                    if k != "note" and isinstance(v, str)
                },
                role=f.get("role"),
            )
            for f in fields_doc["fields"]
        )
        pairs = tuple(
            PairSpec(
                id=p["id"],
                structured=p["structured"],
                free_text=p["free_text"],
                test=p[test_key],
                outside_leaning=p["outside_leaning"],
                priority=p.get("priority"),
                contradiction=str(p.get("contradiction", "")).strip(),
                cues=flatten_cues(p.get("cues")),
            )
            for p in pairs_doc.get("pairs", ())
        )
        extra = {}
        template = (pairs_doc.get("defaults") or {}).get("premise_template")
        if template:
            extra["premise_template"] = template
        return cls(fields, pairs, tuple(pairs_doc.get("cross_field_checks", ())), **extra)

    # ------------------------------------------------- B1/B2: column selection
    @cached_property
    def by_id(self) -> dict[str, FieldSpec]:
        return {f.id: f for f in self.fields}

    @cached_property
    def pair_by_id(self) -> dict[str, PairSpec]:
        return {p.id: p for p in self.pairs}

    def of_type(self, field_type: str) -> list[FieldSpec]:
        return [f for f in self.fields if f.type == field_type]

    def for_test(self, test: str) -> list[FieldSpec]:
        return [f for f in self.fields if f.test == test]

    def pairs_for_test(self, test: str) -> list[PairSpec]:
        return [p for p in self.pairs if p.test == test]

    @cached_property
    def input_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields if not f.is_outcome]

    @cached_property
    def outcome_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.is_outcome]

    @cached_property
    def answer_fields(self) -> list[FieldSpec]:
        """Structured, closed-domain fields that are not outcomes."""
        return [f for f in self.input_fields if f.type == "structured" and f.value_domain]

    def routed_fields(self, prefix: str) -> list[FieldSpec]:
        return [f for f in self.answer_fields if f.form_ref.startswith(prefix)]

    @cached_property
    def justifications(self) -> dict[str, str]:
        return {f.justification_for: f.id for f in self.fields if f.justification_for}

    @cached_property
    def pii_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.pii_class != "none"]

    # ------------------------------------------------------- dimension tables
    def fields_dim(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, f.id, f.form_ref, f.label, f.type, f.pii_class, f.test, list(f.value_domain),
             f.justification_for, f.role, dict(f.routing))
            for i, f in enumerate(self.fields)
        ]
        return spark.createDataFrame(
            rows,
            "ord int, field_id string, form_ref string, label string, type string, "
            "pii_class string, test_id string, value_domain array<string>, "
            "justification_for string, role string, routing map<string,string>",
        )

    def domains_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(f.id, v) for f in self.answer_fields for v in f.value_domain]
        return spark.createDataFrame(rows, "field_id string, value string")

    def pairs_dim(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, p.id, p.structured, p.free_text, p.test, p.outside_leaning, p.priority,
             p.contradiction, list(p.cues))
            for i, p in enumerate(self.pairs)
        ]
        return spark.createDataFrame(
            rows,
            "ord int, pair_id string, structured string, free_text string, test_id string, "
            "outside_leaning string, priority string, contradiction string, cues array<string>",
        )

    def cues_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, t, i) for p in self.pairs for i, t in enumerate(p.cues)]
        return spark.createDataFrame(rows, "pair_id string, term string, ord int")

    def routing_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(f.id, k, v) for f in self.answer_fields for k, v in f.routing.items()]
        return spark.createDataFrame(rows, "field_id string, value string, target string")


@dataclass(frozen=True)
class DeidPolicy:
    """De-identification settings; the defaults keep every protection on."""

    field_policy: Mapping[str, str] = field(
        default_factory=lambda: {
            "direct_identifier": "replace",
            "quasi_identifier": "pseudonymise",
            "sensitive_commercial": "mask",
            "none": "keep",
        }
    )
    detectors: Sequence[str] = (
        "email", "uk_phone", "uk_postcode", "money", "company_number",
        "ni_number", "url", "date_of_birth", "person_name",
    )
    name_groups: Sequence[Sequence[str]] = ()
    salt: str = ""
    enabled: bool = True
    scrub_entities: bool = True

    @classmethod
    def from_document(cls, doc: Mapping[str, Any], salt: str | None = None) -> "DeidPolicy":
        entity = doc.get("entity_scrubbing") or {}
        base = cls()
        return cls(
            field_policy=doc.get("field_policy", base.field_policy),
            detectors=tuple(entity.get("detectors", base.detectors)),
            name_groups=tuple(tuple(g) for g in doc.get("name_groups", ())),
            salt=salt if salt is not None else str(doc.get("development_salt", "")),
            enabled=bool(doc.get("enabled", True)),
            scrub_entities=bool(entity.get("enabled", True)),
        )


@dataclass(frozen=True)
class ValidationPolicy:
    enforce_value_domains: bool = True
    enforce_routing: bool = True
    require_justification: bool = True
    min_free_text_chars: int = 15
    section_prefix: str = "4."


def load_yaml(path: str | Path) -> dict[str, Any]:
    """Read one YAML document; a missing file is an error, an empty one is ``{}``."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_form(
    directory: str | Path, *, fields_file: str, pairs_file: str, test_key: str = "test"
) -> FormSpec:
    base = Path(directory)
    return FormSpec.from_documents(
        load_yaml(base / fields_file), load_yaml(base / pairs_file), test_key=test_key
    )
