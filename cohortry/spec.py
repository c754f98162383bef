"""Plain request objects: which table, which filter, which sample."""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry import vocab
from cohortry.functions.json_fields import json_integer, json_label


@dataclass(frozen=True)
class TableSpec:
    """Names the columns of one entity table that the operators work with."""

    id_column: str
    range_column: str | None = None
    list_fields: Mapping[str, str] = field(default_factory=dict)
    search_column: str | None = None
    trait_columns: Sequence[str] = ()
    vocabularies: Mapping[str, Sequence[str]] = field(default_factory=dict)
    base_context: Sequence[str] = ()
    extended_context: Sequence[str] = ()
    narratives: Sequence[str] = ()
    preview: Sequence[str] = ()
    score_key: str = "t_score"
    label_key: str = "label"


def persona_spec() -> TableSpec:
    """The persona table with its fixed columns and vocabularies."""
    return TableSpec(
        id_column=vocab.ID_COLUMN,
        range_column="age",
        list_fields=vocab.LIST_FIELDS,
        search_column="occupation",
        trait_columns=vocab.TRAIT_COLUMNS,
        vocabularies=vocab.VOCABULARIES,
        base_context=vocab.BASE_CONTEXT_COLUMNS,
        extended_context=(*vocab.HEALTH_COLUMNS, *vocab.TRAIT_COLUMNS),
        narratives=vocab.NARRATIVE_COLUMNS,
        preview=vocab.PREVIEW_COLUMNS,
    )


@dataclass(frozen=True)
class TraitFilter:
    """Score range and labels wanted from one JSON-in-string column."""

    score_min: int | None = None
    score_max: int | None = None
    labels: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.score_min is not None and self.score_max is not None and self.score_min > self.score_max:
            raise ValueError("trait score_min cannot be greater than score_max")


@dataclass(frozen=True)
class CohortFilter:
    """A declarative filter: a closed range, value lists, one literal search, trait filters; all parts are ANDed."""

    spec: TableSpec
    minimum: int | float | None = None
    maximum: int | float | None = None
    values: Mapping[str, Sequence] = field(default_factory=dict)
    search: str | None = None
    traits: Mapping[str, TraitFilter] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.minimum is not None and self.maximum is not None and self.minimum > self.maximum:
            raise ValueError(f"{self.spec.range_column}_min cannot be greater than {self.spec.range_column}_max")
        for name, wanted in self.values.items():
            if name not in self.spec.list_fields:
                raise ValueError(f"Unsupported filter field: {name}")
            column = self.spec.list_fields[name]
            allowed = self.spec.vocabularies.get(column)
            unknown = sorted(set(wanted) - set(allowed)) if allowed else []
            if unknown:
                raise ValueError(f"Unsupported {column} value: {', '.join(unknown)}")
        unknown = sorted(set(self.traits) - set(self.spec.trait_columns))
        if unknown:
            raise ValueError(f"Unsupported Big Five trait: {', '.join(unknown)}")

    @classmethod
    def from_dict(cls, payload: Mapping, spec: TableSpec) -> CohortFilter:
        """Build a filter from a request mapping such as a JSON config file."""
        rest = dict(payload)
        low, high = rest.pop(f"{spec.range_column}_min", None), rest.pop(f"{spec.range_column}_max", None)
        search = rest.pop(f"{spec.search_column}_search", None)
        traits = {
            trait: TraitFilter(t.get("t_score_min"), t.get("t_score_max"), tuple(t.get("labels", ())))
            for trait, t in rest.pop("big_five_filters", {}).items()
        }
        return cls(spec, low, high, {k: tuple(v) for k, v in rest.items() if v}, search, traits)

    def _terms(self) -> list[tuple[Column, str]]:
        """Each part as (predicate, readable text), in a fixed order."""
        spec, terms = self.spec, []
        for sign, bound in ((">=", self.minimum), ("<=", self.maximum)):
            if bound is not None:
                value = F.col(spec.range_column)
                terms.append((value >= bound if sign == ">=" else value <= bound, f"{spec.range_column} {sign} {bound}"))
        for name, column in spec.list_fields.items():
            wanted = list(self.values.get(name, ()))
            if wanted:
                terms.append((F.col(column).isin(wanted), f"{column} in ({', '.join(map(str, wanted))})"))
        if self.search:
            column = spec.search_column
            terms.append((F.col(column).contains(self.search), f"{column} contains {self.search}"))
        for trait, wanted in self.traits.items():
            score, label = json_integer(F.col(trait), spec.score_key), json_label(F.col(trait), spec.label_key)
            if wanted.score_min is not None:
                terms.append((score >= wanted.score_min, f"{trait}.{spec.score_key} >= {wanted.score_min}"))
            if wanted.score_max is not None:
                terms.append((score <= wanted.score_max, f"{trait}.{spec.score_key} <= {wanted.score_max}"))
            if wanted.labels:
                terms.append((label.isin(list(wanted.labels)), f"{trait}.{spec.label_key} in ({', '.join(wanted.labels)})"))
        return terms

    def predicate(self) -> Column:
        """The filter as one Spark predicate; TRUE when no part is set."""
        return functools.reduce(operator.and_, (p for p, _ in self._terms()), F.lit(True))

    def summary(self) -> str:
        """Readable form, parts joined by semicolons."""
        return "; ".join(text for _, text in self._terms()) or "all synthetic personas"

    def payload(self) -> dict:
        """Every request field except unset scalars, as JSON-ready values."""
        spec = self.spec
        out: dict = {name: list(self.values.get(name, ())) for name in spec.list_fields}
        scalars = {
            f"{spec.range_column}_min": self.minimum,
            f"{spec.range_column}_max": self.maximum,
            f"{spec.search_column}_search": self.search,
        }
        out.update({k: v for k, v in scalars.items() if v is not None})
        if spec.trait_columns:
            out["big_five_filters"] = {
                trait: {
                    k: v
                    for k, v in (
                        ("t_score_min", t.score_min),
                        ("t_score_max", t.score_max),
                        ("labels", list(t.labels)),
                    )
                    if v is not None
                }
                for trait, t in self.traits.items()
            }
        return out

    def canonical_json(self) -> str:
        """Deterministic text of the filter, used in hashes."""
        return json.dumps(self.payload(), ensure_ascii=False, sort_keys=True)

    def digest(self) -> str:
        """SHA-256 of the canonical text."""
        return hashlib.sha256(self.canonical_json().encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class SamplingSpec:
    """How many entities to draw, and with which seed."""

    sample_size: int
    seed: int
    method: str = "deterministic_random"

    def __post_init__(self) -> None:
        if self.sample_size < 1:
            raise ValueError("sample_size must be at least 1")
        if self.method != "deterministic_random":
            raise ValueError(f"Unsupported sampling method: {self.method}")

    def canonical_json(self) -> str:
        """Compact JSON in field order, used in the cohort id."""
        fields = {"sample_size": self.sample_size, "seed": self.seed, "method": self.method}
        return json.dumps(fields, separators=(",", ":"))


@dataclass(frozen=True)
class CohortRequest:
    """A named filter with its sampling, as read from a config file."""

    name: str
    filters: CohortFilter
    sampling: SamplingSpec

    @classmethod
    def from_dict(cls, payload: Mapping, spec: TableSpec) -> CohortRequest:
        return cls(payload["name"], CohortFilter.from_dict(payload["filters"], spec), SamplingSpec(**payload["sampling"]))


@dataclass(frozen=True)
class Question:
    """One question of a set; a repeat names the original it repeats."""

    question_id: str
    question_text: str
    question_type: str = "ORIGINAL"
    repeat_of_question_id: str | None = None


def require_questions(questions: Sequence[Question]) -> None:
    """Raise unless ids are unique and every repeat, and only a repeat, names an original of the set."""
    types = {q.question_id: q.question_type for q in questions}
    if not questions:
        raise ValueError("a question set needs at least one question")
    if len(types) != len(questions):
        raise ValueError("duplicate question_id values are not allowed")
    for q in questions:
        is_repeat, link = q.question_type == "SAME_QUESTION_REPEAT", q.repeat_of_question_id
        if is_repeat != (link is not None):
            raise ValueError(f"{q.question_id}: a repeat, and only a repeat, names the question it repeats")
        if link is not None and types.get(link) != "ORIGINAL":
            raise ValueError(f"{q.question_id}: {link} is not an original question of the set")
        if not q.question_text:
            raise ValueError(f"{q.question_id}: the text must not be empty")


def require_variants(variants: Sequence[tuple[str, str]]) -> None:
    """Raise unless variants have unique known labels and texts."""
    labels = [label for label, _ in variants]
    if not variants or len(set(labels)) != len(labels) or not set(labels) <= set(vocab.VARIANT_LABELS):
        raise ValueError("scenario variants need unique labels out of " + ", ".join(vocab.VARIANT_LABELS))
    if not all(text for _, text in variants):
        raise ValueError("scenario variants need a text")


@dataclass(frozen=True)
class Run:
    """The settings shared by every response of one run."""

    project_id: str
    run_id: str
    cohort_id: str
    scenario_id: str
    question_set_id: str
    seed: int
    context_level: str = "P2"
    model: str = "mock-model"
    temperature: float = 0.3
    prompt_version: str = "prompt_v1"

    def __post_init__(self) -> None:
        for name in ("project_id", "run_id", "cohort_id", "scenario_id", "question_set_id"):
            if not re.search(vocab.ID_PATTERNS[name], getattr(self, name)):
                raise ValueError(f"invalid {name}: {getattr(self, name)}")
        if not 0.0 <= self.temperature <= 2.0:
            raise ValueError("temperature must lie between 0 and 2")
        if not self.model or not self.prompt_version:
            raise ValueError("model and prompt_version must not be empty")


@dataclass(frozen=True)
class Recipe:
    """An analysis as data: grouping, metrics and row filters over evaluated pairs."""

    recipe_id: str
    group_by: Sequence[str]
    metrics: Sequence[str]
    compare_against: str = "ORIGINAL"
    filters: Mapping[str, Sequence] = field(default_factory=dict)
