"""The data contract: what a user declares about one table.

A contract is driver-side configuration. It is loaded from YAML (or a dict) and checked
completely before any data is read, so that a bad contract never fails half way through a job.
Patterns are judged by Java: at load if there is a session, else when the contract is applied.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.registry import TRANSFORM_BUILDERS

# The system columns and the vocabulary of the contract file.
FLAGS = "_dq_flags"
REASON = "_quarantine_reason"
CORRUPT = "_corrupt_record"
UNDECLARED = "_undeclared_fields"
POLICIES = ("quarantine", "nullify", "warn")
FORMATS = ("json", "csv", "parquet", "table")
DERIVATIONS = ("to_date",)
KEEP = ("first", "last")

# The type names of the contract file.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}
_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)")


class ContractError(ValueError):
    """A contract that cannot be used; the message lists every problem found."""


def spark_type(declared: str) -> T.DataType:
    """Spark type for a declared type name, which is case-insensitive."""
    name = declared.strip().lower()
    if name in TYPES:
        return TYPES[name]
    found = _DECIMAL.fullmatch(name)
    if found:
        precision, scale = int(found[1]), int(found[2])
        if 1 <= precision <= 38 and scale <= precision:
            return T.DecimalType(precision, scale)
    raise ContractError(f"unsupported column type {declared!r}")


@dataclass(frozen=True)
class Rules:
    """Soft quality rules of one column and the policy for rows that break them."""

    unique: bool = False
    regex: str | None = None
    valid_cpf: bool = False
    valid_email: bool = False
    min: float | None = None
    max: float | None = None
    on_fail: str = "warn"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    description: str = ""
    transform: str | None = None
    formats: tuple[str, ...] = ()
    score_map: dict[str, float] = field(default_factory=dict)
    rules: Rules = Rules()

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.type)


@dataclass(frozen=True)
class Source:
    """Where the raw rows come from.

    ``fields`` names JSON fields outside the contract that should be read too, so that they
    reach the quarantine table. ``infer`` makes Spark find all fields itself, at the price of
    one more pass over the files.
    """

    format: str
    path: str
    options: dict[str, Any] = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    infer: bool = False


@dataclass(frozen=True)
class Dedup:
    keys: tuple[str, ...]
    order_by: str | None = None
    keep: str = "last"


@dataclass(frozen=True)
class Derived:
    name: str
    source: str
    expr: str = "to_date"


@dataclass(frozen=True)
class Contract:
    version: str
    name: str
    source: Source
    columns: tuple[ColumnSpec, ...]
    description: str = ""
    primary_key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    dedup: Dedup | None = None
    derived: tuple[Derived, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Contract:
        problems: list[str] = []
        contract = _read_contract(raw, problems)
        if contract is not None and not problems:
            problems = _inconsistencies(contract)
        if problems:
            raise ContractError("; ".join(problems))
        return contract

    @classmethod
    def from_yaml(cls, path: str | Path) -> Contract:
        return cls.from_text(Path(path).read_text(encoding="utf-8"), str(path))

    @classmethod
    def from_text(cls, text: str, origin: str = "contract") -> Contract:
        """A contract from YAML text; ``origin`` names it in messages."""
        try:
            return cls.from_dict(yaml.safe_load(text))
        except (ContractError, yaml.YAMLError) as error:
            raise ContractError(f"{origin}: {error}") from None

    def check_patterns(self) -> None:
        """Refuse patterns that Java refuses; for contracts that were loaded before there was a session."""
        if problems := _pattern_problems(self.columns):
            raise ContractError("; ".join(problems))

    @property
    def required(self) -> list[str]:
        """Columns whose NULL rejects the row: the key, then the non-nullable columns."""
        plain = [c.name for c in self.columns if not c.nullable and c.name not in self.primary_key]
        return [*self.primary_key, *plain]

    def schema(self) -> T.StructType:
        """Schema of the valid table."""
        out = [
            T.StructField(c.name, c.spark_type, True, {"comment": c.description} if c.description else None)
            for c in self.columns
        ]
        out += [T.StructField(d.name, T.DateType(), True) for d in self.derived]
        return T.StructType([*out, T.StructField(FLAGS, T.ArrayType(T.StringType()), False)])

    def reading_from(self, base: str | None) -> Contract:
        """The same contract with its source file looked up in another folder."""
        if not base or self.source.format == "table":
            return self
        moved = f"{base.rstrip('/')}/{self.source.path.rstrip('/').rsplit('/', 1)[-1]}"
        return replace(self, source=replace(self.source, path=moved))


# --- reading the raw mapping ----------------------------------------------------------------

_SHAPES: dict[type, dict[str, tuple[type, ...]]] = {
    Rules: {
        "unique": (bool,), "regex": (str,), "valid_cpf": (bool,), "valid_email": (bool,),
        "min": (int, float), "max": (int, float), "on_fail": (str,),
    },
    ColumnSpec: {
        "name": (str,), "type": (str,), "nullable": (bool,), "description": (str,),
        "transform": (str,), "formats": (list,), "score_map": (dict,), "rules": (dict,),
    },
    Source: {"format": (str,), "path": (str,), "options": (dict,), "fields": (list,), "infer": (bool,)},
    Dedup: {"keys": (list,), "order_by": (str,), "keep": (str,)},
    Derived: {"name": (str,), "from": (str,), "expr": (str,)},
    Contract: {
        "version": (str,), "name": (str,), "description": (str,), "source": (dict,),
        "primary_key": (list,), "partition_by": (list,), "dedup": (dict,), "columns": (list,),
        "derived": (list,),
    },
}
_MANDATORY: dict[type, tuple[str, ...]] = {
    Rules: (),
    ColumnSpec: ("name", "type"),
    Source: ("format", "path"),
    Dedup: ("keys",),
    Derived: ("name", "from"),
    Contract: ("version", "name", "source", "columns"),
}
_NULLABLE_KEYS = {"regex", "min", "max", "transform", "order_by", "dedup"}


def _checked(kind: type, raw: Any, where: str, problems: list[str]) -> dict[str, Any] | None:
    """Known keys of ``raw`` with lists as tuples; None when the mapping cannot be used."""
    if not isinstance(raw, dict):
        problems.append(f"{where}: expected a mapping")
        return None
    before = len(problems)
    shape = _SHAPES[kind]
    problems += [f"{where}: unknown key {key!r}" for key in raw if key not in shape]
    problems += [f"{where}: missing key {key!r}" for key in _MANDATORY[kind] if key not in raw]
    out: dict[str, Any] = {}
    for key, value in raw.items():
        allowed = shape.get(key)
        if allowed is None or (value is None and key in _NULLABLE_KEYS):
            continue
        wrong_bool = isinstance(value, bool) and bool not in allowed
        if wrong_bool or not isinstance(value, allowed):
            problems.append(f"{where}.{key}: expected {' or '.join(t.__name__ for t in allowed)}")
        else:
            out[key] = tuple(value) if isinstance(value, list) else value
    return out if len(problems) == before else None


def _names(values: tuple, where: str, problems: list[str]) -> tuple:
    problems += [f"{where}: {v!r} is not a text" for v in values if not isinstance(v, str)]
    return values


def _read_rules(raw: Any, where: str, problems: list[str]) -> Rules:
    values = _checked(Rules, raw, where, problems) or {}
    for bound in ("min", "max"):
        if bound in values:
            values[bound] = float(values[bound])
    return Rules(**values)


def _read_column(raw: Any, where: str, problems: list[str]) -> ColumnSpec | None:
    values = _checked(ColumnSpec, raw, where, problems)
    if values is None:
        return None
    where = f"column {values['name']!r}"
    if "rules" in values:
        values["rules"] = _read_rules(values["rules"], f"{where}.rules", problems)
    _names(values.get("formats", ()), f"{where}.formats", problems)
    scores = values.get("score_map", {})
    for key, score in scores.items():
        if not isinstance(key, str) or isinstance(score, bool) or not isinstance(score, (int, float)):
            problems.append(f"{where}.score_map: {key!r} must map a text to a number")
            return None
    values["score_map"] = {key: float(score) for key, score in scores.items()}
    return ColumnSpec(**values)


def _read_contract(raw: Any, problems: list[str]) -> Contract | None:
    values = _checked(Contract, raw, "contract", problems)
    if values is None:
        return None
    source = _checked(Source, values["source"], "source", problems)
    if source is not None:
        _names(source.get("fields", ()), "source.fields", problems)
        values["source"] = Source(**source)
    columns = [
        _read_column(entry, f"columns[{i}]", problems) for i, entry in enumerate(values["columns"])
    ]
    values["columns"] = tuple(columns)
    if "dedup" in values:
        dedup = _checked(Dedup, values["dedup"], "dedup", problems)
        values["dedup"] = Dedup(**dedup) if dedup else None
    derived = []
    for i, entry in enumerate(values.get("derived", ())):
        found = _checked(Derived, entry, f"derived[{i}]", problems)
        if found is not None:
            derived.append(Derived(found["name"], found["from"], found.get("expr", "to_date")))
    values["derived"] = tuple(derived)
    for key in ("primary_key", "partition_by"):
        _names(values.get(key, ()), key, problems)
    return None if problems else Contract(**values)


# --- consistency of a well-formed contract --------------------------------------------------


def _regex_problem(pattern: str) -> str | None:
    """Why Spark would refuse the pattern. Only Java judges it; without a session that waits until use."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        if hasattr(spark, "_jvm"):
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:  # a client of a remote session has no Java of its own
            spark.range(1).select(F.lit("").rlike(pattern)).collect()
        return None
    except Exception as error:  # pattern errors come wrapped in several ways
        lines = str(error).splitlines()
        return next((line for line in lines if "PatternSyntaxException" in line), lines[0])


def _pattern_problems(columns: Iterable[ColumnSpec]) -> list[str]:
    out = []
    for c in columns:
        problem = None if c.rules.regex is None else _regex_problem(c.rules.regex)
        if problem:
            out.append(f"column {c.name!r}: bad regex {c.rules.regex!r}: {problem}")
    return out


def _column_problems(c: ColumnSpec) -> list[str]:
    out = []
    where = f"column {c.name!r}"
    try:
        numeric = isinstance(c.spark_type, T.NumericType)
    except ContractError as error:
        return [f"{where}: {error}"]
    if c.transform is not None and c.transform not in TRANSFORM_BUILDERS:
        out.append(f"{where}: unknown transform {c.transform!r}")
    if c.transform == "parse_timestamp" and not c.formats:
        out.append(f"{where}: parse_timestamp needs 'formats'")
    r = c.rules
    if r.on_fail not in POLICIES:
        out.append(f"{where}: unknown on_fail {r.on_fail!r}")
    if (r.min is not None or r.max is not None) and not numeric:
        out.append(f"{where}: min/max need a numeric type, not {c.type!r}")
    if r.min is not None and r.max is not None and r.min > r.max:
        out.append(f"{where}: min {r.min} is above max {r.max}")
    return out + _pattern_problems([c])


def _inconsistencies(contract: Contract) -> list[str]:
    out: list[str] = []
    columns = [c.name for c in contract.columns]
    derived = [d.name for d in contract.derived]
    seen: set[str] = set()
    for name in [*columns, *derived]:
        if name.lower() in seen:
            out.append(f"column {name!r} is declared twice")
        if name in (FLAGS, REASON):
            out.append(f"column name {name!r} is reserved")
        seen.add(name.lower())
    if not columns:
        out.append("columns: at least one column is needed")
    if contract.source.format not in FORMATS:
        out.append(f"source: unknown format {contract.source.format!r}")
    for c in contract.columns:
        out += _column_problems(c)
    out += [f"primary_key: {k!r} is not a column" for k in contract.primary_key if k not in columns]
    out += [
        f"partition_by: {p!r} is neither a column nor derived"
        for p in contract.partition_by
        if p not in columns and p not in derived
    ]
    if contract.dedup is not None:
        d = contract.dedup
        if not d.keys:
            out.append("dedup.keys: at least one key is needed")
        out += [f"dedup.keys: {k!r} is not a column" for k in d.keys if k not in columns]
        if d.order_by is not None and d.order_by not in columns:
            out.append(f"dedup.order_by: {d.order_by!r} is not a column")
        if d.keep not in KEEP:
            out.append(f"dedup.keep: unknown value {d.keep!r}")
    for d in contract.derived:
        if d.source not in columns:
            out.append(f"derived {d.name!r}: {d.source!r} is not a column")
        if d.expr not in DERIVATIONS:
            out.append(f"derived {d.name!r}: unknown expr {d.expr!r}")
    return out
