"""Shapes of JSON values: a declared shape becomes one expression that reads any text and never fails."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """How to read a value: ``read`` gives a column from a variant column, null where it doesn't fit.

    A field that is ``required`` takes its object with it when it doesn't fit;
    any other becomes its ``default``. A value of another JSON type never fits: no number is read from a string.
    """

    read: Callable[[Column], Column]
    kind: str
    required: bool = False
    default: object = None

    def need(self) -> Shape:
        return Shape(self.read, self.kind, True, None)

    def or_else(self, default: object) -> Shape:
        return Shape(self.read, self.kind, False, default)


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(test: Callable[[Column], Column] | None = None) -> Shape:
    """A string, and only one that passes ``test``."""

    def read(v: Column) -> Column:
        value = F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return value if test is None else F.when(test(value), value)

    return Shape(read, "string")


def filled() -> Shape:
    return text(lambda s: F.length(s) > 0)


def one_of(values: list[str]) -> Shape:
    return text(lambda s: s.isin(values))


def number(test: Callable[[Column], Column] | None = None) -> Shape:
    """A finite number, and only one that passes ``test``."""

    def read(v: Column) -> Column:
        value = F.try_variant_get(v, "$", "double")
        fits = _type(v).isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | F.startswith(_type(v), F.lit("DECIMAL"))
        fits = fits & ~F.isnan(value) & (F.abs(value) < float("inf"))
        return F.when(fits if test is None else fits & test(value), value)

    return Shape(read, "double")


def above_zero() -> Shape:
    return number(lambda n: n > 0)


def flag() -> Shape:
    """True only for the JSON value true."""
    return Shape(lambda v: F.coalesce((_type(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False)), "boolean")


def record(**fields: Shape) -> Shape:
    """An object with these fields, null if a required one doesn't fit; other fields are left out."""
    kind = "struct<" + ",".join(f"{k}:{s.kind}" for k, s in fields.items()) + ">"

    def read(v: Column) -> Column:
        is_object = F.startswith(_type(v), F.lit("OBJECT"))
        got = {k: s.read(F.try_variant_get(v, f"$.{k}", "variant")) for k, s in fields.items()}
        fits = is_object
        for k, s in fields.items():
            if s.required:
                fits = fits & got[k].isNotNull()
        values = [(got[k] if s.default is None else F.coalesce(got[k], F.lit(s.default).cast(s.kind))).alias(k) for k, s in fields.items()]
        return F.when(fits, F.struct(*values))

    return Shape(read, kind)


def choice(tag: str, **cases: Shape) -> Shape:
    """An object read by the shape that its ``tag`` names; every case's fields are there, null where another case was read.

    The result has the tag and a field for each case, of which one is filled.
    """
    kind = f"struct<{tag}:string," + ",".join(f"{k}:{s.kind}" for k, s in cases.items()) + ">"

    def read(v: Column) -> Column:
        named = one_of(list(cases)).read(F.try_variant_get(v, f"$.{tag}", "variant"))
        got = {k: F.when(named == k, s.read(v)) for k, s in cases.items()}
        return F.when(_any(got), F.struct(named.alias(tag), *[g.alias(k) for k, g in got.items()]))

    return Shape(read, kind)


def _any(got: dict[str, Column]) -> Column:
    out = F.lit(False)
    for g in got.values():
        out = out | g.isNotNull()
    return out


def items(of: Shape, least: int = 0) -> Shape:
    """An array without the elements that don't fit; null if it is no array, or fewer than ``least`` are left."""

    def read(v: Column) -> Column:
        found = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), of.read), lambda x: x.isNotNull())
        return F.when(F.startswith(_type(v), F.lit("ARRAY")) & (F.size(found) >= least), found)

    return Shape(read, f"array<{of.kind}>")


def coerce(column: Column, shape: Shape) -> Column:
    """The text column read by a shape; null for null, for what is no JSON, and for what doesn't fit."""
    value = shape.read(F.try_parse_json(column))
    return value if shape.default is None else F.coalesce(value, F.lit(shape.default).cast(shape.kind))


# Levels, kinds of tasks, mixes and hints of a study plan.
LEVELS = ["District", "Association", "ICDC"]
TASKS = ["drill", "quiz", "review", "fix"]
MIXES = ["balanced", "easy", "hard"]
HINTS = ["easy", "medium", "hard", "mixed"]


def study_plan() -> Shape:
    """A stored study plan: who it is for, and today's tasks, each with what it launches."""
    aim = {"cluster": filled().need(), "level": one_of(LEVELS).need(), "count": above_zero().need()}
    launch = choice("kind", review=record(), drill=record(**aim, pi=text().need(), area=text().need()), quiz=record(**aim, mix=one_of(MIXES).need()))
    target = record(cluster=text().need(), level=one_of(LEVELS).need(), pi=text(), area=text())
    task = record(
        id=text().need(),
        type=one_of(TASKS).need(),
        title=text(lambda s: F.length(F.trim(s)) > 0).need(),
        subtitle=text().or_else(""),
        size=above_zero().or_else(1.0),
        difficultyHint=one_of(HINTS).or_else("mixed"),
        launch=launch.need(),
        target=target,
        missIds=items(text()),
    )
    today = record(date=filled().need(), dismissed=items(text()), custom=items(task), recommended=items(task, least=1))
    return record(cluster=filled().need(), level=one_of(LEVELS).need(), eventDate=number(), dailyGoal=number(), createdTs=number().or_else(0.0), diagnosticDone=flag(), today=today)
