"""Calculated signals: one plan per formula, and a registry of named formulas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.formula import FormulaError, compile_formula, parse, references_of, rename_reference, validate_name
from ..operators import align, temporal
from ..operators.keys import GENERATED, TIME, generated_key
from .durable import written

#: Bytes a sample costs in the size estimate, and the points from which to warn.
BYTES_PER_POINT, TIME_ONLY_BYTES, WARN_POINTS = 64, 24, 5_000_000


def calculate(samples: DataFrame, formula: str, available: Iterable[str] | None = None, by: Sequence[str] = (), buckets: int = align.BUCKETS) -> DataFrame:
    """(t_s, value) of a formula over samples (signal_key, seq, t_s, value).

    Every reference is held on the union of the referenced times, from the latest first sample on; a value is NaN
    where a current input, a temporal result or the result isn't finite.
    """
    parsed = parse(formula, available)
    keys = list(parsed.references)
    calls: list = []
    compile_formula(parsed, lambda key: F.lit(0.0), lambda call: calls.append(call) or F.lit(0.0))
    calls = list(dict.fromkeys(calls))
    source = align.with_time_signal(samples, keys).select(*by, "signal_key", F.col("seq").cast("long").alias("seq"), "t_s", F.coalesce("value", F.lit(ieee.NAN)).alias("value"))
    source = temporal.add_calls(source, calls, by)
    held_columns = [f"f{k}" for k, c in enumerate(calls) if c.function != "delay"]
    table = align.wide(source, keys, ["value", *held_columns], by)
    lasts = [c.reference for c in calls if c.function == "integral"]
    names = [f"s{i}" for i in range(len(keys))]
    held = align.hold(table, names, by=by, buckets=buckets, cut=align.slices(source, buckets=buckets))
    for name in names:
        held = held.where(F.col(name).isNotNull())
    for ref in dict.fromkeys(lasts):
        i = keys.index(ref)
        end = source.where(F.col("signal_key") == ref).groupBy(*by).agg(F.max("t_s").alias(f"_end{i}"))
        if by:
            held = held.join(end, list(by))
        else:
            held = held.withColumn(f"_end{i}", F.lit(end.first()[0]))
    for k, call in enumerate(calls):
        if call.function == "delay":
            back = source.where(F.col("signal_key") == call.reference)
            asked = held.select(*by, "t_s", (F.col("t_s") - F.lit(call.arguments[0])).alias("q"))
            found = align.as_of(asked, back, by=by, buckets=buckets).select(*by, F.col("t_s"), F.coalesce("value", F.lit(ieee.NAN)).alias(f"_d{k}"))
            held = held.join(found, [*by, "t_s"])

    def of_call(call):
        k, i = calls.index(call), keys.index(call.reference)
        if call.function == "delay":
            return F.col(f"_d{k}")
        column = F.col(f"s{i}")[f"f{k}"]
        return temporal.finish_integral(column, F.col("t_s"), F.col(f"_end{i}")) if call.function == "integral" else column

    done = compile_formula(parsed, lambda key: F.col(f"s{keys.index(key)}.value"), of_call)
    ok = ieee.finite(done.value)
    for key in sorted(done.current):
        ok = ok & ieee.finite(F.col(f"s{keys.index(key)}.value"))
    for call in calls:
        ok = ok & ieee.finite(of_call(call))
    return held.select(*by, "t_s", F.when(ok, done.value).otherwise(F.lit(ieee.NAN)).alias("value"))


def as_samples(calculated: DataFrame, name: str, unit: str = "") -> DataFrame:
    """A calculated (t_s, value) in the samples schema."""
    return calculated.select(
        F.lit(generated_key(name)).alias("signal_key"), F.lit("CAN").alias("bus"), F.lit(None).cast("int").alias("channel"), F.lit(GENERATED).alias("message"),
        F.lit(0).cast("long").alias("message_id"), F.lit(name).alias("signal"), F.lit(unit).alias("unit"), F.lit(0).cast("long").alias("seq"), "t_s", "value", F.lit(None).cast("string").alias("label"),
    )


def estimate_points(samples: DataFrame, formula: str) -> DataFrame:
    """One row: points, bytes, warn. Advisory only."""
    keys = list(parse(formula).references)
    n = align.with_time_signal(samples, keys).agg(F.count(F.lit(1)).alias("points"))
    each = TIME_ONLY_BYTES if keys == [TIME] else BYTES_PER_POINT
    return n.select("points", (F.col("points") * each).alias("bytes"), (F.col("points") > WARN_POINTS).alias("warn"))


@dataclass(frozen=True)
class Definition:
    name: str
    formula: str
    unit: str = ""

    @property
    def key(self) -> str:
        return generated_key(self.name)


class Registry:
    """Named formulas: unique names in either case, no cycles, renames carried into dependents."""

    def __init__(self, definitions: Iterable[Definition] = ()):
        self._by_name: dict[str, Definition] = {}
        for d in definitions:
            self.put(d)

    def __iter__(self):
        return iter(self._by_name.values())

    def __len__(self) -> int:
        return len(self._by_name)

    def get(self, name: str) -> Definition | None:
        return self._by_name.get(name.strip().lower())

    def put(self, definition: Definition, replacing: str | None = None) -> Definition:
        """Add, or put in the place of `replacing`; a changed name is changed in all dependents too."""
        new = replace(definition, name=validate_name(definition.name), unit=definition.unit.strip())
        parse(new.formula)
        old = self.get(replacing) if replacing else None
        if (clash := self.get(new.name)) and clash is not old:
            raise FormulaError(f"A calculated signal named {clash.name} exists already")
        trial: dict[str, Definition] = {}
        for d in self._by_name.values():
            if d is old:
                trial[new.name.lower()] = new
            else:
                trial[d.name.lower()] = replace(d, formula=rename_reference(d.formula, old.key, new.key)) if old and old.name != new.name else d
        if old is None:
            trial[new.name.lower()] = new
        elif old.name != new.name:
            trial[new.name.lower()] = new = replace(new, formula=rename_reference(new.formula, old.key, new.key))
        _order(trial)
        self._by_name = trial
        return new

    def delete(self, name: str) -> None:
        self._by_name.pop(name.strip().lower(), None)

    def dependents(self, name: str) -> list[str]:
        own = self.get(name)
        return [d.name for d in self if own and own.key in references_of(d.formula)]

    def order(self) -> list[Definition]:
        """Prerequisites first."""
        return _order(self._by_name)

    def needed(self, name: str) -> list[Definition]:
        """The definition's prerequisites, first things first, and itself."""
        by_key = {d.key: d for d in self}
        wanted, stack = set(), [self.get(name)]
        while stack:
            d = stack.pop()
            if d and d.key not in wanted:
                wanted.add(d.key)
                stack += [by_key.get(r) for r in references_of(d.formula)]
        return [d for d in self.order() if d.key in wanted]

    def calculate(self, samples: DataFrame, name: str, **how) -> DataFrame:
        """samples of the named signal. Each prerequisite is written once, so the work grows with their number, not with its power."""
        base = samples.select("signal_key", F.col("seq").cast("long").alias("seq"), "t_s", "value")
        out = None
        needed = self.needed(name)
        for d in needed:
            out = as_samples(calculate(base, d.formula, **how), d.name, d.unit)
            if d is not needed[-1]:
                out = written(out, "calculated")
            base = base.unionByName(out.select("signal_key", "seq", "t_s", "value"))
        if out is None:
            raise FormulaError(f"Calculated signal not found: {name}")
        return out

    def to_config(self) -> list[dict]:
        return [{"name": d.name, "formula": d.formula, "unit": d.unit} for d in self]

    def import_config(self, entries: list, clash: str = "skip") -> tuple[int, list[str]]:
        """(imported, errors); clash: skip, overwrite, or replace (all first)."""
        if clash == "replace":
            self._by_name = {}
        done, wrong = 0, []
        for k, entry in enumerate(entries if isinstance(entries, list) else []):
            try:
                if not isinstance(entry, dict) or not isinstance(entry.get("name"), str) or not isinstance(entry.get("formula"), str):
                    raise FormulaError("name and formula are required")
                d = Definition(entry["name"], entry["formula"], str(entry.get("unit") or ""))
                exists = self.get(d.name)
                if exists and clash == "skip":
                    continue
                self.put(d, replacing=exists.name if exists else None)
                done += 1
            except FormulaError as e:
                wrong.append(f"entry {k + 1}: {e}")
        return done, wrong


def _order(definitions: dict[str, Definition]) -> list[Definition]:
    by_key = {d.key: d for d in definitions.values()}
    out: list[Definition] = []
    state: dict[str, int] = {}

    def visit(d: Definition, path: list[str]) -> None:
        if state.get(d.key) == 2:
            return
        if state.get(d.key) == 1:
            raise FormulaError("Circular reference: " + " -> ".join([*path[path.index(d.name) :], d.name]))
        state[d.key] = 1
        for r in references_of(d.formula):
            if r in by_key:
                visit(by_key[r], [*path, d.name])
        state[d.key] = 2
        out.append(d)

    for d in definitions.values():
        visit(d, [])
    return out


def save_library(path: str, definitions: Iterable[Definition]) -> None:
    body = {"type": "formula-library", "version": 1, "formulas": [{"name": d.name, "formula": d.formula, "unit": d.unit} for d in definitions]}
    with open(path, "w", encoding="utf-8") as out:
        json.dump(body, out, ensure_ascii=False, indent=2)


def load_library(path: str) -> tuple[list[dict], list[str]]:
    """(entries, errors) of a library file, under formulas or generated_signals."""
    with open(path, encoding="utf-8") as source:
        try:
            body = json.load(source)
        except ValueError as e:
            raise FormulaError(f"Not a formula library: {e}") from None
    found = body.get("formulas", body.get("generated_signals")) if isinstance(body, dict) else None
    if not isinstance(found, list):
        raise FormulaError("Not a formula library: it has no list of formulas")
    good, wrong = [], []
    for k, entry in enumerate(found):
        name, formula = (entry.get("name"), entry.get("formula")) if isinstance(entry, dict) else (None, None)
        if isinstance(name, str) and name.strip() and isinstance(formula, str) and formula.strip():
            good.append({"name": name, "formula": formula, "unit": str(entry.get("unit") or "")})
        else:
            wrong.append(f"entry {k + 1}: name and formula are required")
    return good, wrong
