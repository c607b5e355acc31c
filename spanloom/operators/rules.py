"""Declarative rules: conditions, cascades of conditions, event filters, case parsing.

Rules are nested mappings from condition text to either a value or more rules::

    {"3.0 = RPC": {"default": False, "3.3.0 = StatusUpdate": {"3.3.3 = RUNNING": True}}}

They are compiled on the driver into expressions; nothing is
interpreted per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    TREE_TYPE,
    Expr,
    S,
    is_defined,
    let,
    name_in,
    node_path,
    render,
    tree_from_text_shallow,
    update_in,
)
from ..functions.paths import NodePath


def _literal_list(text: str) -> list[str]:
    items = re.split(r",\s*", text)
    while len(items) > 1 and items[-1] == "":
        items.pop()
    return items


_PREDICATES: dict[str, Callable[[Expr, NodePath, str], Expr]] = {
    "=": lambda tree, at, value: render(tree, at) == value,
    "!=": lambda tree, at, value: render(tree, at) != value,
    "in": lambda tree, at, value: render(tree, at).isin(*_literal_list(value)),
    "exists": lambda tree, at, _value: is_defined(tree, at),
    "~": lambda tree, at, value: render(tree, at).rlike(value),
}
_PREDICATES["=="] = _PREDICATES["="]
_PREDICATES["matches"] = _PREDICATES["~"]


@dataclass(frozen=True)
class Condition:
    """One condition; ``path`` is None for the constant ``default``."""

    text: str
    path: NodePath | None
    predicate: str = ""
    value: str = ""

    @classmethod
    def parse(cls, text: str) -> Condition:
        parts = re.split(r"\s+", text, maxsplit=2)
        if parts == ["default"]:
            return cls(text, None)
        if len(parts) < 2:
            raise ValueError(f"not a condition: {text!r}")
        if parts[1] not in _PREDICATES:
            raise ValueError(f"unknown predicate {parts[1]!r} in condition {text!r}")
        return cls(text, node_path(parts[0]), parts[1], parts[2] if len(parts) == 3 else "")

    @property
    def constant(self) -> bool:
        return self.path is None

    def holds(self, tree: Expr) -> Expr:
        """True or false, never NULL, for a non-NULL tree."""
        if self.constant:
            return S.lit(True)
        return _PREDICATES[self.predicate](tree, self.path, self.value)


def condition(text: str, tree: Expr) -> Expr:
    return Condition.parse(text).holds(tree)


@dataclass(frozen=True)
class Rule:
    """A value that holds where all conditions hold."""

    conditions: tuple[Condition, ...]
    value: Any

    def matches(self, tree: Expr) -> Expr:
        hit = S.lit(True)
        for cond in self.conditions:
            if not cond.constant:
                hit = hit & cond.holds(tree)
        return hit


def cascade(rules: Mapping[str, Any] | None, check: Callable[[Any], Any] = lambda value: value) -> list[Rule]:
    """Flatten nested rules, shallow first; at equal depth a final ``default`` comes first.

    Rules that tie keep the order in which they were declared.
    """

    def flatten(level: Mapping[str, Any], above: tuple[Condition, ...]) -> Iterable[Rule]:
        for text, value in level.items():
            here = (*above, Condition.parse(text))
            if isinstance(value, Mapping):
                yield from flatten(value, here)
            else:
                yield Rule(here, check(value))

    depth_then_default = lambda rule: (len(rule.conditions), not rule.conditions[-1].constant)
    return sorted(flatten(rules or {}, ()), key=depth_then_default)


# --------------------------------------------------------------------------
# event filters


def _boolean(value: Any) -> bool:
    if not isinstance(value, bool):
        raise TypeError(f"a filter must be true or false, not {value!r}")
    return value


def filter_rules(rules: Mapping[str, Any] | None) -> list[Rule]:
    return cascade(rules, _boolean)


def keeps(rules: Mapping[str, Any] | None, tree: Expr) -> Expr:
    """Whether an event passes: the last matching rule decides, no match keeps it."""
    compiled = filter_rules(rules)
    if not compiled:
        return S.lit(True)
    chain = None
    for rule in reversed(compiled):
        hit, value = rule.matches(tree), S.lit(rule.value)
        chain = S.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(S.lit(True))


# --------------------------------------------------------------------------
# case parsing


def _paths(value: Any) -> tuple[NodePath, ...]:
    if isinstance(value, str) or not isinstance(value, Iterable):
        raise TypeError(f"case parsing needs a list of paths, not {value!r}")
    return tuple(node_path(path) for path in value)


def case_parse_rules(rules: Mapping[str, Any] | None) -> list[Rule]:
    return cascade(rules, _paths)


def _changes(written: NodePath, read: NodePath) -> bool:
    """Whether replacing one subtree can change what is read at a path."""
    w, r = written.indexes, read.indexes
    # The name of a node changes only with the node or one above it.
    return w == r[: len(w)] or (not read.name_only and r == w[: len(r)])


def _exclusive(one: Rule, other: Rule) -> bool:
    """Whether two rules ask one name to be two different things."""
    fixed = lambda rule: {
        c.path: c.value for c in rule.conditions if c.predicate in ("=", "==") and c.path.name_only
    }
    first, second = fixed(one), fixed(other)
    return any(first[path] != second[path] for path in first.keys() & second.keys())


def _steps(rules: list[Rule]) -> list[list[Rule]]:
    """Group consecutive rules that cannot see what the others of their group change."""
    steps: list[list[Rule]] = []
    for rule in rules:
        tests = [c.path for c in rule.conditions if not c.constant]

        def apart(earlier: Rule) -> bool:
            tested = any(_changes(w, path) for w in earlier.value for path in tests)
            rewritten = any(_changes(w, path) for w in earlier.value for path in rule.value)
            return not tested and (not rewritten or _exclusive(earlier, rule))

        if steps and all(map(apart, steps[-1])):
            steps[-1].append(rule)
        else:
            steps.append([rule])
    return steps


def case_parse(
    events: DataFrame,
    rules: Mapping[str, Any] | None,
    tree: str = "tree",
    faults: str = "faults",
    strict: bool = False,
) -> DataFrame:
    """Re-parse named leaves as ``name(arg, …)``, one level, where the conditions hold.

    Rules apply in cascade order and each sees the result of those before it.
    An addressed node that is missing or not well-formed text is left as it is
    and its path is added to the array column ``faults``; with ``strict`` it
    fails the query instead.
    """
    compiled = case_parse_rules(rules)
    if not compiled:
        return events.withColumn(faults, S.array().cast("array<string>").column)
    start = S.struct(tree=S.col(tree), faults=S.array().cast("array<string>"))
    events = events.withColumn("_state", start.column)
    state = S.col("_state")
    # One projection per step, each referring to the one before: the plan stays
    # linear in the number of steps, and most events pass a step untouched.
    for step in _steps(compiled):
        hits = [(rule.matches(state["tree"]), rule.value) for rule in step]
        # No lambda around the conditions: what a lambda reads is interpreted, this is generated code.
        wanted = S.concat(S.array().cast("array<string>"), *[_where(hit, [path.node for path in paths]) for hit, paths in hits])

        def parse(acc: Expr, node: Expr) -> Expr:
            if strict:
                fault = S.raise_error(S.concat("cannot parse node ", node)).cast(TREE_TYPE)
            else:
                fault = S.lit(None).cast(TREE_TYPE)
            new = update_in(acc["tree"], node, tree_from_text_shallow(name_in(acc["tree"], node)), fault)
            return let(
                new,
                lambda t: S.when(t.is_not_null(), S.struct(tree=t, faults=acc["faults"])).otherwise(
                    S.struct(tree=acc["tree"], faults=S.array_append(acc["faults"], node))
                ),
            )

        events = events.withColumn("_wanted", wanted.column).withColumn(
            "_state",
            S.when(S.size(S.col("_wanted")) > 0, S.aggregate(S.col("_wanted"), state, parse))
            .otherwise(state)
            .column,
        )
    # Exploded rather than projected: filters on the result stay above the parsing.
    rest = [name for name in events.columns if name not in (tree, "_state", "_wanted")]
    done = events.select(*rest, F.explode(S.array(state).column).alias("_state"))
    return done.select(*rest, state["tree"].column.alias(tree), state["faults"].column.alias(faults))


def _where(hit: Expr, nodes: list[str]) -> Expr:
    return S.when(hit, S.array(*nodes)).otherwise(S.array().cast("array<string>"))
