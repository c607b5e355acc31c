"""Labels for events: format strings with extraction paths, chosen by what was traced."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import Expr, S, let, name_at, name_in, name_is, node_path, render, render_at
from ..functions.paths import NodePath
from ..functions.text import tokenize

# A specifier: "$", an argument number or one letter, then further child indexes.
_SPECIFIER = r"\$(?:\d+|[a-z])(?:\.\d+)*"


@dataclass(frozen=True)
class FunctionTarget:
    """Calls of a function, seen as an event or as a span."""

    function: str


@dataclass(frozen=True)
class VariableTarget:
    """A local variable of a function."""

    function: str
    variable: str


Target = FunctionTarget | VariableTarget


def target_of(package: str, tracer: Mapping[str, str]) -> Target | None:
    """What a tracer of the configuration refers to; None when it has no single target."""
    kind = tracer["type"]
    if kind not in ("event", "span", "local"):
        return None
    owner, method = f"{package}.{tracer['class']}", tracer["method"]
    # A constructor is named like its class and traced under the name of the class.
    function = owner if owner.endswith("." + method) else f"{owner}.{method}"
    return VariableTarget(function, tracer["variable"]) if kind == "local" else FunctionTarget(function)


def target_columns(tree: Expr, at: str) -> tuple[Expr, Expr]:
    """``(function, variable)`` of the event body at ``at``; NULL where it has none."""
    called = name_is(tree, f"{at}.0", "SpanStart", "Fn")
    local = name_is(tree, f"{at}.0", "LocalVariable")
    function = S.when(called | local, name_at(tree, f"{at}.1.0"))
    return function, S.when(local, name_at(tree, f"{at}.2"))


@dataclass(frozen=True)
class FormatSpec:
    """A compiled format string: literals and paths, alternating."""

    text: str
    parts: tuple[str | NodePath, ...]

    @classmethod
    def parse(cls, text: str, target: Target) -> FormatSpec:
        of_function = isinstance(target, FunctionTarget)

        def path(specifier: str) -> NodePath:
            head, *rest = specifier[1:].split(".")
            if of_function and head == "r":
                return node_path([3, *rest])  # the return value
            if re.fullmatch("[a-z]", head):
                raise ValueError(f"unknown specifier ${head} in format {text!r}")
            return node_path([2, head, *rest] if of_function else [head, *rest])

        pieces = tokenize(text, _SPECIFIER)
        return cls(text, tuple(path(p) if i % 2 else p for i, p in enumerate(pieces)))

    def rendered(self, tree: Expr, at: str = "") -> Expr:
        """The label of the event body at ``at``."""
        parts = [
            render(tree, _under(at, part)) if isinstance(part, NodePath) else S.lit(part)
            for part in self.parts
            if part != ""
        ]
        return S.concat(*parts) if parts else S.lit("")


def _under(at: str, path: NodePath) -> NodePath:
    node = ".".join(part for part in (at, path.node) if part)
    return NodePath(node, path.name_only, path.nowhere)


class Formatter:
    """Formats each event body by its target, or as plain text if it has no format."""

    def __init__(self, specs: Mapping[Target, FormatSpec]):
        self.specs = dict(specs)

    @classmethod
    def from_targets(cls, targets: Mapping[str, Sequence[Mapping[str, str]]] | None) -> Formatter:
        specs: dict[Target, FormatSpec] = {}
        for package, tracers in (targets or {}).items():
            for tracer in tracers:
                target = target_of(package, tracer)
                if target is not None and tracer.get("format"):
                    specs[target] = FormatSpec.parse(tracer["format"], target)
        return cls(specs)

    @classmethod
    def from_formats(cls, formats: Mapping[Target, str]) -> Formatter:
        return cls({target: FormatSpec.parse(text, target) for target, text in formats.items()})

    def label(self, events: DataFrame, out: str, tree: str = "tree", at: str = "3") -> DataFrame:
        """Add column ``out``: the label of the event body at ``at``.

        The formats travel as one literal map from target to parts, so the
        plan does not grow with the number of rules.
        """
        whole = S.col(tree)
        if not self.specs:
            return events.withColumn(out, render(whole, at).column)

        def part_of(part: str | NodePath) -> Expr:
            if isinstance(part, NodePath):
                text, node, bare = None, None if part.nowhere else _under(at, part).node, part.name_only
            else:
                text, node, bare = part, None, False
            return S.struct(text=S.lit(text).cast("string"), node=S.lit(node).cast("string"), bare=bare)

        formats = []
        for target, spec in self.specs.items():
            formats += [_key(target), S.array(*map(part_of, spec.parts))]

        def piece(part: Expr) -> Expr:
            return (
                S.when(part["text"].is_not_null(), part["text"])
                .when(part["node"].is_null(), "")
                .when(part["bare"], S.coalesce(name_in(whole, part["node"]), ""))
                .otherwise(render_at(whole, part["node"]))
            )

        function, variable = target_columns(whole, at)
        key = S.when(
            name_is(whole, f"{at}.0", "LocalVariable"), S.concat(function, _SEPARATOR, variable)
        ).otherwise(function)
        label = let(
            S.try_element_at(S.map(*formats), key),
            lambda parts: S.when(
                parts.is_not_null(), S.array_join(S.transform(parts, piece), "")
            ).otherwise(render(whole, at)),
        )
        return events.withColumn(out, label.column)


# Cannot occur in the name of a function or variable.
_SEPARATOR = "\0"


def _key(target: Target) -> str:
    if isinstance(target, VariableTarget):
        return f"{target.function}{_SEPARATOR}{target.variable}"
    return target.function
