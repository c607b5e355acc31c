"""Extraction paths: the dotted child indexes that address a node of an event tree.

``3.1.0`` reads "third child, its first child, the name of that".  A zero
always means "the name of this node", so everything after it is either the
same name again (more zeros) or nothing at all.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class NodePath:
    """A path in normal form, decided once on the driver.

    ``node`` is the address used inside tree columns (``""`` is the root),
    ``name_only`` tells that the children of that node are out of sight, and
    ``nowhere`` that no tree can have such a node.
    """

    node: str
    name_only: bool = False
    nowhere: bool = False

    @property
    def indexes(self) -> tuple[int, ...]:
        return tuple(int(i) for i in self.node.split(".")) if self.node else ()


def node_path(path: str | int | Iterable[int] | NodePath) -> NodePath:
    """Normalise ``"3.1.0"``, ``3`` or ``[3, 1, 0]``."""
    if isinstance(path, NodePath):
        return path
    if isinstance(path, int):
        indexes = [path]
    elif isinstance(path, str):
        indexes = [int(part) for part in path.split(".")] if path else []
    else:
        indexes = [int(part) for part in path]
    if any(i < 0 for i in indexes):
        raise ValueError(f"negative child index in path {path!r}")
    if 0 not in indexes:
        return NodePath(".".join(map(str, indexes)))
    cut = indexes.index(0)
    node = ".".join(map(str, indexes[:cut]))
    return NodePath(node, name_only=True, nowhere=any(indexes[cut:]))
