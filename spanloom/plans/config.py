"""Options of a run: where traces are, where results go, which rules apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from . import defaults


@dataclass(frozen=True)
class TraceConfig:
    """Rules start from the defaults; pass an empty mapping or list to switch a part off."""

    props: Mapping[str, Any] = field(default_factory=dict)
    targets: Mapping[str, Sequence[Mapping[str, str]]] = field(default_factory=lambda: defaults.TARGETS)
    filters: Mapping[str, Any] = field(default_factory=lambda: defaults.FILTERS)
    remove_services: Sequence[str] = field(default_factory=lambda: defaults.REMOVE_SERVICES)
    case_parse: Mapping[str, Any] = field(default_factory=lambda: defaults.CASE_PARSE)
    #: Whether a rule that cannot parse its node fails the run, instead of being recorded in ``faults``.
    strict: bool = False

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> TraceConfig:
        """From the sections of a configuration (``remove-services`` or ``remove_services``).

        Sections that are absent are empty, as they are in a configuration file.
        """
        given = {key.replace("-", "_"): value for key, value in settings.items()}
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown configuration sections: {sorted(unknown)}")
        absent = {"props": {}, "targets": {}, "filters": {}, "remove_services": [], "case_parse": {}}
        return cls(**{**absent, **given})

    def prop(self, name: str, required: bool = True) -> str | None:
        if name not in self.props:
            if required:
                raise KeyError(f"missing configuration property {name}")
            return None
        value = self.props[name]
        return str(value).lower() if isinstance(value, bool) else str(value)
