"""What was done to a table, carried beside it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ReleaseInfo:
    k: int | None = None
    k_columns: tuple[str, ...] = ()
    l: int | None = None
    l_columns: tuple[str, ...] = ()
    t: float | None = None
    t_columns: tuple[str, ...] = ()
    sensitive: str | None = None
    backups: dict[str, str] = field(default_factory=dict)

    def with_(self, **changes) -> "ReleaseInfo":
        return replace(self, **changes)
