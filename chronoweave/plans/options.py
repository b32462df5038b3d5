"""What a request may ask for."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Options:
    """Options of one job; ``sound`` overrides sound settings where its values are not None.

    ``response_format`` is ``text`` for plain text; anything else means JSON.
    """

    language: str | None = None
    align: bool = False
    diarize: bool = False
    sound_events: bool = False
    sound: dict[str, Any] = field(default_factory=dict)
    debug_top_n: int = 0
    response_format: str = "verbose_json"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Options:
        """Unknown keys are left out; a blank language, or ``auto``, is none."""
        own = {f.name: data[f.name] for f in fields(cls) if data.get(f.name) is not None}
        name = str(own.get("language") or "").strip()
        own["language"] = None if name.lower() in ("", "auto") else name
        return cls(**own)


def overridden(defaults: dict[str, Any], overrides: dict[str, Any] | None) -> dict[str, Any]:
    """``defaults`` with the known, non-null values of ``overrides``."""
    return defaults | {k: v for k, v in (overrides or {}).items() if k in defaults and v is not None}
