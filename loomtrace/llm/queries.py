"""The modules of this subpackage's queries: each has ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from types import ModuleType

from . import q2, q3, q4, q5, q7, q8, q9


def modules() -> list[ModuleType]:
    return [q2, q3, q4, q5, q7, q8, q9]
