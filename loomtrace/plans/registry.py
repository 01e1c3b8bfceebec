"""The modules of core queries: each has ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from types import ModuleType

from . import dag, detect, files, flow, p1, p6, program, streams, traces


def modules() -> list[ModuleType]:
    return [p1, p6, traces, flow, dag, program, files, streams, detect]
