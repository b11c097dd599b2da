"""Records that parsers make."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    type: str
    parent: str | None = None
    line_start: int = 0
    line_end: int = 0
    signature: str | None = None
    docstring: str | None = None
    return_type: str | None = None
    visibility: str = "public"
    decorators: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)


@dataclass
class Import:
    module: str
    name: str | None = None
    alias: str | None = None
    is_relative: bool = False
    line_number: int = 0


@dataclass
class Call:
    caller: str
    callee: str
    line_number: int = 0


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    language: str = ""
    loc: int = 0
