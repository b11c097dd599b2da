"""Parsers: a file's text becomes symbols, imports and calls.

``parse`` runs them over a table of files, a batch at a time; ``REGISTRY`` maps
an extension to a parser, a function (path, text) -> Parsed, and can be added to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.parsers import braces, python
from lodestrata.sources.parsers.model import Parsed

REGISTRY: dict[str, tuple[str, Callable[[str, str], Parsed]]] = {
    ".py": ("Python", python.parse),
    ".ts": ("TypeScript", braces.script),
    ".tsx": ("TypeScript", braces.script),
    ".js": ("JavaScript", braces.script),
    ".jsx": ("JavaScript", braces.script),
    ".java": ("Java", braces.java),
    ".go": ("Go", braces.go),
    ".rs": ("Rust", braces.rust),
}

SYMBOL = "name:string,type:string,parent:string,line_start:int,line_end:int,signature:string,docstring:string,return_type:string,visibility:string,decorators:array<string>,annotations:array<string>,parameters:array<struct<name:string,type:string>>"
IMPORT = "module:string,name:string,alias:string,is_relative:boolean,line_number:int"
CALL = "caller:string,callee:string,line_number:int"
SCHEMA = f"file_path string, language string, loc int, symbols array<struct<{SYMBOL}>>, imports array<struct<{IMPORT}>>, calls array<struct<{CALL}>>, errors array<string>"


def dispatch(path: str) -> str | None:
    """The first registered extension that a path ends with."""
    return next((end for end in REGISTRY if path.endswith(end)), None)


def parse_text(path: str, text: str) -> Parsed | None:
    """Parse one file; a parser's failure becomes an error in the result."""
    end = dispatch(path)
    if end is None:
        return None
    language, parser = REGISTRY[end]
    try:
        out = parser(path, text)
    except Exception as error:  # noqa: BLE001  any failure belongs to the one file
        out = Parsed(errors=[f"{type(error).__name__}: {error}"])
    out.language, out.loc = language, sum(1 for x in text.splitlines() if x.strip())
    return out


def parse(files: DataFrame) -> DataFrame:
    """One row for each file with a parser, with nested records; columns path and content."""
    ends = F.lit(False)
    for end in REGISTRY:
        ends = ends | F.col("path").endswith(end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"], strict=True):
                p = parse_text(path, text)
                rows.append((path, p.language, p.loc, [asdict(s) for s in p.symbols], [asdict(i) for i in p.imports], [asdict(c) for c in p.calls], p.errors))
            yield pd.DataFrame(rows, columns=["file_path", "language", "loc", "symbols", "imports", "calls", "errors"])

    return files.filter(ends & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, SCHEMA)


def records(parsed: DataFrame, kind: str) -> DataFrame:
    """symbols, imports or calls as rows, with their file."""
    return parsed.select("file_path", F.explode(kind).alias("r")).select("file_path", "r.*")
