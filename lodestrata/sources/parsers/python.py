"""Python by the standard library's syntax trees."""

from __future__ import annotations

import ast

from lodestrata.sources.parsers.model import Call, Import, Parsed, Symbol


class _Visitor(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.out = text, Parsed()
        self.classes: list[str] = []
        self.functions: list[str] = []

    def said(self, node: ast.AST | None) -> str | None:
        return None if node is None else " ".join((ast.get_source_segment(self.text, node) or ast.unparse(node)).split())

    def visibility(self, name: str) -> str:
        return "private" if name.startswith("_") and not name.endswith("__") else "public"

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.out.symbols.append(Symbol(node.name, "class", self.classes[-1] if self.classes else None, node.lineno, node.end_lineno, f"class {node.name}", ast.get_docstring(node), None, self.visibility(node.name), [self.said(d) for d in node.decorator_list], [f"extends {self.said(b)}" for b in node.bases]))
        outer, self.functions = self.functions, []
        self.classes.append(node.name)
        for child in node.body:
            if isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name):
                self.variable(child.target.id, child, f"{self.said(child.annotation)}" + (f" = {self.said(child.value)}" if child.value else ""))
            elif isinstance(child, ast.Assign) and isinstance(child.targets[0], ast.Name):
                self.variable(child.targets[0].id, child, self.said(child.value))
            self.visit(child)
        self.classes.pop()
        self.functions = outer

    def variable(self, name: str, node: ast.stmt, signature: str | None) -> None:
        self.out.symbols.append(Symbol(name, "variable", self.classes[-1], node.lineno, node.end_lineno, signature, visibility=self.visibility(name)))

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        given = [*[p for p in plain], *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        defaults = dict(zip([p.arg for p in plain[len(plain) - len(a.defaults) :]], a.defaults, strict=False)) | {p.arg: d for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None}
        shown = []
        for p in given:
            mark = "*" if p is a.vararg else "**" if p is a.kwarg else ""
            value = self.said(defaults.get(p.arg))
            kind = self.said(p.annotation)
            shown.append(mark + p.arg + (f": {kind}" if kind else "") + ((f" = {value}" if kind else f"={value}") if value is not None else ""))
        returns = self.said(node.returns)
        inside = bool(self.classes) and not self.functions
        self.out.symbols.append(Symbol(node.name, "method" if inside else "function", self.classes[-1] if inside else None, node.lineno, node.end_lineno, f"{node.name}({', '.join(shown)})" + (f" -> {returns}" if returns else ""), ast.get_docstring(node), returns, self.visibility(node.name), [self.said(d) for d in node.decorator_list], [], [{"name": p.arg, "type": self.said(p.annotation)} for p in given if p.arg not in ("self", "cls")]))
        self.functions.append(node.name)
        for child in node.body:
            self.visit(child)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        self.out.imports += [Import(x.name, None, x.asname, False, node.lineno) for x in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.out.imports += [Import(module, x.name, x.asname, node.level > 0, node.lineno) for x in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        if self.functions:
            self.out.calls.append(Call(self.functions[-1], self.said(node.func), node.lineno))
        self.generic_visit(node)


def parse(path: str, text: str) -> Parsed:
    visitor = _Visitor(text)
    visitor.visit(ast.parse(text, path))
    return visitor.out
