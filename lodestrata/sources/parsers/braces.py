"""TypeScript, JavaScript, Java, Go and Rust by scanners.

A scanner blanks comments and the insides of strings, then walks statements and
blocks with a stack of the blocks that are open, so every declaration knows
its owner and every call its innermost function.  That covers declarations in
their usual forms; it doesn't resolve types or macros.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from lodestrata.sources.parsers.model import Call, Import, Parsed, Symbol

_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|`(?:\\.|[^`\\])*`", re.S)
_CALL = re.compile(r"(\bnew\s+)?((?:[A-Za-z_$][\w$]*(?:\s*<[\w\s,<>.]*>(?=\())?\s*(?:\.|::|\?\.)\s*)*[A-Za-z_$][\w$]*)(!)?\s*(?:<[\w\s,<>.]*>)?\(")
#: Words before a bracket that aren't calls (fixed values).
_WORDS = frozenset("if for while switch catch return function func fn match loop else do try synchronized super this constructor new typeof await async throw case in of instanceof import export let const var impl where unsafe defer go select range struct interface enum class".split())


def blank(text: str, lifetimes: bool = False) -> str:
    """The text with comments and string contents as spaces, of the same length."""

    def gap(m: re.Match) -> str:
        said = m[0]
        if lifetimes and said[0] == "'" and len(said) > 4 and "\\" not in said:
            return said
        keep = said[0] if said[0] in "\"'`" else " "
        return keep + re.sub(r"[^\n]", " ", said[1:-1]) + (said[-1] if keep != " " else " ") if len(said) > 1 else said

    return _NOISE.sub(gap, text)


@dataclass
class Block:
    """A statement's head and the block that follows it, if there is one."""

    head: str
    at: int
    end: int
    depth: int
    body: tuple[int, int] | None
    owner: "Block | None"


def blocks(code: str) -> list[Block]:
    """All statements and blocks, each with the block around it, in order of place."""
    out: list[Block] = []
    stack: list[Block] = []
    start, depth = 0, 0

    def add(end: int, body: tuple[int, int] | None) -> Block:
        raw = code[start:end]
        at = start + len(raw) - len(raw.lstrip())
        b = Block(raw.strip(), at, end, len(stack), body, stack[-1] if stack else None)
        out.append(b)
        return b

    for m in re.finditer(r"[{};()\[\]\n]", code):
        c, i = m[0], m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "{" and not depth:
            stack.append(add(i, (i, len(code))))
            start = i + 1
        elif c == "}" and not depth:
            if code[start:i].strip():
                add(i, None)
            if stack:
                stack[-1].body = (stack[-1].body[0], i)
                stack[-1].end = i + 1
                stack.pop()
            start = i + 1
        elif c == ";" and not depth or c == "\n" and not depth and _ends(code[start:i], code[i + 1 : i + 80]):
            if code[start:i].strip():
                add(i, None)
            start = i + 1
    if code[start:].strip():
        add(len(code), None)
    return out


def _ends(said: str, after: str) -> bool:
    """Whether a line end ends a statement, where semicolons are optional."""
    said, after = said.strip(), after.lstrip()
    if not said or said.startswith("@") or said.startswith("#["):
        return False
    return not re.search(r"[=,+\-*/&|<.:(]$|\b(?:extends|implements|where|throws)$", said) and not re.match(r"[{.+*/&|?:=]|extends\b|implements\b|where\b|throws\b", after)


class Scan:
    def __init__(self, path: str, text: str, lifetimes: bool = False):
        self.path, self.text, self.code = path, text, blank(text, lifetimes)
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.blocks, self.out = blocks(self.code), Parsed()
        self.functions: list[tuple[int, int, str]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def raw(self, b: Block, end: int | None = None) -> str:
        return " ".join(self.text[b.at : b.end if end is None else end].split())

    def symbol(self, b: Block, name: str, kind: str, **more) -> Symbol:
        s = Symbol(name, kind, line_start=self.line(b.at), line_end=self.line(max(b.at, b.end - 1)), **more)
        self.out.symbols.append(s)
        return s

    def function(self, b: Block, caller: str) -> None:
        if b.body:
            self.functions.append((b.body[0], b.body[1], caller))

    def finish(self, macros: bool = False) -> Parsed:
        """Calls, by the innermost function around them."""
        for lo, hi, caller in self.functions:
            inner = [(a, z) for a, z, _ in self.functions if lo < a and z <= hi and (a, z) != (lo, hi)]
            pattern = re.compile(_CALL.pattern.replace(r"(!)?\s*", r"(!)?\s*")) if not macros else re.compile(_CALL.pattern[:-2] + r"[(\[{]")
            for m in pattern.finditer(self.code, lo, hi + 1):
                name = re.sub(r"\s+|<.*>", "", m[2])
                if name.split(".")[0].split("::")[0] in _WORDS and not m[1] and "." not in name and "::" not in name:
                    continue
                if m[0][-1] != "(" and not m[3] or any(a < m.start() < z for a, z in inner):
                    continue
                if re.search(r"\b(?:function|func|fn)\s+$", self.code[max(0, m.start() - 12) : m.start()]):
                    continue
                self.out.calls.append(Call(caller, ("new " if m[1] else "") + name + ("!" if m[3] else ""), self.line(m.start())))
        return self.out


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no bracket."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[i - 1 : i + 1] not in ("=>", "->"))
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _closing(code: str, at: int) -> int:
    """The bracket that closes the one at a place."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == "(") - (code[i] == ")")
        if depth == 0:
            return i
    return len(code) - 1


def _bases(head: str) -> list[str]:
    found = []
    for word in ("extends", "implements"):
        if m := re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bextends\b|$)", head, re.S):
            found += [f"{word} {re.sub(r'<.*>', '', x).strip()}" for x in _split(m[1])]
    return found


# ------------------------------------------------- TypeScript and JavaScript

_MODIFIER = r"(?:(?:export|default|declare|abstract|async|public|private|protected|static|readonly|override|get|set)\s+)*"
_DECORATORS = re.compile(r"\s*(@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?)\s*")


def script(path: str, text: str) -> Parsed:
    s = Scan(path, text)
    for b in s.blocks:
        head, decorators, at = b.head, [], b.at
        while m := _DECORATORS.match(s.code, at, b.at + len(b.head)):
            decorators.append(" ".join(s.text[m.start(1) : m.end(1)].split()))
            at = m.end()
        head = s.code[at : b.at + len(b.head)].strip()
        said = " ".join(s.text[at : b.at + len(b.head)].split())
        _script_import(s, b, said)
        owner = b.owner and re.search(r"\bclass\s+([\w$]+)", b.owner.head)
        visible = next((v for v in ("private", "protected") if re.match(rf"(?:\w+\s+)*{v}\b", head)), "public")
        if m := re.match(rf"{_MODIFIER}(class|interface|enum|type)\s+([\w$]+)", head):
            if m[1] == "type" and "=" not in head and not b.body:
                continue
            s.symbol(b, m[2], {"type": "type_alias"}.get(m[1], m[1]), signature=said.split("=")[0].strip(), annotations=_bases(head), decorators=decorators)
        elif m := re.match(rf"{_MODIFIER}function\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\(", head):
            _script_function(s, b, m[1], "function", None, at, visible, decorators)
        elif owner and (m := re.match(rf"{_MODIFIER}(#?[\w$]+)\s*(?:<[^(]*>)?\(", head)) and m[1] not in _WORDS - {"constructor"} and (b.body or ":" in head):
            _script_function(s, b, m[1], "method", owner[1], at, visible, decorators)
        elif owner and (m := re.match(rf"{_MODIFIER}(#?[\w$]+)\s*[?!]?\s*(?::|=|$)", head)):
            s.symbol(b, m[1], "variable", parent=owner[1], signature=said, visibility=visible, decorators=decorators)
            if b.body and "=>" in head:
                s.function(b, m[1])
        elif m := re.match(r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)[^=]*=\s*(?:async\s*)?\(?[^=]*=>$", head):
            s.function(b, m[1])
    return s.finish()


def _script_function(s: Scan, b: Block, name: str, kind: str, parent: str | None, at: int, visible: str, decorators: list[str]) -> None:
    lo = s.code.index("(", at)
    hi = _closing(s.code, lo)
    rest = " ".join(s.text[hi + 1 : b.body[0] if b.body else b.end].split()).strip()
    returns = rest[1:].strip() if rest.startswith(":") else None
    shown = " ".join(s.text[lo + 1 : hi].split())
    parameters = []
    for p in _split(shown):
        pname, _, kind_of = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)*", "", p).partition(":")
        parameters.append({"name": pname.split("=")[0].strip(" ?.").strip(), "type": kind_of.split("=")[0].strip() or None})
    s.symbol(b, name, kind, parent=parent, signature=f"{name}({shown})" + (f": {returns}" if returns else ""), return_type=returns, visibility=visible, parameters=parameters, decorators=decorators)
    s.function(b, name)


def _script_import(s: Scan, b: Block, said: str) -> None:
    owner = b
    text = " ".join(s.text[owner.at : owner.end].split()).rstrip("; ") if said.startswith(("import", "export")) or "require(" in said else ""
    if b.body and said.startswith("import"):  # the braces of a list of names
        text = " ".join(s.text[b.at : s.text.find("\n", b.end) if s.text.find("\n", b.end) > 0 else len(s.text)].split()).split(";")[0]
    if m := re.match(r"import\s+(?:type\s+)?(.*?)\s*from\s*['\"]([^'\"]+)['\"]", text):
        names, module = m[1], m[2]
        add = lambda name, alias=None: s.out.imports.append(Import(module, name, alias, module.startswith("."), s.line(b.at)))
        if g := re.search(r"\{(.*)\}", names):
            for part in _split(g[1]):
                name, _, alias = part.removeprefix("type ").partition(" as ")
                add(name.strip(), alias.strip() or None)
            names = names[: g.start()] + names[g.end() :]
        for part in _split(names):
            if g := re.match(r"\*\s+as\s+(\w+)", part):
                add("*", g[1])
            else:
                add(part, None)
    elif m := re.match(r"import\s*['\"]([^'\"]+)['\"]", text):
        s.out.imports.append(Import(m[1], None, None, m[1].startswith("."), s.line(b.at)))
    elif m := re.match(r"(?:const|let|var)\s+(.*?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]", text):
        s.out.imports.append(Import(m[2], m[1], None, m[2].startswith("."), s.line(b.at)))


# ---------------------------------------------------------------------- Java

_JAVA_MODIFIER = r"(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|sealed|strictfp|transient|volatile)\s+)*"


def java(path: str, text: str) -> Parsed:
    s = Scan(path, text)
    for b in s.blocks:
        at, decorators = b.at, []
        while (m := _DECORATORS.match(s.code, at, b.at + len(b.head))) and not m[1].startswith("@interface"):
            decorators.append(" ".join(s.text[m.start(1) : m.end(1)].split()))
            at = m.end()
        head, said = s.code[at : b.at + len(b.head)].strip(), " ".join(s.text[at : b.at + len(b.head)].split())
        if m := re.match(r"import\s+(?:static\s+)?([\w.]+?)(?:\.(\w+|\*))?$", said):
            s.out.imports.append(Import(m[1], m[2], None, False, s.line(b.at)))
            continue
        owner = b.owner and re.search(r"\b(?:class|interface|enum|record)\s+(\w+)", b.owner.head)
        visible = next((v for v in ("public", "private", "protected") if re.search(rf"\b{v}\b", head.split("(")[0])), "package")
        if m := re.match(rf"{_JAVA_MODIFIER}(class|interface|enum|record|@interface)\s+(\w+)", head):
            s.symbol(b, m[2], "interface" if "interface" in m[1] else "class", parent=owner[1] if owner else None, signature=said, visibility=visible, annotations=_bases(head), decorators=decorators)
        elif owner and (m := re.match(rf"{_JAVA_MODIFIER}(?:<[^(]*?>\s*)?([\w.<>\[\],\s?]*?)\s*\b(\w+)\s*\(", head)) and m[2] not in _WORDS and "=" not in head.split("(")[0]:
            lo = s.code.index("(", at)
            shown = " ".join(s.text[lo + 1 : _closing(s.code, lo)].split())
            returns = m[1].strip() or None
            parameters = [{"name": p.split()[-1], "type": " ".join(x for x in p.split()[:-1] if not x.startswith("@") and x != "final") or None} for p in _split(shown)]
            s.symbol(b, m[2], "method", parent=owner[1], signature=f"{returns + ' ' if returns else ''}{m[2]}({shown})", return_type=returns, visibility=visible, parameters=parameters, decorators=decorators)
            s.function(b, m[2])
        elif owner and not b.body and (m := re.match(rf"{_JAVA_MODIFIER}([\w.<>\[\],\s?]+?)\s+(\w+)\s*(?:=|$)", head)) and m[1] not in ("return", "throw", "package"):
            s.symbol(b, m[2], "variable", parent=owner[1], signature=said, return_type=m[1], visibility=visible, decorators=decorators)
    return s.finish()


# ------------------------------------------------------------------------ Go


def go(path: str, text: str) -> Parsed:
    s = Scan(path, text)
    seen = lambda n: "public" if n[:1].isupper() else "private"
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n]+))", s.text, re.M):
        for g in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", m[1] or m[2]):
            s.out.imports.append(Import(g[2], None, g[1], g[2].startswith("."), s.line(m.start() + (g.start() if not m[1] else m.start(1) - m.start() + g.start()))))
    for b in s.blocks:
        head, said = b.head, s.raw(b, b.at + len(b.head))
        if m := re.match(r"func\s*(?:\(\s*(?:\w+\s+)?\*?([\w]+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", head):
            lo = m.end() - 1
            hi = _closing(head, lo)
            names = [{"name": p.split()[0], "type": " ".join(p.split()[1:]) or None} for p in _split(" ".join(head[lo + 1 : hi].split()))]
            returns = head[hi + 1 :].strip() or None
            s.symbol(b, m[2], "method" if m[1] else "function", parent=m[1], signature=said, return_type=returns, visibility=seen(m[2]), parameters=names)
            s.function(b, f"{m[1]}.{m[2]}" if m[1] else m[2])
        elif m := re.match(r"type\s+(\w+)(?:\[[^\]]*\])?\s*(struct|interface)?", head):
            s.symbol(b, m[1], "interface" if m[2] == "interface" else "class", signature=said, visibility=seen(m[1]))
    return s.finish()


# ---------------------------------------------------------------------- Rust


def rust(path: str, text: str) -> Parsed:
    s = Scan(path, text, lifetimes=True)
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s.code, re.M):
        said = " ".join(s.text[m.start(1) : m.end(1)].split())
        name, _, alias = said.partition(" as ")
        s.out.imports.append(Import(name, None if "{" in name else name.split("::")[-1], alias or None, name.startswith(("self::", "super::", "crate::")), s.line(m.start(1))))
    for b in s.blocks:
        head = re.sub(r"^(?:#!?\[[^\]]*\]\s*)+", "", b.head)
        said = re.sub(r"^(?:#!?\[[^\]]*\]\s*)+", "", s.raw(b, b.at + len(b.head)))
        visible = "public" if head.startswith("pub") else "private"
        head = re.sub(r"^pub(?:\([^)]*\))?\s+", "", head)
        if m := re.match(r"(struct|enum|trait|union)\s+(\w+)", head):
            s.symbol(b, m[2], "interface" if m[1] == "trait" else "class", signature=said, visibility=visible)
        elif m := re.match(r"type\s+(\w+)", head):
            s.symbol(b, m[1], "type_alias", signature=said, visibility=visible)
        elif m := re.match(r"(?:(?:const|async|unsafe|extern\s+\S+)\s+)*fn\s+(\w+)\s*(?:<[^(]*>)?\(", head):
            owner = b.owner and re.match(r"(?:unsafe\s+)?(?:impl(?:<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?(\w+)|(?:pub\s+)?trait\s+(\w+))", b.owner.head)
            parent, lo = (owner[2] or owner[3]) if owner else None, m.end() - 1
            hi = _closing(head, lo)
            returns = re.search(r"->\s*(.*?)(?:\s+where\b.*)?$", head[hi + 1 :], re.S)
            names = [{"name": p.partition(":")[0].strip().removeprefix("mut "), "type": p.partition(":")[2].strip() or None} for p in _split(" ".join(head[lo + 1 : hi].split())) if "self" not in p.split(":")[0]]
            s.symbol(b, m[1], "method" if parent else "function", parent=parent, signature=said, return_type=returns[1].strip() if returns else None, visibility=visible, parameters=names, annotations=[f"implements {owner[1]}"] if owner and owner[1] else [])
            s.function(b, f"{parent}::{m[1]}" if parent else m[1])
    return s.finish(macros=True)
