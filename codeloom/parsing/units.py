"""Semantic units of a source text: types, functions, methods, globals and blocks of local declarations."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .outline import C, JAVA, Node, parse

# Node types by role.
TYPES = {
    C: {"class_specifier", "struct_specifier", "enum_specifier", "union_specifier", "labeled_statement"},
    JAVA: {"class_declaration", "interface_declaration", "enum_declaration", "annotation_type_declaration", "record_declaration"},
}
FUNCTIONS = {C: {"function_definition"}, JAVA: {"method_declaration", "constructor_declaration"}}
GLOBALS = {C: {"declaration", "type_definition", "alias_declaration", "preproc_def", "preproc_function_def"}, JAVA: {"field_declaration"}}
BODIES = {"field_declaration_list", "enumerator_list"}
BLOCKED = {"compound_statement", "for_statement", "if_statement", "while_statement", "switch_statement", "case_statement", "do_statement", "labeled_statement"}
LOCALS = {(C, "function"): {"declaration", "type_definition", "alias_declaration"}, (JAVA, "method"): {"local_variable_declaration"}}
LOCALS[(C, "method")] = LOCALS[(C, "function")]
COMMENT_STARTS = ("//", "/*", "* ", "*/")
#: Blank lines that may part comments above a unit.
COMMENT_GAP = 2


@dataclass
class Unit:
    kind: str
    node_type: str
    symbol_name: str
    qualified_name: str
    parent_qualified_name: str | None
    start_line: int
    end_line: int
    text: str
    start: int
    end: int
    node: Node | None


class _Extractor:
    def __init__(self, source: str, language: str, min_lines: int):
        self.source, self.language, self.min_lines = source, language, min_lines
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.units: list[Unit] = []

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def line_text(self, k: int) -> str:
        return self.source[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.source)]

    def visit(self, node: Node, scopes: list[tuple[str, str]], blocked: bool, span: tuple[int, int] | None = None) -> None:
        if node.type == "template_declaration":
            whole = span or (node.start, node.end)
            roles = TYPES[self.language] | FUNCTIONS[self.language] | GLOBALS[self.language] | {"template_declaration"}
            inner = next((c for c in node.children if c.type in roles), None)
            if inner is not None:
                self.visit(inner, scopes, blocked, whole)
                return
        if node.type == "namespace_definition":
            inside = scopes + [("namespace", n) for n in node.names]
            for c in node.children:
                self.visit(c, inside, blocked)
            return
        kind = self.kind(node, scopes, blocked)
        inside = scopes
        if kind:
            unit = self.unit(node, kind, scopes, span)
            if unit:
                self.units.append(unit)
                if kind in ("function", "method"):
                    self.local_blocks(node, unit)
                if kind != "global":
                    inside = [*scopes, (kind, unit.symbol_name)]
        deeper = blocked or node.type in BLOCKED or node.type in FUNCTIONS[self.language] or node.type in TYPES[self.language]
        for c in node.children:
            if c.named and c.children or c.type.startswith("preproc_"):
                self.visit(c, inside, deeper)

    def kind(self, node: Node, scopes: list[tuple[str, str]], blocked: bool) -> str | None:
        in_type = any(k == "type" for k, _ in scopes)
        if node.type in TYPES[self.language]:
            if self.language == C and not any(c.type in BODIES for c in node.children):
                return None
            return "type"
        if node.type in FUNCTIONS[self.language]:
            return "method" if in_type else "function"
        if node.type in GLOBALS[self.language]:
            if self.language == JAVA:
                return "global"
            executable = any(k in ("type", "function", "method") for k, _ in scopes)
            return None if executable or blocked else "global"
        return None

    def unit(self, node: Node, kind: str, scopes: list[tuple[str, str]], span: tuple[int, int] | None) -> Unit | None:
        name = ",".join(dict.fromkeys(n for n in node.names if n))
        if not name:
            return None
        start, end = span or (node.start, node.end)
        end = max(end, node.end)
        if kind == "type" and self.language == C:
            end = self.past_semicolon(end)
        found = self.placed(start, end, kind, comments=True)
        if found is None:
            return None
        parent = "::".join(n for _, n in scopes) or None
        own = f"global::{name}" if kind == "global" else name
        return Unit(kind, node.type, name, f"{parent}::{own}" if parent else own, parent, *found[:3], found[3], found[4], node)

    def local_blocks(self, node: Node, unit: Unit) -> None:
        wanted = LOCALS.get((self.language, unit.kind))
        body = next((c for c in node.children if c.type in ("compound_statement", "block")), None)
        if not wanted or body is None:
            return
        runs: list[list[Node]] = [[]]
        for c in body.children:
            if not c.named or c.type == "comment" or c.type.startswith("preproc_"):
                continue
            if c.type in wanted:
                runs[-1].append(c)
            elif runs[-1]:
                runs.append([])
        for k, run in enumerate((r for r in runs if r), 1):
            found = self.placed(run[0].start, run[-1].end, "declaration_block", comments=False, count=len(run))
            if found:
                name = f"declblock#{k}"
                self.units.append(Unit("declaration_block", "declaration_block", name, f"{unit.qualified_name}::{name}", unit.qualified_name, *found[:3], found[3], found[4], None))

    def past_semicolon(self, end: int) -> int:
        """Past a semicolon that only white space and comments part from end."""
        m = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*;", re.S).match(self.source, end)
        return m.end() if m else end

    def placed(self, start: int, end: int, kind: str, comments: bool, count: int = 1) -> tuple[int, int, str, int, int] | None:
        """(start line, end line, text, start, end) of whole lines, with the comments above; None if too short to keep."""
        low, high = self.line(start), self.line(max(start, end - 1))
        if comments:
            low = self.with_comments(low)
        while low < high and not self.line_text(low).strip():
            low += 1
        while high > low and not self.line_text(high).strip():
            high -= 1
        a = self.starts[low]
        b = self.starts[high + 1] if high + 1 < len(self.starts) else len(self.source)
        text = self.source[a:b].rstrip(" \t\r\n")
        n = len(text.splitlines())
        if kind == "declaration_block":
            keep = count > 1 or sum(bool(x.strip()) for x in text.splitlines()) > 1
        else:
            keep = n > self.min_lines
        if not text or not keep:
            return None
        return low + 1, low + max(n, 1), text, a, a + len(text)

    def with_comments(self, low: int) -> int:
        """The first line of the comments that stand directly above line low."""
        is_comment = lambda k: self.line_text(k).strip().startswith(COMMENT_STARTS[:2]) or (self.line_text(k).strip() + "\n").startswith(COMMENT_STARTS[2:]) or self.line_text(k).strip().startswith("* ")
        if low == 0 or not is_comment(low - 1):
            return low
        top, k, gap = low, low - 1, 0
        while k >= 0:
            if is_comment(k):
                top, gap = k, 0
            elif not self.line_text(k).strip() and gap < COMMENT_GAP:
                gap += 1
            else:
                break
            k -= 1
        return top


def units_of(source: str | None, language: str | None, min_lines: int = 0) -> list[Unit]:
    """Units by place, outer ones first; none for blank texts and unknown languages."""
    if not source or not source.strip() or language not in (C, JAVA):
        return []
    x = _Extractor(source, language, min_lines)
    x.visit(parse(source, language)[0], [], False)
    return sorted(x.units, key=lambda u: (u.start, -u.end, u.qualified_name))
