"""An outline parser for C, C++ and Java.

It knows declarations, types, functions, namespaces, templates and statements, and nests everything else by brackets. Broken code never fails: stray
closers become ERROR nodes and open brackets end with the file. Node types follow the customary names of concrete syntax trees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

C, JAVA = "C", "Java"

_TOKEN = re.compile(
    r"""(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))
    |(?P<text>\"\"\".*?(?:\"\"\"|\Z))
    |(?P<raw>(?:u8|[uUL])?R"(?P<delim>[^()\\\s]{0,16})\(.*?(?:\)(?P=delim)"|\Z))
    |(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?)
    |(?P<char>[uUL]?'(?:\\.|[^'\\\n])*'?)
    |(?P<directive>(?:(?<=\n)|(?<![^\n])|\A)[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*)
    |(?P<number>\.?[0-9](?:[eEpP][+-]|['A-Za-z0-9_.])*)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<op>::|->\*?|\.\.\.|\+\+|--|&&|\|\||[-+*/%&|^=!<]=|<<=?|[^\s])""",
    re.S | re.X,
)
_DEFINE = re.compile(r"[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\(?)")
OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
PRIMITIVES = {"void", "bool", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "auto", "size_t", "wchar_t", "byte", "boolean", "var"}
QUALIFIERS = {
    "static", "extern", "const", "volatile", "register", "inline", "constexpr", "mutable", "virtual", "explicit", "friend", "restrict", "thread_local", "typename", "local",
    "public", "private", "protected", "final", "abstract", "synchronized", "transient", "native", "default", "strictfp", "sealed",
}
CONTROL = {"if", "for", "while", "switch", "do", "else", "try", "catch", "finally", "synchronized"}
JUMPS = {"return", "goto", "break", "continue", "throw", "delete", "co_return", "assert", "yield"}
TYPE_WORDS = {C: {"class": "class_specifier", "struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier"}}
TYPE_WORDS[JAVA] = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
_KNOWN = {language: QUALIFIERS | CONTROL | JUMPS | words.keys() for language, words in TYPE_WORDS.items()}
_LEAVES = {"comment": "comment", "string": "string_literal", "raw": "raw_string_literal", "text": "string_literal", "char": "char_literal", "number": "number_literal", "directive": "preproc_call"}
_GROUPS = {"(": "argument_list", "[": "subscript_argument_list", "{": "initializer_list"}
_AFTER_PARAMETERS = {"const", "noexcept", "override", "final", "volatile", "throw", "throws", "mutable"}


@dataclass(slots=True)
class Node:
    type: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    named: bool = True


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens_of(source: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup if m.lastgroup != "delim" else "raw"
        out.append(Token(kind, m[0], *m.span()))
    return out


class _Parser:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.toks = tokens_of(source)
        self.i = 0
        self.errors = 0

    # tokens

    def peek(self, k: int = 0) -> Token | None:
        """The k-th token from here that is no comment."""
        j = self.i
        while j < len(self.toks):
            if self.toks[j].kind != "comment":
                if not k:
                    return self.toks[j]
                k -= 1
            j += 1
        return None

    def text(self, k: int = 0) -> str:
        t = self.peek(k)
        return t.text if t else ""

    def skip_group(self, j: int) -> int:
        """Past the bracket group that opens at j."""
        depth: list[str] = []
        while j < len(self.toks):
            t = self.toks[j]
            if t.kind == "op" and t.text in OPENERS:
                depth.append(OPENERS[t.text])
            elif t.kind == "op" and t.text in CLOSERS:
                if t.text in depth:
                    while depth.pop() != t.text:
                        self.errors += 1
                    if not depth:
                        return j + 1
                else:
                    self.errors += 1
            j += 1
        self.errors += 1
        return j

    def leaf(self, t: Token) -> Node:
        if t.kind == "word":
            if t.text in PRIMITIVES:
                return Node("primitive_type", t.start, t.end)
            return Node(t.text, t.start, t.end, named=False) if t.text in _KNOWN[self.language] else Node("identifier", t.start, t.end)
        if t.kind in _LEAVES:
            return Node(_LEAVES[t.kind], t.start, t.end)
        return Node(t.text, t.start, t.end, named=False)

    def flat(self, a: int, b: int) -> list[Node]:
        """Tokens a to b as leaves, bracket groups nested."""
        out: list[Node] = []
        stack: list[tuple[Node, str, list[Node]]] = []
        for t in self.toks[a:b]:
            n = self.leaf(t)
            if t.kind == "op" and t.text in OPENERS:
                group = Node(_GROUPS[t.text], t.start, t.end, [n])
                out.append(group)
                stack.append((group, OPENERS[t.text], out))
                out = group.children
            elif t.kind == "op" and t.text in CLOSERS and stack and stack[-1][1] == t.text:
                out.append(n)
                group, _, out = stack.pop()
                group.end = t.end
            else:
                out.append(n)
        while stack:
            group, _, up = stack.pop()
            group.end = group.children[-1].end
            out = up
        return out

    # structure

    def file(self) -> Node:
        root = Node("translation_unit" if self.language == C else "program", 0, len(self.source))
        while self.i < len(self.toks):
            self.item(root.children, "file")
        return root

    def block(self, kind: str, context: str) -> Node:
        t = self.toks[self.i]
        node = Node(kind, t.start, t.end, [self.leaf(t)])
        self.i += 1
        while self.i < len(self.toks):
            t = self.toks[self.i]
            if t.kind == "op" and t.text == "}":
                node.children.append(self.leaf(t))
                node.end = t.end
                self.i += 1
                return node
            self.item(node.children, context)
            node.end = max(node.end, node.children[-1].end) if node.children else node.end
        self.errors += 1
        return node

    def item(self, out: list[Node], context: str) -> None:
        t = self.toks[self.i]
        if t.kind == "comment":
            out.append(self.leaf(t))
            self.i += 1
        elif t.kind == "directive":
            out.append(self.directive(t))
            self.i += 1
        elif t.kind == "op" and t.text in CLOSERS:
            self.errors += 1
            out.append(Node("ERROR", t.start, t.end, [self.leaf(t)]))
            self.i += 1
        elif t.text == ";":
            out.append(self.leaf(t))
            self.i += 1
        elif t.text == "{":
            out.append(self.block("compound_statement" if self.language == C else "block", "block"))
        elif t.text == "namespace" and self.language == C:
            self.namespace(out)
        elif t.text == "template" and self.language == C and self.text(1) == "<":
            self.template(out, context)
        elif t.text == "extern" and self.language == C and self.peek(1) and self.peek(1).kind == "string" and self.text(2) == "{":
            node = Node("linkage_specification", t.start, t.end)
            while self.toks[self.i].text != "{":
                node.children.append(self.leaf(self.toks[self.i]))
                self.i += 1
            node.children.append(self.block("declaration_list", context))
            node.end = node.children[-1].end
            out.append(node)
        elif context == "type" and self.language == C and t.text in ("public", "private", "protected", "signals", "slots") and ":" in (self.text(1), self.text(2)) and self.text(1) != "::":
            while self.toks[self.i].text != ":":
                self.i += 1
            self.i += 1
            out.append(Node("access_specifier", t.start, self.toks[self.i - 1].end))
        elif t.text in ("case", "default") and context != "type" and t.kind == "word" and (t.text == "case" or self.text(1) in (":", "-")):
            a = self.i
            while self.i < len(self.toks) and self.toks[self.i].text not in (":", ";", "{", "}"):
                self.i = self.skip_group(self.i) if self.toks[self.i].text in ("(", "[") else self.i + 1
            self.i = min(self.i + (self.i < len(self.toks) and self.toks[self.i].text == ":"), len(self.toks))
            self.i = max(self.i, a + 1)
            out.append(Node("case_statement", t.start, self.toks[self.i - 1].end, self.flat(a, self.i)))
        elif t.text in CONTROL and t.kind == "word" and (t.text != "synchronized" or self.text(1) == "("):
            self.control(out)
        elif not self.unclosed_function(out):
            self.declaration(out, context)

    def unclosed_function(self, out: list[Node]) -> bool:
        """Type words, a name and an opening bracket that a body follows at once: a function whose parameters were lost. It begins at its type."""
        k, toks = self.i, self.toks
        while k < len(toks) and (toks[k].kind == "word" or toks[k].text in ("*", "&", "::")):
            k += 1
        if self.language != C or k - self.i < 2 or [t.text for t in toks[k : k + 2]] != ["(", "{"] or toks[k - 1].kind != "word" or toks[self.i].text in JUMPS or toks[k - 1].text in CONTROL:
            return False
        body = self.closing(k + 1)
        if body < len(toks) and toks[body].text == ")" or body - k <= 3:  # an initialiser in braces; an empty body
            return False
        a, self.errors = self.i, self.errors + 1
        declarator = Node("function_declarator", toks[k - 1].start, toks[k].end, [self.leaf(toks[k - 1]), self.leaf(toks[k])])
        node = Node("function_definition", toks[a].start, toks[a].end, [*self.flat(a, k - 1), declarator], names=[toks[k - 1].text])
        self.i = k + 1
        node.children.append(self.block("compound_statement", "block"))
        node.end = node.children[-1].end
        out.append(node)
        return True

    def directive(self, t: Token) -> Node:
        m = _DEFINE.match(t.text)
        lead = len(t.text) - len(t.text.lstrip(" \t"))
        if m:
            return Node("preproc_function_def" if m[2] else "preproc_def", t.start + lead, t.end, names=[m[1]])
        word = re.match(r"\s*#\s*(\w*)", t.text)
        kind = {"include": "preproc_include", "if": "preproc_if", "ifdef": "preproc_ifdef", "ifndef": "preproc_ifdef"}
        return Node(kind.get(word[1] if word else "", "preproc_call"), t.start + lead, t.end)

    def namespace(self, out: list[Node]) -> None:
        a = self.i
        while self.i < len(self.toks) and self.toks[self.i].text not in ("{", ";", "}"):
            self.i += 1
        head = self.toks[a : self.i]
        if self.i < len(self.toks) and self.toks[self.i].text == "{":
            names = [x.text for x in head[1:] if x.kind == "word" and x.text != "inline"]
            node = Node("namespace_definition", head[0].start, head[-1].end, [self.leaf(x) for x in head], names=["::".join(names)] if names else [])
            node.children.append(self.block("declaration_list", "file"))
            node.end = node.children[-1].end
            out.append(node)
        else:
            self.i = min(self.i + 1, len(self.toks))
            out.append(Node("namespace_alias_definition", head[0].start, self.toks[self.i - 1].end, self.flat(a, self.i)))

    def template(self, out: list[Node], context: str) -> None:
        t = self.toks[self.i]
        a, depth = self.i, 0
        while self.i < len(self.toks):
            x = self.toks[self.i].text
            depth += (x == "<") - (x == ">")
            if x in ("{", ";"):
                break
            self.i = self.skip_group(self.i) if x == "(" else self.i + 1
            if depth == 0 and self.i > a + 1:
                break
        node = Node("template_declaration", t.start, self.toks[self.i - 1].end, [Node("template_parameter_list", t.start, self.toks[self.i - 1].end, self.flat(a + 1, self.i))])
        while self.i < len(self.toks) and self.toks[self.i].kind == "comment":
            node.children.append(self.leaf(self.toks[self.i]))
            self.i += 1
        if self.i < len(self.toks):
            self.item(node.children, context)
            node.end = node.children[-1].end
        out.append(node)

    def control(self, out: list[Node]) -> None:
        t = self.toks[self.i]
        node = Node({"else": "else_clause"}.get(t.text, f"{t.text}_statement"), t.start, t.end, [self.leaf(t)])
        self.i += 1
        if t.text in ("if", "for", "while", "switch", "catch", "synchronized", "try") and self.i < len(self.toks):
            while self.i < len(self.toks) and self.toks[self.i].kind == "word" and self.toks[self.i].text == "constexpr":
                self.i += 1
            if self.i < len(self.toks) and self.toks[self.i].text == "(":
                a = self.i
                self.i = self.skip_group(a)
                node.children += self.flat(a, self.i)
        while self.i < len(self.toks) and self.toks[self.i].kind == "comment":
            node.children.append(self.leaf(self.toks[self.i]))
            self.i += 1
        if self.i < len(self.toks) and self.toks[self.i].text != "}":
            self.item(node.children, "block")
        node.end = node.children[-1].end
        out.append(node)

    # declarations and statements

    def head(self) -> tuple[int, list[int], int | None, int | None]:
        """From here: the place of the first ; { or } outside brackets, the places of ( groups, of the first = and of the first single :."""
        j, parens, equals, colon = self.i, [], None, None
        while j < len(self.toks):
            t = self.toks[j]
            if t.kind == "directive":
                break
            if t.kind == "op":
                if t.text in (";", "}"):
                    break
                if t.text == "{":
                    if equals is None:
                        break
                    j = self.skip_group(j)
                    continue
                if t.text in ("(", "["):
                    if t.text == "(" and equals is None and not self.operator_before(j):
                        parens.append(j)
                    j = self.skip_group(j)
                    continue
                if t.text == ":" and equals is None and colon is None:
                    colon = j
                if t.text == "=" and equals is None and not self.operator_before(j + 1):
                    equals = j
            j += 1
        return j, parens, equals, colon

    def operator_before(self, j: int) -> bool:
        """Whether `operator` stands right before place j, as in operator()() and operator=()."""
        return j > 0 and self.toks[j - 1].text == "operator" or j > 1 and self.toks[j - 2].text == "operator" and self.toks[j - 1].kind == "op" and self.toks[j - 1].text not in (")", "(")

    def words(self, a: int, b: int) -> list[Token]:
        return [t for t in self.toks[a:b] if t.kind != "comment"]

    def through_semicolon(self, a: int, j: int) -> int:
        """Past the ; that ends what reaches from a to j, brace groups on the way included."""
        while j < len(self.toks):
            t = self.toks[j].text
            if t == ";":
                return j + 1
            if t == "}" or self.toks[j].kind == "directive":
                return max(j, a + 1)
            j = self.skip_group(j) if t in OPENERS else j + 1
        return j

    def declaration(self, out: list[Node], context: str) -> None:
        a = self.i
        start = self.toks[a].start
        j, parens, equals, colon = self.head()
        stop = self.toks[j].text if j < len(self.toks) and self.toks[j].kind == "op" else ""
        first = self.toks[a].text
        if first in JUMPS and first not in ("yield",):
            self.plain(out, a, j, f"{first}_statement")
            return
        kinds = TYPE_WORDS[self.language]
        at = next((k for k in range(a, j) if self.toks[k].kind == "word" and self.toks[k].text in kinds and (equals is None or k < equals) and not any(p < k < self.closing(p) for p in parens)), None)
        if self.language == JAVA and at is not None and self.toks[at].text == "record" and not (at + 1 < j and self.toks[at + 1].kind == "word"):
            at = None
        if at is not None and self.type_head(at, j, parens, stop, equals):
            self.type_definition(out, context, a, at, j, colon)
            return
        if first == "typedef":
            self.plain(out, a, j, "type_definition")
            return
        if first == "using" and self.language == C:
            self.plain(out, a, j, "alias_declaration" if equals is not None else "using_declaration")
            return
        if at is not None and stop == ";" and not parens and equals is None and len(self.words(at, j)) <= 2 and self.language == C:
            end = self.toks[j - 1].end
            out.append(Node(kinds[self.toks[at].text], start, end, self.flat(a, j)))  # a type that is only announced
            self.i = j
            return
        if stop == "{" and parens and context != "block" and self.function(out, context, a, j, parens):
            return
        if stop == "{" and colon is not None and self.language == C and context == "file" and self.labelled_type(out, a, j, colon):
            return
        if stop == "{" and self.language == JAVA and context == "type" and not parens:
            self.i = j
            out.append(Node("static_initializer", start, start, self.flat(a, j) + [self.block("block", "block")]))
            out[-1].end = out[-1].children[-1].end
            return
        if stop == "{" and context == "block" and not self.looks_declared(a, j):
            node = Node("expression_statement", start, start, self.flat(a, j))
            self.i = j
            node.children.append(self.block("compound_statement" if self.language == C else "block", "block"))
            node.end = node.children[-1].end
            out.append(node)
            return
        if colon is not None and context == "block" and colon == a + 1 and self.toks[a].kind == "word":
            out.append(Node("labeled_statement", start, self.toks[colon].end, self.flat(a, colon + 1)))
            self.i = colon + 1
            return
        self.plain(out, a, j, self.statement_kind(context, a, j, parens, equals))

    def closing(self, p: int) -> int:
        kept = self.errors
        j = self.skip_group(p)
        self.errors = kept
        return j

    def type_head(self, at: int, j: int, parens: list[int], stop: str, equals: int | None) -> bool:
        if stop != "{" or equals is not None:
            return False
        later = [p for p in parens if p > at]
        if not later or self.language == JAVA:
            return True
        after = self.words(self.closing(later[-1]), j)
        return bool(after) and any(t.kind == "word" and t.text not in _AFTER_PARAMETERS for t in after[:1])

    def type_name(self, at: int, j: int) -> str | None:
        """The last word before a template argument list, a base clause or the body."""
        name, depth, k = None, 0, at + 1
        while k < j:
            t = self.toks[k]
            if t.kind == "op":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                elif t.text in OPENERS:
                    k = self.closing(k)
                    continue
                elif t.text == ":" and depth == 0:
                    break
            elif t.kind == "word" and depth == 0:
                if t.text in ("extends", "implements", "permits"):
                    break
                if t.text not in ("final", "class", "struct") and t.text not in PRIMITIVES:
                    name = t.text
            k += 1
        return name

    def type_definition(self, out: list[Node], context: str, a: int, at: int, j: int, colon: int | None) -> None:
        word = self.toks[at].text
        kind = TYPE_WORDS[self.language][word]
        if self.language == JAVA and at > a and self.toks[at - 1].text == "@":
            kind = "annotation_type_declaration"
        name = self.type_name(at, j)
        begin = a if self.language == JAVA else at
        node = Node(kind, self.toks[begin].start, self.toks[j - 1].end, self.flat(begin, j), names=[name] if name else [])
        self.i = j
        if self.language == C and word == "enum":
            end = self.skip_group(j)
            group = self.flat(j, end)[0]
            group.type = "enumerator_list"
            node.children.append(group)
            self.i = end
        elif self.language == JAVA:
            body = {"enum": "enum_body", "interface": "interface_body"}.get(word, "class_body")
            if word == "enum":
                self.enum_constants(node)
            node.children.append(self.block(body, "type") if word != "enum" else self.rest_of_enum(node))
        else:
            node.children.append(self.block("field_declaration_list", "type"))
        node.end = node.children[-1].end
        typedef = any(t.text == "typedef" for t in self.toks[a:at])
        if self.language == JAVA or not typedef and (self.i >= len(self.toks) or self.text() == ";" or context != "block" and not self.declarators_follow()):
            out.append(node)
            return
        b = self.i
        end = self.through_semicolon(a, b)
        kind = "type_definition" if typedef else "field_declaration" if context == "type" else "declaration"
        whole = Node(kind, self.toks[a].start, self.toks[end - 1].end, self.flat(a, at) + [node] + self.flat(b, end))
        whole.names = self.declared(b, end, typed=False)
        if typedef:
            whole.names = node.names[:1] or whole.names[:1]
        out.append(whole)
        self.i = end

    def declarators_follow(self) -> bool:
        j, *_ = self.head()
        return j < len(self.toks) and self.toks[j].text == ";" and j > self.i and "\n\n" not in self.source[self.toks[self.i - 1].end : self.toks[self.i].start]

    def enum_constants(self, node: Node) -> None:
        t = self.toks[self.i]
        a = self.i
        node.children.append(self.leaf(t))
        j = a + 1
        while j < len(self.toks) and self.toks[j].text not in (";", "}"):
            j = self.skip_group(j) if self.toks[j].text in OPENERS else j + 1
        node.children += self.flat(a + 1, j)
        self.i = j

    def rest_of_enum(self, node: Node) -> Node:
        t = self.toks[min(self.i, len(self.toks) - 1)]
        body = Node("enum_body", t.start, t.end)
        while self.i < len(self.toks):
            t = self.toks[self.i]
            if t.text == "}" and t.kind == "op":
                body.children.append(self.leaf(t))
                self.i += 1
                break
            self.item(body.children, "type")
        body.end = body.children[-1].end if body.children else t.end
        return body

    def function(self, out: list[Node], context: str, a: int, j: int, parens: list[int]) -> bool:
        p = next((p for p in parens if p > a and (self.toks[p - 1].kind in ("word", "comment") or self.operator_name(p) or self.toks[p - 1].text == ">")), None)
        if p is None:
            return False
        name = self.callable_name(a, p)
        if name is None or name in CONTROL or name in JUMPS:
            return False
        if self.toks[a].text == "@" and self.language == JAVA:
            later = [q for q in parens if q > p and self.toks[q - 1].kind == "word" and not (q > 1 and self.toks[q - 2].text == "@")]
            if p > 1 and self.toks[p - 2].text == "@":
                if not later:
                    return False
                p = later[0]
                name = self.callable_name(a, p)
        after = self.closing(p)
        k = after
        while k < j:  # a member initialiser list may open braces of its own
            if self.toks[k].text == ":" and self.language == C:
                j = self.initialisers(k + 1)
                break
            k += 1
        if j >= len(self.toks) or self.toks[j].text != "{":
            return False
        if self.language == JAVA:
            plain = [t for t in self.words(a, p - 1) if t.kind == "word" and t.text not in QUALIFIERS]
            kind, body = ("method_declaration" if plain else "constructor_declaration"), "block"
        else:
            kind, body = "function_definition", "compound_statement"
        declarator = Node("function_declarator", self.toks[p - 1].start, self.toks[after - 1].end, [self.leaf(self.toks[p - 1]), *self.flat(p, after)])
        declarator.children[-1].type = "parameter_list"
        node = Node(kind, self.toks[a].start, self.toks[a].end, [*self.flat(a, p - 1), declarator, *self.flat(after, j)], names=[name])
        self.i = j
        node.children.append(self.block(body, "block"))
        node.end = node.children[-1].end
        out.append(node)
        return True

    def initialisers(self, k: int) -> int:
        """The place of the body after the initialiser list that begins at k."""
        while k < len(self.toks):
            while k < len(self.toks) and self.toks[k].text not in ("(", "{", ";"):
                k += 1
            if k >= len(self.toks) or self.toks[k].text == ";":
                return k
            k = self.closing(k)
            while k < len(self.toks) and self.toks[k].kind == "comment":
                k += 1
            if k < len(self.toks) and self.toks[k].text == ",":
                k += 1
                continue
            return k
        return k

    def operator_name(self, p: int) -> bool:
        return any(self.toks[q].text == "operator" for q in range(max(0, p - 4), p))

    def callable_name(self, a: int, p: int) -> str | None:
        for q in range(p - 1, max(a, p - 5) - 1, -1):
            if self.toks[q].text == "operator":
                return "operator" + "".join(t.text for t in self.toks[q + 1 : p])
        q = p - 1
        if self.toks[q].text == ">":  # f<T>()
            depth = 0
            while q > a:
                depth += (self.toks[q].text == ">") - (self.toks[q].text == "<")
                if not depth:
                    break
                q -= 1
            q -= 1
        if q < a or self.toks[q].kind != "word":
            return None
        return ("~" if q > a and self.toks[q - 1].text == "~" else "") + self.toks[q].text

    def labelled_type(self, out: list[Node], a: int, j: int, colon: int) -> bool:
        """Name : public Base { ... }, as a macro in place of `class` leaves it."""
        if colon - 1 < a or self.toks[colon - 1].kind != "word" or not any(t.kind == "word" for t in self.toks[colon + 1 : j]):
            return False
        name = self.toks[colon - 1].text
        if colon - 1 > a:
            out.append(Node("expression_statement", self.toks[a].start, self.toks[colon - 2].end, self.flat(a, colon - 1)))
        node = Node("labeled_statement", self.toks[colon - 1].start, self.toks[j].end, self.flat(colon - 1, j), names=[name])
        self.i = j
        node.children.append(self.block("field_declaration_list", "type"))
        node.end = node.children[-1].end
        out.append(node)
        return True

    def looks_declared(self, a: int, j: int) -> bool:
        """Whether a statement begins with a type and a declarator."""
        toks = self.words(a, j)
        k = 0
        while k < len(toks) and toks[k].kind == "word" and toks[k].text in QUALIFIERS:
            k += 1
        if k >= len(toks):
            return False
        if toks[k].kind == "word" and (toks[k].text in PRIMITIVES or toks[k].text in ("struct", "union", "enum", "class")):
            return len(toks) > k + 1
        if toks[k].kind != "word" or toks[k].text in ("new", "this", "super", "sizeof", "operator"):
            return False
        k += 1
        while k + 1 < len(toks) and toks[k].text in ("::", ".") and toks[k + 1].kind == "word":
            k += 2
        if k < len(toks) and toks[k].text == "<":
            depth = 0
            while k < len(toks):
                depth += (toks[k].text == "<") - (toks[k].text == ">")
                if toks[k].text in ("(", "=", "&&", "||") and depth:
                    return False
                k += 1
                if not depth:
                    break
        stars = k
        while k < len(toks) and toks[k].text in ("*", "&", "&&", "const", "[", "]", "..."):
            k += 1
        if k >= len(toks) or toks[k].kind != "word":
            return False
        if k > stars and toks[stars].text != "const":  # a * b; is a declaration only if nothing but a declarator follows
            return k + 1 >= len(toks) or toks[k + 1].text in ("=", ",", "[", "(", ";", ")")
        return True

    def statement_kind(self, context: str, a: int, j: int, parens: list[int], equals: int | None) -> str:
        toks = self.words(a, j)
        if self.language == JAVA:
            if toks and toks[0].text in ("package", "import"):
                return f"{toks[0].text}_declaration"
            if context == "type":
                method = [p for p in parens if self.toks[p - 1].kind == "word" and not (p > 1 and self.toks[p - 2].text == "@")]
                return "method_declaration" if method and equals is None else "field_declaration"
            return "local_variable_declaration" if self.looks_declared(a, j) else "expression_statement"
        if context == "type":
            return "field_declaration"
        return "declaration" if self.looks_declared(a, j) else "expression_statement"

    def plain(self, out: list[Node], a: int, j: int, kind: str) -> None:
        end = max(self.through_semicolon(a, j), a + 1)
        node = Node(kind, self.toks[a].start, self.toks[end - 1].end, self.flat(a, end))
        if kind == "declaration" or kind == "field_declaration" and self.language == JAVA:
            node.names = self.declared(a, end)
        elif kind in ("type_definition", "alias_declaration"):
            node.names = self.alias_name(a, end, kind)
        elif kind == "method_declaration":
            p = next((p for p in range(a + 1, end) if self.toks[p].text == "(" and self.toks[p - 1].kind == "word" and not (p > 1 and self.toks[p - 2].text == "@")), None)
            node.names = [self.toks[p - 1].text] if p else []
        out.append(node)
        self.i = end

    def alias_name(self, a: int, end: int, kind: str) -> list[str]:
        words = [t.text for t in self.words(a + 1, end) if t.kind == "word" and t.text not in PRIMITIVES and t.text not in QUALIFIERS and t.text not in TYPE_WORDS[C]]
        return words[:1]

    def declared(self, a: int, end: int, typed: bool = True) -> list[str]:
        """Names that a declaration introduces, in order, each once."""
        parts: list[list[Token]] = [[]]
        depth = angle = 0
        for t in self.words(a, end):
            if t.kind == "op":
                depth += (t.text in OPENERS) - (t.text in CLOSERS)
                angle += (t.text == "<") - (t.text == ">")
                if t.text == "," and depth == 0 and angle <= 0:
                    parts.append([])
                    continue
                if t.text == ";" and depth == 0:
                    break
            parts[-1].append(t)
        names = [n for k, p in enumerate(parts) if (n := self.declarator(p, typed and k == 0))]
        return list(dict.fromkeys(names))

    def declarator(self, toks: list[Token], typed: bool) -> str | None:
        cut = next((k for k, t in enumerate(toks) if t.text == "=" and t.kind == "op" and not (k and toks[k - 1].text == "operator")), len(toks))
        initialised, toks = cut < len(toks), toks[:cut]
        opener = next((k for k, t in enumerate(toks) if t.text in ("(", "{") and t.kind == "op"), None)
        if opener is not None and toks[opener].text == "(":
            if opener + 1 < len(toks) and toks[opener + 1].text in ("*", "&", "^"):  # (*name)(...)
                return next((t.text for t in toks[opener + 1 :] if t.kind == "word"), None)
            before = [t for t in toks[:opener] if t.kind == "word"]
            if initialised:
                return None if self.language == C else before[-1].text if before else None
            if before and before[-1].text == "OF":
                before = before[:-1]
            if toks[:opener] and any(t.text == "operator" for t in toks[:opener]):
                k = next(k for k, t in enumerate(toks) if t.text == "operator")
                return "".join(t.text for t in toks[k:opener])
            return before[-1].text if before else None
        stop = next((k for k, t in enumerate(toks) if t.text in ("[", ":", "{") and t.kind == "op"), len(toks))
        words = [t for t in toks[:stop] if t.kind == "word"]
        if not words or typed and len(words) < 2:
            return None
        return words[-1].text


def parse(source: str, language: str) -> tuple[Node, int]:
    """The tree of a source text and the number of bracket errors in it."""
    p = _Parser(source, language)
    root = p.file()
    return root, p.errors


def is_valid(source: str, language: str) -> bool:
    """Whether all brackets of a source text match; True for languages that aren't served."""
    return language not in (C, JAVA) or parse(source, language)[1] == 0
