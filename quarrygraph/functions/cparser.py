"""An error-tolerant parser from C source bytes to a concrete syntax tree of named nodes.

Node and field names follow the public C grammar of the tree's schema; punctuation and keywords have no nodes.
Declarations come by recursive descent, expressions by binding powers.  What can't be parsed becomes an ERROR node
that reaches to the end of the statement or block, so a tree always comes out.
"""

from __future__ import annotations

import re
import sys

from .clexer import Token, lex

#: Words with a role of their own, and binding powers of operators.
STORAGE = {"extern", "static", "auto", "register", "inline"}
QUALIFIERS = {"const", "volatile", "restrict", "_Atomic"}
SIZES = {"signed", "unsigned", "long", "short"}
PRIMITIVES = {"bool", "char", "int", "float", "double", "void", "size_t", "ssize_t", "intptr_t", "uintptr_t", "charptr_t"} | {f"{base}{bits}_t" for base in ("int", "uint", "char") for bits in (8, 16, 32, 64)}
CALL_MODIFIERS = {"__cdecl", "__clrcall", "__stdcall", "__fastcall", "__thiscall", "__vectorcall"}
POINTER_MODIFIERS = {"__restrict": "ms_restrict_modifier", "__uptr": "ms_unsigned_ptr_modifier", "__sptr": "ms_signed_ptr_modifier", "_unaligned": "ms_unaligned_ptr_modifier", "__unaligned": "ms_unaligned_ptr_modifier"}
STATEMENTS = {"if", "else", "switch", "case", "default", "while", "do", "for", "return", "break", "continue", "goto"}
RESERVED = STORAGE | QUALIFIERS | SIZES | STATEMENTS | {"struct", "union", "enum", "typedef", "sizeof", "__attribute__", "__declspec", "__based"}
POWERS = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
SIZEOF_POWER = 8
ASSIGNMENTS = {"=", "*=", "/=", "%=", "+=", "-=", "<<=", ">>=", "&=", "^=", "|="}
LITERALS = {"true": "true", "TRUE": "true", "false": "false", "FALSE": "false", "NULL": "null"}
_ESCAPE = re.compile(r"\\(?:[0-7]{1,3}|x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S])")


class Node:
    __slots__ = ("type", "start", "end", "field", "kids")

    def __init__(self, type: str, start: int, end: int, kids: list | None = None, field: str | None = None):
        self.type, self.start, self.end, self.field, self.kids = type, start, end, field, kids or []

    def child(self, field: str) -> "Node | None":
        for k in self.kids:
            if k.field == field:
                return k
        return None

    def walk(self):
        """Pre-order, self first."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.kids:
                stack += node.kids[::-1]


class Trouble(Exception):
    pass


def named(field: str, node: Node) -> Node:
    node.field = field
    return node


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens, self.comments = lex(text)
        self.tokens.append(Token("end", "", len(text), len(text)))
        self.at = 0
        self.loose = False  # inside attributes keywords are names

    # tokens

    def peek(self, ahead: int = 0) -> Token:
        try:
            return self.tokens[self.at + ahead]
        except IndexError:
            return self.tokens[-1]

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def on(self, *texts: str) -> bool:
        try:
            token = self.tokens[self.at]
        except IndexError:
            token = self.tokens[-1]
        return token.text in texts and token.kind in ("op", "id")

    def eat(self, text: str) -> Token:
        token = self.peek()
        if token.text != text or token.kind not in ("op", "id"):
            raise Trouble(text)
        self.at += 1
        return token

    def name(self, type: str = "identifier") -> Node:
        token = self.peek()
        if token.kind != "id" or (token.text in RESERVED and not self.loose):
            raise Trouble("name")
        self.at += 1
        return Node(type, token.start, token.end)

    def last_end(self) -> int:
        return self.tokens[self.at - 1].end

    def node(self, type: str, start: int, kids: list) -> Node:
        return Node(type, start, self.tokens[self.at - 1].end, [k for k in kids if k is not None] if None in kids else kids)

    def attempt(self, rule):
        mark = self.at
        try:
            return rule()
        except Trouble:
            self.at = mark
            return None

    # top level, blocks and directives

    def unit(self) -> Node:
        root = Node("translation_unit", 0, len(self.text))
        while self.peek().kind != "end":
            before = self.at
            root.kids += self.items(lambda: False, self.item)
            if self.peek().kind != "end":  # a stray brace or directive
                self.at = max(self.at, before) + 1
                t = self.tokens[self.at - 1]
                root.kids.append(Node("ERROR", t.start, t.end))
        place_comments(root, self.comments)
        return root

    def items(self, stop, rule) -> list[Node]:
        out: list[Node] = []
        while True:
            token = self.peek()
            if token.kind in ("end", "else", "elif", "endif") or (token.text == "}" and token.kind == "op") or stop():
                return out
            mark = self.at
            try:
                if token.kind in ("id", "op"):
                    out.append(rule())
                elif token.kind in ("if", "ifdef"):
                    out.append(self.conditional(rule))
                elif token.kind in ("define", "include", "call"):
                    out.append(self.directive(self.take()))
                else:
                    out.append(rule())
            except (Trouble, RecursionError):
                self.at = mark
                out.append(self.skip())

    def skip(self) -> Node:
        """An ERROR node up to the end of the statement or of the block that it opens."""
        start, depth = self.peek().start, 0
        while self.peek().kind != "end":
            if self.on("}") and depth == 0:
                break
            token = self.take()
            if token.kind == "op":
                depth += token.text in "({[" and token.text != ""
                depth -= token.text in ")}]" and depth > 0
            if depth == 0 and (token.text in (";", "}") or token.kind in ("else", "elif", "endif", "if", "ifdef")):
                break
        return Node("ERROR", start, max(self.last_end(), start))

    def directive(self, t: Token) -> Node:
        leaf = lambda type, part, field: Node(type, part[1], part[2], field=field)
        parts = {p[0]: p for p in t.extra}
        if t.kind == "include":
            _, a, b = t.extra[0]
            path = self.text[a:b]
            type = "string_literal" if path[:1] == '"' else "system_lib_string" if path[:1] == "<" else "call_expression" if "(" in path else "identifier"
            made = Node(type, a, b)
            if type == "call_expression":
                inner = Parser(path)
                for k in (made := inner.attempt(inner.prefix_of_directive) or Node(type, 0, b - a)).walk():
                    k.start, k.end = k.start + a, k.end + a
            return Node("preproc_include", t.start, t.end, [named("path", made)])
        if t.kind == "define":
            kids = [leaf("identifier", parts["name"], "name")] if "name" in parts else []
            if "parameters" in parts:
                inner = [Node("identifier", a, b) for p, a, b in t.extra if p == "parameter"]
                kids.append(Node("preproc_params", *parts["parameters"][1:], inner, "parameters"))
            if "value" in parts:
                kids.append(leaf("preproc_arg", parts["value"], "value"))
            return Node("preproc_function_def" if "parameters" in parts else "preproc_def", t.start, t.end, kids)
        kids = [leaf("preproc_directive", parts["directive"], "directive")]
        if "argument" in parts:
            kids.append(leaf("preproc_arg", parts["argument"], "argument"))
        return Node("preproc_call", t.start, t.end, kids)

    def prefix_of_directive(self) -> Node:
        return self.expression(0, preproc=True)

    def condition(self) -> Node:
        mark = self.at
        node = self.attempt(lambda: self.expression(0, preproc=True))
        if node is None or self.peek().kind not in ("eol", "end"):
            self.at = mark
            start = self.peek().start
            while self.peek().kind not in ("eol", "end"):
                self.at += 1
            node = Node("ERROR", start, max(start, self.last_end()))
        if self.peek().kind == "eol":
            self.at += 1
        return named("condition", node)

    def conditional(self, rule) -> Node:
        t = self.take()
        kids = [self.condition()] if t.kind == "if" else [named("name", self.name())]
        kids += self.items(lambda: False, rule)
        kids.append(self.alternative(rule))
        if self.peek().kind == "endif":
            self.at += 1
        return self.node("preproc_if" if t.kind == "if" else "preproc_ifdef", t.start, kids)

    def alternative(self, rule) -> Node | None:
        t = self.peek()
        if t.kind == "else":
            self.at += 1
            return named("alternative", self.node("preproc_else", t.start, self.items(lambda: False, rule)))
        if t.kind == "elif":
            self.at += 1
            kids = [self.condition(), *self.items(lambda: False, rule)]
            kids.append(self.alternative(rule))
            return named("alternative", self.node("preproc_elif", t.start, kids))
        return None

    def item(self) -> Node:
        t = self.peek()
        if t.text == "typedef":
            return self.typedef()
        if t.text == "extern" and self.peek(1).kind == "str":
            self.take()
            value = named("value", self.string())
            if self.on("{"):
                open_ = self.take()
                inner = self.items(lambda: False, self.item)
                self.eat("}")
                body = self.node("declaration_list", open_.start, inner)
            else:
                body = self.item()
            return self.node("linkage_specification", t.start, [value, named("body", body)])
        if t.text in STATEMENTS or self.on("{", ";") or self.labelled():
            return self.statement()
        if t.text == "[" and self.at_attribute():
            made = self.attempt(self.declaration)
            if made is not None:
                return made
            attributes = self.attributes()
            return self.node("attributed_statement", t.start, [*attributes, self.statement()])
        if self.declares():
            made = self.attempt(self.declaration)
            if made is not None:
                return made
        made = self.attempt(self.statement)
        return self.empty_macro() if made is None else made

    def empty_macro(self) -> Node:
        """A macro of a pointer type alone, which no expression can be."""
        made = self.macro_type(alone=True)
        self.eat(";")
        return made

    # declarations

    def labelled(self) -> bool:
        t = self.peek()
        return t.kind == "id" and t.text not in RESERVED and self.peek(1).text == ":"

    def at_attribute(self) -> bool:
        return self.on("[") and self.peek(1).text == "[" and self.peek(1).start == self.peek().end

    def declares(self) -> bool:
        """Whether a declaration is the likely reading of what starts here."""
        t = self.peek()
        if t.kind != "id":
            return False
        if t.text in RESERVED:
            return t.text not in ("sizeof", "typedef") and t.text not in STATEMENTS
        if t.text in PRIMITIVES or t.text in CALL_MODIFIERS:
            return True
        k = 1
        if self.peek(1).text == "(":
            k = self.closing(1)
            if k is None or self.at + 2 == self.at + k:
                return False
        u = self.peek(k)
        if u.kind == "id":
            return u.text not in STATEMENTS and u.text != "sizeof"
        if u.text == "*" or (k == 1 and u.text == "("):
            if k == 1 and u.text == "(":
                return False
            while self.peek(k).text == "*" or self.peek(k).text in QUALIFIERS or self.peek(k).text in POINTER_MODIFIERS:
                k += 1
            return (self.peek(k).kind == "id" and self.peek(k).text not in RESERVED and self.peek(k + 1).text in (";", "=", ",", "[", "(", ")", "{", "__attribute__")) or self.peek(k).text == "("
        return False

    def closing(self, k: int) -> int | None:
        """Tokens ahead of what follows the parenthesis that opens k tokens ahead."""
        depth = 0
        while True:
            t = self.peek(k)
            if t.kind == "end" or t.text in (";", "{"):
                return None
            depth += t.text == "("
            depth -= t.text == ")"
            k += 1
            if depth == 0:
                return k

    def attributes(self) -> list[Node]:
        out = []
        while self.at_attribute():
            out.append(self.attribute())
        return out

    def attribute(self) -> Node:
        start, kids = self.take().start, []
        self.take()
        self.loose = True
        try:
            while not self.on("]"):
                begin = self.peek().start
                parts = [named("name", self.name())]
                if self.on("::"):
                    self.take()
                    parts[0].field = "prefix"
                    parts.append(named("name", self.name()))
                if self.on("("):
                    parts.append(self.arguments())
                kids.append(self.node("attribute", begin, parts))
                if self.on(","):
                    self.take()
        finally:
            self.loose = False
        self.eat("]")
        self.eat("]")
        return self.node("attribute_declaration", start, kids)

    def gnu_attribute(self) -> Node:
        start = self.eat("__attribute__").start
        self.eat("(")
        self.loose = True
        try:
            inner = self.arguments()
        finally:
            self.loose = False
        self.eat(")")
        return self.node("attribute_specifier", start, [inner])

    def declspec(self) -> Node:
        start = self.eat("__declspec").start
        self.eat("(")
        inner = self.name()
        self.eat(")")
        return self.node("ms_declspec_modifier", start, [inner])

    def modifier(self) -> Node | None:
        t = self.peek()
        if t.kind == "id":
            if t.text in STORAGE:
                return Node("storage_class_specifier", t.start, self.take().end)
            if t.text in QUALIFIERS:
                return Node("type_qualifier", t.start, self.take().end)
            if t.text == "__attribute__":
                return self.gnu_attribute()
            if t.text == "__declspec":
                return self.declspec()
        elif t.text == "[" and self.at_attribute():
            return self.attribute()
        return None

    def specifiers(self) -> list[Node]:
        out: list[Node] = []
        while (m := self.modifier()) is not None:
            out.append(m)
        out.append(named("type", self.type_specifier()))
        while (m := self.modifier()) is not None:
            out.append(m)
        return out

    def type_specifier(self) -> Node:
        t = self.peek()
        if t.kind != "id":
            raise Trouble("type")
        if t.text in ("struct", "union"):
            self.take()
            kids = [self.declspec()] if self.on("__declspec") else []
            while self.on("__attribute__"):
                kids.append(self.gnu_attribute())
            if self.peek().kind == "id":
                kids.append(named("name", self.name("type_identifier")))
            if self.on("{"):
                kids.append(named("body", self.field_list()))
            elif not any(k.field == "name" for k in kids):
                raise Trouble("struct")
            return self.node(f"{t.text}_specifier", t.start, kids)
        if t.text == "enum":
            self.take()
            kids = [named("name", self.name("type_identifier"))] if self.peek().kind == "id" else []
            if self.on("{"):
                kids.append(named("body", self.enumerators()))
            elif not kids:
                raise Trouble("enum")
            return self.node("enum_specifier", t.start, kids)
        if t.text in SIZES:
            while self.peek().text in SIZES:
                self.take()
            u = self.peek()
            kids = []
            if u.text in PRIMITIVES:
                kids = [named("type", Node("primitive_type", u.start, self.take().end))]
            elif u.kind == "id" and u.text not in RESERVED and self.peek(1).kind == "id" and self.peek(1).text not in RESERVED:
                kids = [named("type", self.name("type_identifier"))]
            return self.node("sized_type_specifier", t.start, kids)
        if t.text in PRIMITIVES:
            return Node("primitive_type", t.start, self.take().end)
        if self.peek(1).text == "(" and (macro := self.attempt(self.macro_type)) is not None:
            return macro
        return self.name("type_identifier")

    def macro_type(self, alone: bool = False) -> Node:
        start = self.peek().start
        kids = [named("name", self.name())]
        self.eat("(")
        kids.append(named("type", self.type_descriptor()))
        self.eat(")")
        if not (alone or self.on("*") or (self.peek().kind == "id" and self.peek().text not in STATEMENTS)):
            raise Trouble("macro type")
        return self.node("macro_type_specifier", start, kids)

    def enumerators(self) -> Node:
        start, kids = self.eat("{").start, []
        while not self.on("}"):
            begin = self.peek().start
            parts = [named("name", self.name())]
            if self.on("="):
                self.take()
                parts.append(named("value", self.expression()))
            kids.append(self.node("enumerator", begin, parts))
            if not self.on("}"):
                self.eat(",")
        self.take()
        return self.node("enumerator_list", start, kids)

    def field_list(self) -> Node:
        start = self.eat("{").start
        kids = self.items(lambda: False, self.field_declaration)
        self.eat("}")
        return self.node("field_declaration_list", start, kids)

    def field_declaration(self) -> Node:
        start = self.peek().start
        kids = self.specifiers()
        if not self.on(";", ":"):
            kids.append(named("declarator", self.declarator("field")))
            while True:
                if self.on(":"):
                    kids.append(self.bitfield())
                if not self.on(","):
                    break
                self.take()
                kids.append(named("declarator", self.declarator("field")))
        elif self.on(":"):
            kids.append(self.bitfield())
        while self.on("__attribute__"):
            kids.append(self.gnu_attribute())
        self.eat(";")
        return self.node("field_declaration", start, kids)

    def bitfield(self) -> Node:
        start = self.eat(":").start
        return self.node("bitfield_clause", start, [self.expression()])

    def typedef(self) -> Node:
        start = self.eat("typedef").start
        kids = []
        while self.peek().text in QUALIFIERS:
            kids.append(self.modifier())
        kids.append(named("type", self.type_specifier()))
        while self.peek().text in QUALIFIERS or self.on("__attribute__"):
            kids.append(self.modifier())
        kids.append(named("declarator", self.declarator("type")))
        while self.on(","):
            self.take()
            kids.append(named("declarator", self.declarator("type")))
        while self.on("__attribute__"):
            kids.append(self.gnu_attribute())
        self.eat(";")
        return self.node("type_definition", start, kids)

    def declaration(self) -> Node:
        start = self.peek().start
        kids: list[Node] = []
        if self.peek().text in CALL_MODIFIERS:
            kids.append(Node("ms_call_modifier", start, self.take().end))
        kids += self.specifiers()
        if self.on(";"):
            self.take()
            if len(kids) == 1:  # a type alone has no declaration around it
                kids[0].field = None
                return kids[0]
            raise Trouble("declarator")
        if self.peek().text in CALL_MODIFIERS:
            t = self.take()
            kids.append(Node("ms_call_modifier", t.start, t.end))
        first = self.declarator("plain")
        types = self.attempt(lambda: self.parameter_types(first)) if self.peek().kind == "id" else None
        if self.on("{"):
            if not any(k.type == "function_declarator" for k in first.walk()):
                raise Trouble("body")
            return self.node("function_definition", start, [*kids, named("declarator", first), types, named("body", self.block())])
        while True:
            if self.on("__attribute__"):  # variables have none in this grammar
                kids.append(named("declarator", first))
                first = self.stray_attributes()
                if not self.on("=", ",", ";"):
                    raise Trouble("attribute")
                kids.append(first)
                if self.on("="):
                    self.take()
                    kids.append(self.initializer())
                if not self.on(","):
                    break
                self.take()
                first = self.declarator("plain")
                continue
            if self.on("="):
                self.take()
                first = self.node("init_declarator", first.start, [named("declarator", first), named("value", self.initializer())])
            kids.append(named("declarator", first))
            if not self.on(","):
                break
            self.take()
            first = self.declarator("plain")
        self.eat(";")
        return self.node("declaration", start, kids)

    def stray_attributes(self) -> Node:
        start = self.peek().start
        while self.on("__attribute__"):
            self.gnu_attribute()
        return self.node("ERROR", start, [])

    def parameter_types(self, head: Node) -> Node:
        """The declarations between an old-style function's head and its body, which this grammar doesn't know: as many
        as its bare parameters at most."""
        start, heads = self.peek().start, [k for k in head.walk() if k.type == "parameter_list"][:1]
        bare = [p for k in heads for p in k.kids if [x.type for x in p.kids] == ["type_identifier"]]
        for _ in bare:
            if self.on("{"):
                break
            if self.declaration().type != "declaration":
                raise Trouble("parameter")
        if not bare or not self.on("{"):
            raise Trouble("parameter")
        return self.node("ERROR", start, [])

    def initializer(self) -> Node:
        return self.initializer_list() if self.on("{") else self.expression()

    def initializer_list(self) -> Node:
        start, kids = self.eat("{").start, []
        while not self.on("}"):
            begin, marks = self.peek().start, []
            while self.on(".", "["):
                at = self.take()
                if at.text == ".":
                    marks.append(self.node("field_designator", at.start, [self.name("field_identifier")]))
                else:
                    inner = self.expression()
                    self.eat("]")
                    marks.append(self.node("subscript_designator", at.start, [inner]))
            if marks:
                self.eat("=")
                kids.append(self.node("initializer_pair", begin, [*(named("designator", m) for m in marks), named("value", self.initializer())]))
            else:
                kids.append(self.initializer())
            if not self.on("}"):
                self.eat(",")
        self.take()
        return self.node("initializer_list", start, kids)

    # declarators: kind is plain, field or type (what the name is), abstract (no name) or either

    def declarator(self, kind: str) -> Node:
        node = self.optional_declarator(kind)
        if node is None:
            raise Trouble("declarator")
        return node

    def optional_declarator(self, kind: str) -> Node | None:
        t = self.peek()
        start, kids = t.start, []
        if t.text == "__based" and t.kind == "id":
            at = self.take()
            kids.append(self.node("ms_based_modifier", at.start, [self.arguments()]))
        if self.on("*"):
            self.take()
            while self.peek().text in POINTER_MODIFIERS or self.peek().text in QUALIFIERS:
                t = self.take()
                kids.append(Node("ms_pointer_modifier", t.start, t.end, [Node(POINTER_MODIFIERS[t.text], t.start, t.end)]) if t.text in POINTER_MODIFIERS else Node("type_qualifier", t.start, t.end))
            inner = self.optional_declarator(kind)
            if inner is None and kind not in ("abstract", "either"):
                raise Trouble("declarator")
            if inner is not None:
                kids.append(named("declarator", inner))
            bare = inner is None or inner.type.startswith("abstract_")
            return self.node("abstract_pointer_declarator" if bare else "pointer_declarator", start, kids)
        node: Node | None = None
        t = self.peek()
        if t.kind == "id" and kind != "abstract" and t.text not in RESERVED:
            if t.text in CALL_MODIFIERS:
                self.take()
                return self.optional_declarator(kind)
            type = {"plain": "identifier", "either": "identifier", "field": "field_identifier", "type": "type_identifier"}[kind]
            if kind == "type" and t.text in PRIMITIVES:
                type = "primitive_type"
            node = Node(type, t.start, self.take().end)
        elif self.on("(") and not (kind in ("abstract", "either") and self.opens_parameters()):
            self.take()
            if self.peek().text in CALL_MODIFIERS:
                self.take()
            inner = self.declarator(kind)
            self.eat(")")
            bare = inner.type.startswith("abstract_")
            node = self.node("abstract_parenthesized_declarator" if bare else "parenthesized_declarator", start, [inner])
        elif kind not in ("abstract", "either"):
            return None
        while True:
            t = self.peek()
            if t.kind != "op" or t.text not in ("(", "["):
                if node is not None:
                    node.field = "declarator"
                return node
            bare = node is None or node.type.startswith("abstract_")
            before = [] if node is None else [named("declarator", node)]
            if self.on("("):
                kids = [*before, named("parameters", self.parameters())]
                while self.on("__attribute__") and kind == "plain":
                    kids.append(self.gnu_attribute())
                node = self.node("abstract_function_declarator" if bare else "function_declarator", start, kids)
            elif self.at_attribute() and node is not None:
                node.field = None
                node = self.node("attributed_declarator", start, [node, *self.attributes()])
            elif self.on("["):
                self.take()
                kids = before
                while self.peek().text in QUALIFIERS or self.peek().text == "static":
                    t = self.take()
                    if t.text != "static":
                        kids.append(Node("type_qualifier", t.start, t.end))
                if self.on("*") and self.peek(1).text == "]":
                    self.take()
                elif not self.on("]"):
                    kids.append(named("size", self.expression()))
                self.eat("]")
                node = self.node("abstract_array_declarator" if bare else "array_declarator", start, kids)
            else:
                return node

    def opens_parameters(self) -> bool:
        t = self.peek(1)
        return t.text in (")", "...") or (t.kind == "id" and t.text not in CALL_MODIFIERS)

    def parameters(self) -> Node:
        start, kids = self.eat("(").start, []
        while not self.on(")"):
            t = self.peek()
            if self.on("..."):
                self.take()
                kids.append(Node("variadic_parameter", t.start, t.end))
            else:
                parts = self.specifiers()
                inner = self.optional_declarator("either")
                if inner is not None:
                    parts.append(named("declarator", inner))
                while self.on("__attribute__"):
                    parts.append(self.gnu_attribute())
                kids.append(self.node("parameter_declaration", t.start, parts))
            if not self.on(")"):
                self.eat(",")
        self.take()
        return self.node("parameter_list", start, kids)

    def type_descriptor(self) -> Node:
        start, kids = self.peek().start, []
        while self.peek().text in QUALIFIERS:
            kids.append(self.modifier())
        kids.append(named("type", self.type_specifier()))
        while self.peek().text in QUALIFIERS:
            kids.append(self.modifier())
        inner = self.optional_declarator("abstract")
        if inner is not None:
            kids.append(named("declarator", inner))
        return self.node("type_descriptor", start, kids)

    # statements

    def block(self) -> Node:
        start = self.eat("{").start
        kids = self.items(lambda: False, self.item)
        if self.peek().kind != "end":
            while self.peek().kind in ("else", "elif", "endif"):  # a branch that ends outside of its block
                self.take()
                kids += self.items(lambda: False, self.item)
            self.eat("}")
        return self.node("compound_statement", start, kids)

    def statement(self) -> Node:
        t = self.peek()
        start = t.start
        if self.on("{"):
            return self.block()
        if t.text == "[" and self.at_attribute():
            return self.node("attributed_statement", start, [*self.attributes(), self.statement()])
        if self.labelled():
            label = named("label", self.name("statement_identifier"))
            self.eat(":")
            return self.node("labeled_statement", start, [label, self.statement()])
        word = t.text if t.kind == "id" else ""
        if word == "if":
            self.take()
            kids = [named("condition", self.parenthesized()), named("consequence", self.statement())]
            if self.on("else"):
                self.take()
                kids.append(named("alternative", self.statement()))
            return self.node("if_statement", start, kids)
        if word == "switch":
            self.take()
            return self.node("switch_statement", start, [named("condition", self.parenthesized()), named("body", self.block())])
        if word in ("case", "default"):
            self.take()
            kids = [named("value", self.expression())] if word == "case" else []
            self.eat(":")
            kids += self.items(lambda: self.on("case", "default"), self.item)
            return self.node("case_statement", start, kids)
        if word == "while":
            self.take()
            return self.node("while_statement", start, [named("condition", self.parenthesized()), named("body", self.statement())])
        if word == "do":
            self.take()
            body = named("body", self.statement())
            self.eat("while")
            condition = named("condition", self.parenthesized())
            self.eat(";")
            return self.node("do_statement", start, [body, condition])
        if word == "for":
            self.take()
            self.eat("(")
            kids = []
            if self.declares() and (made := self.attempt(self.declaration)) is not None:
                kids.append(named("initializer", made))
            else:
                if not self.on(";"):
                    kids.append(named("initializer", self.expression(comma=True)))
                self.eat(";")
            if not self.on(";"):
                kids.append(named("condition", self.expression()))
            self.eat(";")
            if not self.on(")"):
                kids.append(named("update", self.expression(comma=True)))
            self.eat(")")
            return self.node("for_statement", start, [*kids, self.statement()])
        if word == "return":
            self.take()
            kids = [] if self.on(";") else [self.expression(comma=True)]
            self.eat(";")
            return self.node("return_statement", start, kids)
        if word in ("break", "continue"):
            self.take()
            self.eat(";")
            return self.node(f"{word}_statement", start, [])
        if word == "goto":
            self.take()
            label = named("label", self.name("statement_identifier"))
            self.eat(";")
            return self.node("goto_statement", start, [label])
        kids = [] if self.on(";") else [self.expression(comma=True)]
        self.eat(";")
        return self.node("expression_statement", start, kids)

    # expressions

    def parenthesized(self) -> Node:
        start = self.eat("(").start
        inner = self.expression(comma=True)
        self.eat(")")
        return self.node("parenthesized_expression", start, [inner])

    def arguments(self) -> Node:
        start, kids = self.eat("(").start, []
        while not self.on(")"):
            kids.append(self.expression())
            if not self.on(")"):
                self.eat(",")
        self.take()
        return self.node("argument_list", start, kids)

    def expression(self, power: int = -3, comma: bool = False, preproc: bool = False) -> Node:
        left = self.prefix(preproc)
        start = left.start
        while True:
            t = self.peek()
            if t.kind != "op":
                break
            if t.text in POWERS and POWERS[t.text] > power:
                self.take()
                right = self.expression(POWERS[t.text], preproc=preproc)
                left = self.node("binary_expression", start, [named("left", left), named("right", right)])
            elif t.text in ASSIGNMENTS and power < -1 and left.type in ("identifier", "call_expression", "field_expression", "pointer_expression", "subscript_expression", "parenthesized_expression"):
                self.take()
                right = self.expression(-2)
                left = self.node("assignment_expression", start, [named("left", left), named("right", right)])
            elif t.text == "?" and power < 0:
                self.take()
                middle = self.expression()
                self.eat(":")
                right = self.expression(-3)
                left = self.node("conditional_expression", start, [named("condition", left), named("consequence", middle), named("alternative", right)])
            else:
                break
        if comma and self.on(","):
            self.take()
            right = self.expression(comma=True)
            left = self.node("comma_expression", start, [named("left", left), named("right", right)])
        return left

    def prefix(self, preproc: bool) -> Node:
        t = self.peek()
        start = t.start
        if t.kind == "op":
            if t.text in ("-", "+") and self.peek(1).kind == "num" and self.peek(1).start == t.end:
                self.take()
                return self.postfix(Node("number_literal", start, self.take().end), preproc)
            if t.text in ("!", "~", "-", "+"):
                self.take()
                return self.node("unary_expression", start, [named("argument", self.prefix(preproc))])
            if t.text in ("*", "&"):
                self.take()
                return self.node("pointer_expression", start, [named("argument", self.prefix(preproc))])
            if t.text in ("++", "--"):
                self.take()
                return self.node("update_expression", start, [named("argument", self.prefix(preproc))])
            if t.text == "(":
                if not preproc and (made := self.attempt(self.cast)) is not None:
                    return made if made.type == "cast_expression" else self.postfix(made, preproc)
                return self.postfix(self.parenthesized(), preproc)
            raise Trouble("expression")
        if t.text == "sizeof" and t.kind == "id":
            self.take()
            if self.on("(") and (made := self.attempt(self.sized_type)) is not None:
                return self.node("sizeof_expression", start, [named("type", made)])
            return self.node("sizeof_expression", start, [named("value", self.expression(SIZEOF_POWER))])
        if preproc and t.text == "defined":
            self.take()
            if self.on("("):
                self.take()
                inner = self.name()
                self.eat(")")
            else:
                inner = self.name()
            return self.node("preproc_defined", start, [inner])
        return self.postfix(self.primary(), preproc)

    def sized_type(self) -> Node:
        self.eat("(")
        t = self.peek()
        if t.kind == "id" and t.text not in PRIMITIVES and t.text not in RESERVED and self.peek(1).text != "*":
            raise Trouble("a name in parentheses is an expression")
        made = self.type_descriptor()
        self.eat(")")
        return made

    def cast(self) -> Node:
        start = self.eat("(").start
        made = named("type", self.type_descriptor())
        self.eat(")")
        t = self.peek()
        if self.on("{"):
            return self.node("compound_literal_expression", start, [made, named("value", self.initializer_list())])
        first = made.child("type")
        sure = first.type != "type_identifier"
        pointed = made.child("declarator") is not None
        operand = t.kind in ("num", "str", "chr") or (t.kind == "id" and (t.text == "sizeof" or t.text not in RESERVED))
        if not (operand or ((sure or pointed) and t.text in ("(", "*", "&", "-", "+", "!", "~", "++", "--"))):
            raise Trouble("cast")
        return self.node("cast_expression", start, [made, named("value", self.prefix(False))])

    def string(self) -> Node:
        t = self.take()
        if t.kind != "str":
            raise Trouble("string")
        kids = [Node("escape_sequence", t.start + m.start(), t.start + m.end()) for m in _ESCAPE.finditer(t.text)] if "\\" in t.text else []
        return Node("string_literal", t.start, t.end, kids)

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "num":
            return Node("number_literal", t.start, self.take().end)
        if t.kind == "chr":
            self.take()
            kids = [Node("escape_sequence", t.start + m.start(), t.start + m.end()) for m in _ESCAPE.finditer(t.text)] if "\\" in t.text else []
            return Node("char_literal", t.start, t.end, kids)
        if t.kind == "str":
            parts = [self.string()]
            while self.peek().kind == "str":
                parts.append(self.string())
            return parts[0] if len(parts) == 1 else self.node("concatenated_string", t.start, parts)
        if t.kind == "id" and t.text in LITERALS:
            return Node(LITERALS[t.text], t.start, self.take().end)
        return self.name()

    def postfix(self, node: Node, preproc: bool) -> Node:
        start = node.start
        while True:
            t = self.peek()
            if t.kind != "op":
                return node
            if t.text == "(":
                node = self.node("call_expression", start, [named("function", node), named("arguments", self.arguments())])
            elif t.text == "[" and not preproc:
                self.take()
                index = self.expression()
                self.eat("]")
                node = self.node("subscript_expression", start, [named("argument", node), named("index", index)])
            elif t.text in (".", "->") and not preproc:
                self.take()
                node = self.node("field_expression", start, [named("argument", node), named("field", self.name("field_identifier"))])
            elif t.text in ("++", "--"):
                self.take()
                node = self.node("update_expression", start, [named("argument", node)])
            else:
                return node


def place_comments(root: Node, comments: list[tuple[int, int]]) -> None:
    """Comments become children of the innermost node around them."""
    for start, end in comments:
        node = root
        while True:
            inner = next((k for k in node.kids if k.start < start and end < k.end and k.type not in ("string_literal", "preproc_arg")), None)
            if inner is None:
                break
            node = inner
        place = sum(k.start < start for k in node.kids)
        node.kids.insert(place, Node("comment", start, end))


def parse(content: bytes) -> Node:
    """The tree of a file's bytes; start and end are byte offsets."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    text = bytes(content).decode("latin-1")
    try:
        return Parser(text).unit()
    except RecursionError:
        return Node("translation_unit", 0, len(text), [Node("ERROR", 0, len(text))])


def s_expression(node: Node, fields: bool = True) -> str:
    name = f"{node.field}: " if fields and node.field else ""
    return f"{name}({' '.join([node.type, *(s_expression(k, fields) for k in node.kids)])})"
