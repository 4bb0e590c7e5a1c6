"""Java source to declarations: a tokenizer and a scanner that reads declarations exactly and bodies for what the facts need.

Read are the package, imports, types and members with their annotations, modifiers and ranges; in bodies the type references,
anonymous classes and decisions. Local classes are passed over. A text that cannot be read so is reported with the place; what a
compiler would refuse for other reasons is not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n\r]*|/\*.*?\*/)
    |(?P<text>\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.[^'\n\r]*)'|'[^'\n\r]{1,2}')
    |(?P<number>0[xXbB][0-9a-fA-F_.pP]+[lLfFdD]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
    |(?P<name>(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<mark>\.\.\.|->|::|&&|\|\||[-+*/%&|^!~?:;,.=<>(){}\[\]@])""",
    re.X | re.S,
)
#: Fixed values of the language.
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
MODIFIERS = frozenset("public protected private abstract static final strictfp transient volatile synchronized native default sealed non-sealed".split())
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new "
    "package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_DECISIONS = frozenset(("if", "for", "while", "catch", "case", "&&", "||"))
_BEGINS = frozenset((";", "{", "}", "(", ")", ":", "->", "else", "do", ","))


class Unreadable(ValueError):
    def __init__(self, line: int, column: int):
        super().__init__(f"{line}:{column}")
        self.line, self.column = line, column


@dataclass
class Token:
    kind: str  # name, word (a key word), text, number, mark, end
    text: str
    line: int
    column: int
    end_line: int
    end_column: int


@dataclass
class Reference:
    name: str
    kind: str  # extends, implements, depends-on
    range: tuple[int, int, int, int]


@dataclass
class Annotation:
    name: str
    range: tuple[int, int, int, int]


@dataclass
class Callable:
    name: str
    signature: str
    kind: str
    modifiers: list[str]
    annotations: list[Annotation]
    range: tuple[int, int, int, int] = (1, 1, 1, 1)
    complexity: int = 1


@dataclass
class Type:
    name: str
    qualified: str
    kind: str
    nesting: str
    modifiers: list[str]
    annotations: list[Annotation]
    range: tuple[int, int, int, int] = (1, 1, 1, 1)
    callables: list[Callable] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)


@dataclass
class Unit:
    package: str = ""
    imports: list[tuple[str, bool, bool]] = field(default_factory=list)  # name, static, wildcard
    types: list[Type] = field(default_factory=list)


def tokenize(text: str) -> list[Token]:
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]
    out: list[Token] = []
    at, row = 0, 0

    def place(p: int) -> tuple[int, int]:
        nonlocal row
        while row + 1 < len(starts) and starts[row + 1] <= p:
            row += 1
        return row + 1, p - starts[row] + 1

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at] == "\x1a" and at == len(text) - 1:
                break
            raise Unreadable(*place(at))
        if m.lastgroup != "skip":
            line, column = place(at)
            end_line, end_column = place(m.end() - 1)
            kind = "word" if m.lastgroup == "name" and m[0] in KEYWORDS else m.lastgroup
            out.append(Token(kind, m[0], line, column, end_line, end_column))
        at = m.end()
    line, column = place(len(text)) if text else (1, 1)
    out.append(Token("end", "", line, column, line, column))
    return out


class Scanner:
    def __init__(self, text: str):
        self.t = tokenize(text.removeprefix("﻿"))
        self.close = self._matched()
        self.i = 0
        self.unit = Unit()

    def _matched(self) -> dict[int, int]:
        """Index of the closing bracket of each opening one."""
        out: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in "([{":
                open_.append(i)
            elif t.kind == "mark" and t.text in ")]}":
                if not open_ or _CLOSER[self.t[open_[-1]].text] != t.text:
                    raise Unreadable(t.line, t.column)
                out[open_.pop()] = i
        if open_:
            raise Unreadable(self.t[-1].line, self.t[-1].column)
        return out

    # ---- small steps

    def fail(self, i: int | None = None):
        t = self.t[min(self.i if i is None else i, len(self.t) - 1)]
        raise Unreadable(t.line, t.column)

    def at(self, text: str, i: int | None = None) -> bool:
        t = self.t[min(self.i if i is None else i, len(self.t) - 1)]
        return t.text == text and t.kind != "text"

    def take(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail()

    def ident(self) -> str:
        t = self.t[self.i]
        if t.kind != "name":
            self.fail()
        self.i += 1
        return t.text

    def dotted(self) -> str:
        parts = [self.ident()]
        while self.at(".") and self.t[self.i + 1].kind == "name":
            self.i += 1
            parts.append(self.ident())
        return ".".join(parts)

    def span(self, first: int, last: int) -> tuple[int, int, int, int]:
        a, b = self.t[first], self.t[last]
        return a.line, a.column, b.end_line, b.end_column

    # ---- types

    def type_at(self, i: int, refs: list[Reference] | None, hidden: frozenset[str], kind: str = "depends-on") -> int | None:
        """Where a type that begins at i ends, or None if none does; adds its references."""
        found: list[Reference] = []
        while self.at("@", i) and not self.at("interface", i + 1):
            i = self._annotation_end(i, found, hidden)
        t = self.t[i]
        if t.kind == "word" and t.text in PRIMITIVES:
            i += 1
        elif t.kind == "name":
            first, name = i, []
            while True:
                if self.t[i].kind != "name":
                    return None
                name.append(self.t[i].text)
                i += 1
                last = i - 1
                if self.at("<", i):
                    end = self._arguments(i, found, hidden)
                    if end is None:
                        return None
                    i, last = end, end - 1
                # a scope is a type of its own
                if len(name) > 1 or (name[0] not in hidden and name[0] != "var"):
                    found.append(Reference(".".join(name), kind, self.span(first, last)))
                if self.at(".", i) and self.t[i + 1].kind == "name":
                    i += 1
                    continue
                break
        else:
            return None
        while self.at("[", i) and self.at("]", i + 1):
            i += 2
        if refs is not None:
            refs.extend(found)
        return i

    def _arguments(self, i: int, found: list[Reference], hidden: frozenset[str]) -> int | None:
        i += 1
        if self.at(">", i):
            return i + 1
        while True:
            while self.at("@", i):
                i = self._annotation_end(i, found, hidden)
            if self.at("?", i):
                i += 1
                if self.at("extends", i) or self.at("super", i):
                    i = self.type_at(i + 1, found, hidden)
            else:
                i = self.type_at(i, found, hidden)
            while i is not None and self.at("&", i):
                i = self.type_at(i + 1, found, hidden)
            if i is None:
                return None
            if self.at(",", i):
                i += 1
            elif self.at(">", i):
                return i + 1
            else:
                return None

    def _annotation_end(self, i: int, refs: list[Reference] | None, hidden: frozenset[str], seen: list[Annotation] | None = None) -> int:
        first = i
        self.i, back = i + 1, self.i
        name = self.dotted()
        end, self.i = self.i, back
        if self.at("(", end):
            inner: list[Reference] = []
            self.code(end + 1, self.close[end], inner, hidden, None, None)
            end = self.close[end] + 1
        else:
            inner = []
        if refs is not None:
            refs.append(Reference(name, "depends-on", self.span(first, end - 1)))
            refs.extend(inner)
        if seen is not None:
            seen.append(Annotation(name, self.span(first, end - 1)))
        return end

    def modifiers(self, refs: list[Reference], hidden: frozenset[str]) -> tuple[list[str], list[Annotation]]:
        mods: list[str] = []
        seen: list[Annotation] = []
        while True:
            if self.at("@") and not self.at("interface", self.i + 1):
                self.i = self._annotation_end(self.i, refs, hidden, seen)
            elif self.at("non") and self.at("-", self.i + 1) and self.at("sealed", self.i + 2):
                mods.append("non-sealed")
                self.i += 3
            elif self.at("sealed") and not (self.t[self.i + 1].kind == "word" and self.t[self.i + 1].text not in ("class", "interface", *MODIFIERS)) and self.t[self.i + 1].kind == "word":
                mods.append("sealed")
                self.i += 1
            elif self.t[self.i].kind == "word" and self.t[self.i].text in MODIFIERS and not (self.at("default") and (self.at(":", self.i + 1) or self.at("->", self.i + 1))):
                mods.append(self.t[self.i].text)
                self.i += 1
            else:
                return sorted(mods), seen

    def parameters(self, refs: list[Reference], hidden: frozenset[str]) -> frozenset[str]:
        """<T extends A & B, ...>, if it is there; the names hidden from there on."""
        if not self.at("<"):
            return hidden
        back = self.i
        names, depth, i = set(hidden), 0, self.i
        while True:  # names first, as bounds may name each other
            if self.at("<", i):
                depth += 1
            elif self.at(">", i):
                depth -= 1
                if not depth:
                    break
            if depth == 1 and (self.at("<", i) or self.at(",", i)):
                j = i + 1
                while self.at("@", j):
                    j = self._annotation_end(j, None, hidden)
                if self.t[j].kind != "name":
                    self.fail(j)
                names.add(self.t[j].text)
            i += 1
            if i >= len(self.t):
                self.fail(back)
        hidden = frozenset(names)
        i = back + 1
        while True:
            while self.at("@", i):
                i = self._annotation_end(i, refs, hidden)
            i += 1
            if self.at("extends", i):
                i = self.type_at(i + 1, refs, hidden)
                while i is not None and self.at("&", i):
                    i = self.type_at(i + 1, refs, hidden)
            if i is None:
                self.fail(back)
            if self.at(",", i):
                i += 1
            elif self.at(">", i):
                self.i = i + 1
                return hidden
            else:
                self.fail(i)

    def need_type(self, refs: list[Reference], hidden: frozenset[str], kind: str = "depends-on") -> tuple[int, int]:
        first = self.i
        end = self.type_at(first, refs, hidden, kind)
        if end is None:
            self.fail()
        self.i = end
        return first, end

    def types(self, refs: list[Reference], hidden: frozenset[str], kind: str) -> None:
        while True:
            here: list[Reference] = []
            first, end = self.need_type(here, hidden, kind)
            # the type and its scopes are the relation; only the whole name is one, and what is within its arguments is not
            whole = [r for r in here if r.range[:2] == self.span(first, first)[:2]]
            refs.extend(r for r in here if all(r is not w for w in whole))
            refs.append(max(whole, key=lambda r: len(r.name)) if whole else self.fail(first))
            refs[-1].kind = kind
            if not self.take(","):
                return

    # ---- declarations

    def run(self) -> Unit:
        u = self.unit
        back = self.i
        ignored: list[Reference] = []
        self.modifiers(ignored, frozenset())
        if self.take("package"):
            u.package = self.dotted()
            self.need(";")
        else:
            self.i = back
        while True:
            if self.take(";"):
                continue
            if not self.take("import"):
                break
            static = self.take("static")
            name, wild = self.dotted(), False
            if self.take("."):
                self.need("*")
                wild = True
            self.need(";")
            u.imports.append((name, static, wild))
        if (self.at("module") or self.at("open")) and self.t[self.i + 1].kind == "name":
            return u
        while self.t[self.i].kind != "end":
            if not self.take(";"):
                self.declaration(None, "top-level")
        return u

    def _declares(self) -> str | None:
        """The kind of type declaration that begins here, behind modifiers."""
        t, n = self.t[self.i], self.t[self.i + 1] if self.i + 1 < len(self.t) else self.t[-1]
        if t.kind == "word" and t.text in ("class", "interface", "enum"):
            return t.text
        if self.at("@") and n.text == "interface":
            return "annotation"
        if t.kind == "name" and t.text == "record" and n.kind == "name" and self.t[self.i + 2].text in ("(", "<"):
            return "record"
        return None

    def declaration(self, outer: Type | None, nesting: str) -> None:
        first = self.i
        refs: list[Reference] = []
        mods, seen = self.modifiers(refs, frozenset())
        kind = self._declares()
        if kind is None:
            self.fail()
        self.typed(outer, nesting, kind, first, mods, seen, refs)

    def typed(self, outer: Type | None, nesting: str, kind: str, first: int, mods: list[str], seen: list[Annotation], refs: list[Reference]) -> None:
        self.i += 2 if kind == "annotation" else 1
        name = self.ident()
        above = outer.qualified if outer else self.unit.package
        made = Type(name, f"{above}.{name}" if above else name, kind, nesting, mods, seen, references=refs)
        self.unit.types.append(made)
        hidden = self.parameters(refs, frozenset())
        if kind == "record":
            self.formal(refs, hidden)
        if self.take("extends"):
            self.types(refs, hidden, "extends")
        if self.take("implements"):
            self.types(refs, hidden, "implements")
        if self.at("permits") and self.t[self.i].kind == "name":
            self.i += 1
            while True:
                self.need_type(refs, hidden)
                if not self.take(","):
                    break
        if not self.at("{"):
            self.fail()
        self.body(made, hidden, kind == "enum", None)
        made.range = self.span(first, self.i - 1)

    def body(self, owner: Type, hidden: frozenset[str], enum: bool, within: Callable | None) -> None:
        """The members between braces; `within` is the callable around an anonymous class."""
        end = self.close[self.i]
        self.i += 1
        if enum:
            while not self.at(";") and self.i < end:
                self.modifiers(owner.references, hidden)
                self.ident()
                if self.at("("):
                    self.code(self.i + 1, self.close[self.i], owner.references, hidden, owner, within)
                    self.i = self.close[self.i] + 1
                if self.at("{"):
                    self.body(owner, hidden, False, within)
                if not self.take(","):
                    break
            if self.i < end:
                self.need(";")
        while self.i < end:
            if not self.take(";"):
                self.member(owner, hidden, within)
        if self.i != end:
            self.fail()
        self.i = end + 1

    def formal(self, refs: list[Reference], hidden: frozenset[str]) -> list[str]:
        """Formal parameters: their types as they stand in a signature."""
        end = self.close[self.i]
        self.i += 1
        out: list[str] = []
        while self.i < end:
            self.modifiers(refs, hidden)
            first, last = self.need_type(refs, hidden)
            text = "".join(t.text + (" " if t.kind == "word" and t.text in ("extends", "super") else "") for t in self.t[first:last]).replace(" ", "")
            while self.at("@"):
                self.i = self._annotation_end(self.i, refs, hidden)
            many = self.take("...")
            if self.take("this") or (self.t[self.i].kind == "name" and self.at(".", self.i + 1)):  # a receiver is no parameter
                while self.i < end and not self.at(","):
                    self.i += 1
            else:
                self.ident()
                while self.at("[") and self.at("]", self.i + 1):
                    text += "[]"
                    self.i += 2
                out.append(text + ("..." if many else ""))
            if self.i < end:
                self.need(",")
        self.i = end + 1
        return out

    def member(self, owner: Type, hidden: frozenset[str], within: Callable | None) -> None:
        first = self.i
        refs = owner.references
        if self.at("{") or (self.at("static") and self.at("{", self.i + 1)):
            self.i += self.at("static")
            self.code(self.i + 1, self.close[self.i], refs, hidden, owner, within)
            self.i = self.close[self.i] + 1
            return
        own: list[Reference] = []
        mods, seen = self.modifiers(own, hidden)
        kind = self._declares()
        if kind is not None:
            if within is None:
                self.typed(owner, "member", kind, first, mods, seen, own)
            else:
                self.passed_over()
            return
        refs.extend(own)
        hidden = self.parameters(refs, hidden)
        t, n = self.t[self.i], self.t[self.i + 1]
        if t.kind == "name" and n.text == "(":
            if t.text != owner.name or within is not None:
                self.fail()
            self.i += 1
            self.callable_(owner, hidden, first, "<init>", "constructor", mods, seen)
            return
        if t.kind == "name" and n.text == "{" and owner.kind == "record" and t.text == owner.name:
            self.i += 1
            self.code(self.i + 1, self.close[self.i], refs, hidden, owner, None)
            self.i = self.close[self.i] + 1
            return
        self.need_type(refs, hidden)
        name = self.ident()
        if self.at("("):
            if owner.kind == "annotation" and within is None:
                self.i = self.close[self.i] + 1
                if self.take("default"):
                    self.until_semicolon(refs, hidden, owner, None)
                self.need(";")
                return
            self.callable_(owner, hidden, first, name, "method", mods, seen)
            return
        while True:
            while self.at("[") and self.at("]", self.i + 1):
                self.i += 2
            if self.take("="):
                self.until_semicolon(refs, hidden, owner, within, commas=True)
            if self.take(","):
                self.ident()
                continue
            self.need(";")
            return

    def callable_(self, owner: Type, hidden: frozenset[str], first: int, name: str, kind: str, mods: list[str], seen: list[Annotation]) -> None:
        refs = owner.references
        params = self.formal(refs, hidden)
        while self.at("[") and self.at("]", self.i + 1):
            self.i += 2
        if self.take("throws"):
            while True:
                self.need_type(refs, hidden)
                if not self.take(","):
                    break
        made = Callable(name, f"{name}({','.join(params)})", kind, mods, seen)
        owner.callables.append(made)
        if self.at("{"):
            self.code(self.i + 1, self.close[self.i], refs, hidden, owner, made)
            self.i = self.close[self.i] + 1
        else:
            self.need(";")
        made.range = self.span(first, self.i - 1)

    def passed_over(self) -> None:
        """A local class, or one within an anonymous class: its contents belong to no type of the facts."""
        while not self.at("{"):
            if self.t[self.i].kind == "end":
                self.fail()
            self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
        self.i = self.close[self.i] + 1

    # ---- code

    def until_semicolon(self, refs, hidden, owner, within, commas: bool = False) -> None:
        """An initializer; generic arguments may hold commas, so a comma ends it only if a declarator follows."""
        i = self.i
        while not self.at(";", i):
            if self.t[i].kind == "end" or self.t[i].text in (")", "]", "}"):
                self.fail(i)
            if commas and self.at(",", i) and self.t[i + 1].kind == "name" and self.t[i + 2].text in ("=", ",", ";", "[") and not self._in_arguments(self.i, i):
                break
            i = self.close[i] + 1 if i in self.close else i + 1
        self.code(self.i, i, refs, hidden, owner, within)
        self.i = i

    def _in_arguments(self, first: int, comma: int) -> bool:
        """Whether the comma is within type arguments that begin in between."""
        for i in range(first, comma):
            if self.at("<", i) and i and self.t[i - 1].kind in ("name", "mark"):
                end = self._arguments(i, [], frozenset())
                if end is not None and end > comma:
                    return True
        return False

    def code(self, first: int, last: int, refs: list[Reference], hidden: frozenset[str], owner: Type | None, within: Callable | None) -> None:
        """Tokens first .. last - 1: references go to refs, decisions to within. self.i comes out as it was."""
        back, i = self.i, first
        while i < last:
            t = self.t[i]
            if t.kind == "word" or t.kind == "mark":
                if within is not None and t.text in _DECISIONS:
                    within.complexity += 1
                elif within is not None and t.text == "?" and self.t[i - 1].text not in ("<", ","):
                    within.complexity += 1
            if t.text == "@" and t.kind == "mark" and self.t[i + 1].kind == "name":
                i = self._annotation_end(i, refs, hidden)
                continue
            if t.kind == "word" and t.text in ("new", "instanceof"):
                j = i + 1
                if t.text == "new" and self.at("<", j):
                    j = self._arguments(j, refs, hidden) or j
                while self.at("final", j):
                    j += 1
                end = self.type_at(j, refs, hidden)
                if end is None:
                    self.fail(j)
                if t.text == "new" and self.at("(", end):
                    self.code(end + 1, self.close[end], refs, hidden, owner, within)
                    end = self.close[end] + 1
                    if self.at("{", end) and owner is not None:
                        self.i = end
                        self.body(owner, hidden, False, within or Callable("", "", "", [], []))
                        end = self.i
                i = end
                continue
            if t.kind == "mark" and t.text == "." and self.at("<", i + 1):
                i = self._arguments(i + 1, refs, hidden) or i + 1
                continue
            begins = i == first or (self.t[i - 1].text in _BEGINS and self.t[i - 1].kind != "text") or self.t[i - 1].text == "final"
            if begins and owner is not None and (t.text in ("class", "interface", "enum", "abstract", "static") and t.kind == "word" or (t.text == "record" and self.t[i + 1].kind == "name" and self.t[i + 2].text in ("(", "<"))):
                self.i = i
                self.modifiers([], hidden)
                if self._declares():
                    self.passed_over()
                    i = self.i
                    continue
            if t.kind == "name" or (t.kind == "word" and t.text in PRIMITIVES):
                got: list[Reference] = []
                end = self.type_at(i, got, hidden) if self.t[i - 1].text != "." else None
                if end is not None:
                    after, then = self.t[end], self.t[min(end + 1, len(self.t) - 1)]
                    plain = begins and after.kind == "name" and (then.text in ("=", ";", ",", ":", "[", ")", "->") or after.text != "yield") and t.text != "yield"
                    many = begins and after.text == "..."
                    literal = after.text == "." and then.text == "class" or after.text == "::"
                    catch = begins and after.text == "|" or self.t[i - 1].text == "|" and self._catching(i)
                    cast = self.t[i - 1].text in ("(", "&") and (after.text == ")" and self._cast(end) or after.text == "&" and self._cast_list(i))
                    if plain or many or literal or (catch and self._catching(i)) or cast:
                        refs.extend(got)
                        i = end
                        continue
                    if end > i + 1 and after.kind == "name" and begins:
                        refs.extend(got)
                        i = end
                        continue
            i += 1
        self.i = back

    def _catching(self, i: int) -> bool:
        while i > 0 and (self.t[i - 1].kind in ("name",) or self.t[i - 1].text in (".", "|", "final")):
            i -= 1
        return self.at("(", i - 1) and self.at("catch", i - 2)

    def _cast(self, end: int) -> bool:
        """Whether `)` at end closes a cast: an operand without a sign follows."""
        n = self.t[min(end + 1, len(self.t) - 1)]
        primitive = self.t[end - 1].text in PRIMITIVES or self.t[end - 1].text == "]"
        return n.kind in ("name", "text", "number") or n.text in ("(", "!", "~", "this", "new", "super", "true", "false", "null", "switch") or n.kind == "word" and n.text in PRIMITIVES or (primitive and n.text in ("+", "-"))

    def _cast_list(self, i: int) -> bool:
        j = i
        while not self.at("(", j):
            if j == 0 or self.t[j].text in (";", "{", "}", "="):
                return False
            j -= 1
        k = j + 1
        while True:
            end = self.type_at(k, None, frozenset())
            if end is None:
                return False
            if self.at("&", end):
                k = end + 1
            else:
                return self.at(")", end) and self._cast(end)


def declared(text: str) -> Unit:
    """The declarations of a compilation unit; Unreadable with the place if it cannot be read."""
    s = Scanner(text)
    try:
        return s.run()
    except IndexError:
        t = s.t[-1]
        raise Unreadable(t.line, t.column) from None
