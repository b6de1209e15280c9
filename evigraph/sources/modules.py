"""Module facts of JavaScript and TypeScript sources: exports, uses, and what could not be placed.

Only the module syntax is read: a tokenizer that knows comments, strings, templates and regular expressions, and the forms
of import and export at the top level. Whatever does not fit makes the whole file unknown, for a missed use would turn into
a false finding.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import accumulate

#: Sources that hold module syntax; CommonJS forms are not lowered.
JS_KINDS = ("ts", "tsx", "mts", "js", "jsx", "mjs", "declaration")
COMMONJS_KINDS = ("cts", "cjs")

_IDENT = re.compile(r"[A-Za-z_$\u00a0-\uffff#@][\w$\u00a0-\uffff]*")
_NUMBER = re.compile(r"\.?\d[\w.]*")
_SPACE = re.compile(r"\s+|//[^\n]*|/\*.*?\*/", re.S)
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class NotPlaced(ValueError):
    """Syntax outside what this scanner reads."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, template, regex, number, punct
    text: str
    start: int
    end: int
    depth: int


@dataclass(frozen=True)
class Export:
    name: str
    local: str | None
    namespace: str
    start: int
    end: int


@dataclass(frozen=True)
class Use:
    specifier: str
    imported: str | None
    local: str | None
    namespace: str
    kind: str  # named, default, namespace, side-effect, reexport-named, dynamic-broad
    request: str  # static-import, dynamic-import, require
    start: int
    end: int


@dataclass(frozen=True)
class Tag:
    tag: str
    binding: str
    kind: str  # static, dynamic, namespace
    start: int
    end: int


@dataclass
class Facts:
    exports: list[Export] = field(default_factory=list)
    uses: list[Use] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    tags: list[Tag] = field(default_factory=list)

    def ordered(self) -> Facts:
        key = lambda x: (x.start, x.end, str(x))
        return Facts(sorted(self.exports, key=key), sorted(self.uses, key=key), sorted(set(self.unknown)), sorted(self.tags, key=key))

    def in_bytes(self, text: str) -> Facts:
        """The same facts with spans that count the bytes of the text in UTF-8 instead of its characters."""
        if text.isascii():
            return self
        at = [0, *accumulate(len(c.encode()) for c in text)]
        moved = lambda xs: [replace(x, start=at[x.start], end=at[x.end]) for x in xs]
        return Facts(moved(self.exports), moved(self.uses), self.unknown, moved(self.tags))


def tokenize(text: str, markup: bool = False) -> list[Token]:
    """The tokens of a module. markup: a stray quote may be text between tags."""
    out: list[Token] = []
    stack: list[str] = []
    at, n = (text.index("\n") if "\n" in text else len(text)) if text.startswith("#!") else 0, len(text)

    def add(kind: str, end: int, value: str | None = None) -> None:
        nonlocal at
        out.append(Token(kind, text[at:end] if value is None else value, at, end, len(stack)))
        at = end

    def template(begin: int) -> int:
        """From behind a back-quote or a closing brace to behind the end, or behind the next ${ (then a brace is open)."""
        k = begin
        while k < n:
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                return k + 1
            elif text.startswith("${", k):
                stack.append("`")
                return k + 2
            else:
                k += 1
        raise NotPlaced("template does not end")

    while at < n:
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if text.startswith("/*", at):
            raise NotPlaced("comment does not end")
        if c in "\"'":
            k = at + 1
            while k < n and text[k] != c and text[k] != "\n":
                k += 2 if text[k] == "\\" else 1
            if k >= n or text[k] != c:
                if not markup:
                    raise NotPlaced("string does not end")
                at += 1
                continue
            add("string", k + 1, _unescape(text[at + 1 : k]))
        elif c == "`":
            before = len(stack)
            end = template(at + 1)
            add("template" if len(stack) == before else "template-open", end)
        elif c == "}" and stack and stack[-1] == "`":
            stack.pop()
            before = len(stack)
            end = template(at + 1)
            add("template-part" if len(stack) == before else "template-open", end)
        elif m := _IDENT.match(text, at):
            add("name", m.end())
        elif m := _NUMBER.match(text, at):
            add("number", m.end())
        elif c == "/" and _regex_may_start(out) and (end := _regex_end(text, at)):
            add("regex", end)
        elif c in _OPEN:
            add("punct", at + 1)
            stack.append(_OPEN[c])
        elif c in _CLOSE:
            if not stack or stack.pop() != c:
                raise NotPlaced(f"unbalanced {c}")
            add("punct", at + 1)
        else:
            add("punct", at + 3 if text.startswith("...", at) else at + 2 if text.startswith("=>", at) else at + 1)
    if stack:
        raise NotPlaced(f"{stack[-1]} is missing")
    return out


def _regex_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    return last.text in _BEFORE_REGEX if last.kind == "name" else last.kind in ("punct", "template-open") and last.text not in (")", "]", "}")


def _regex_end(text: str, at: int) -> int | None:
    k, group = at + 1, False
    while k < len(text) and text[k] != "\n":
        if text[k] == "\\":
            k += 1
        elif text[k] == "[":
            group = True
        elif text[k] == "]":
            group = False
        elif text[k] == "/" and not group:
            k += 1
            while k < len(text) and text[k].isalpha():
                k += 1
            return k
        k += 1
    return None


def _unescape(raw: str) -> str:
    one = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
    return re.sub(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[4] is None else one.get(m[4], m[4]), raw, flags=re.S)


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.k, self.facts = tokens, 0, Facts()

    def peek(self, ahead: int = 0) -> Token | None:
        k = self.k + ahead
        return self.tokens[k] if k < len(self.tokens) else None

    def is_(self, text: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.kind in ("punct", "name") and t.text == text

    def take(self) -> Token:
        if (t := self.peek()) is None:
            raise NotPlaced("file ends inside a declaration")
        self.k += 1
        return t

    def need(self, text: str) -> Token:
        t = self.take()
        if t.kind not in ("punct", "name") or t.text != text:
            raise NotPlaced(f"{text} expected at {t.start}")
        return t

    def name(self) -> str:
        t = self.take()
        if t.kind not in ("name", "string"):
            raise NotPlaced(f"name expected at {t.start}")
        return t.text

    def string(self) -> Token:
        t = self.take()
        if t.kind != "string":
            raise NotPlaced(f"module specifier expected at {t.start}")
        return t

    def specifiers(self) -> list[tuple[str, str, bool, int, int]]:
        """{ a, b as c, type d } as (outer name, inner name, type only, start, end), outer being the first of the two."""
        found = []
        self.need("{")
        while not self.is_("}"):
            start = self.peek().start if self.peek() else 0
            kind = False
            if self.is_("type") and not (self.is_(",", 1) or self.is_("}", 1) or (self.is_("as", 1) and not (self.is_("as", 2) or (self.is_(",", 2) or self.is_("}", 2))))):
                self.take()
                kind = True
            first = second = self.name()
            if self.is_("as"):
                self.take()
                second = self.name()
            found.append((first, second, kind, start, self.tokens[self.k - 1].end))
            if not self.is_("}"):
                self.need(",")
        self.need("}")
        return found

    def read(self) -> Facts:
        while (t := self.peek()) is not None:
            before = self.tokens[self.k - 1] if self.k else None
            member = before is not None and before.text in (".", "?") and before.kind == "punct"
            if t.kind == "name" and not member and t.text == "import":
                self.imports(t)
            elif t.kind == "name" and not member and t.text == "require" and self.is_("(", 1):
                self.call(t, "require", "nonliteral require may hide a consumer")
            elif t.kind == "name" and not member and t.text == "export" and t.depth == 0 and not self.is_(":", 1):
                self.export(t)
            else:
                self.k += 1
        return self.facts

    def call(self, t: Token, request: str, unknown: str) -> None:
        literal, close = self.peek(2), self.peek(3)
        if literal is not None and literal.kind == "string" and close is not None and close.text in (")", ","):
            self.facts.uses.append(Use(literal.text, None, None, "value", "dynamic-broad", request, t.start, close.end))
        else:
            self.facts.unknown.append(unknown)
        self.k += 2

    def imports(self, t: Token) -> None:
        if self.is_("(", 1):
            return self.call(t, "dynamic-import", "nonliteral dynamic import may hide a consumer")
        if self.is_(".", 1):
            if self.is_("meta", 2) and self.is_(".", 3) and self.is_("glob", 4):
                self.facts.unknown.append("import.meta.glob is not expanded")
            self.k += 2
            return None
        if t.depth or self.is_(":", 1):
            self.k += 1
            return None
        self.take()
        if self.peek() is not None and self.peek().kind == "string":
            s = self.take()
            self.facts.uses.append(Use(s.text, None, None, "value", "side-effect", "static-import", t.start, s.end))
            return None
        space = "value"
        if self.is_("type") and not self.is_(",", 1) and not (self.is_("from", 1) and not self.is_("from", 2)):
            self.take()
            space = "type"
        found: list[tuple[str, str | None, str | None, str, int, int]] = []
        if self.peek() is not None and self.peek().kind == "name":
            d = self.take()
            if self.is_("="):
                self.facts.unknown.append("import-equals is not lowered")
                return None
            found.append(("default", "default", d.text, space, d.start, d.end))
            if self.is_(","):
                self.take()
        if self.is_("*"):
            star = self.take()
            self.need("as")
            found.append(("namespace", None, self.name(), space, star.start, self.tokens[self.k - 1].end))
        elif self.is_("{"):
            found += [("named", a, b, "type" if kind else space, start, end) for a, b, kind, start, end in self.specifiers()]
        self.need("from")
        source = self.string()
        self.facts.uses += [Use(source.text, imported, local, ns, kind, "static-import", start, end) for kind, imported, local, ns, start, end in found]
        return None

    def export(self, t: Token) -> None:
        self.take()
        space = "value"
        if self.is_("type") and (self.is_("{", 1) or self.is_("*", 1)):
            self.take()
            space = "type"
        if self.is_("*"):
            self.facts.unknown.append("export-all needs expansion over modules")
            while self.peek() is not None and self.peek().kind != "string":
                self.take()
            self.string()
        elif self.is_("{"):
            found = self.specifiers()
            source = None
            if self.is_("from"):
                self.take()
                source = self.string().text
            for local, exported, kind, start, end in found:
                ns = "type" if kind else space
                self.facts.exports.append(Export(exported, local, ns, start, end))
                if source is not None:
                    self.facts.uses.append(Use(source, local, None, ns, "reexport-named", "static-import", start, end))
        elif self.is_("="):
            self.facts.unknown.append("what `export =` gives cannot be told")
        elif self.is_("as"):
            self.facts.unknown.append("a global name given by `export as` cannot be told")
        elif self.is_("default"):
            self.take()
            if self.peek() is None:
                raise NotPlaced("export default of nothing")
            self.facts.exports.append(Export("default", None, "type" if self.is_("interface") else "value", t.start, self.tokens[self.k - 1].end))
        else:
            self.declaration(t)

    def declaration(self, t: Token) -> None:
        while self.is_("@") or (self.peek() is not None and self.peek().kind == "name" and self.peek().text.startswith("@")):
            self.take()  # a decorator's name; its arguments follow
            while self.is_("."):
                self.take()
                self.take()
            if self.is_("("):
                self.skip_group()
        while self.is_("declare") or self.is_("abstract") or (self.is_("async") and self.is_("function", 1)):
            self.take()
        word = self.take()
        if word.text in ("const", "let", "var"):
            if word.text == "const" and self.is_("enum"):
                self.take()
                return self.named(t, ("value", "type"))
            return self.bindings()
        if word.text == "function":
            if self.is_("*"):
                self.take()
            return self.named(t, ("value",))
        if word.text == "class":
            return self.named(t, ("value",))
        if word.text == "enum":
            return self.named(t, ("value", "type"))
        if word.text in ("interface", "type"):
            return self.named(t, ("type",))
        if word.text in ("namespace", "module", "global", "import"):
            self.facts.unknown.append("namespace declaration is not lowered")
            return None
        raise NotPlaced(f"declaration expected at {word.start}")

    def named(self, t: Token, spaces: tuple[str, ...]) -> None:
        name = self.take()
        if name.kind != "name":
            raise NotPlaced(f"name expected at {name.start}")
        self.facts.exports += [Export(name.text, name.text, ns, t.start, name.end) for ns in spaces]

    def bindings(self) -> None:
        """The names that a declaration binds, also by destructuring; initialisers are skipped."""
        base = self.peek().depth if self.peek() is not None else 0
        while True:
            self.pattern()
            while (x := self.peek()) is not None and not (x.depth == base and (x.text in (",", ";") and x.kind == "punct" or self.line_ends(x))):
                if x.kind == "name" and x.text in ("import", "require"):
                    kept = self.k
                    self.imports(x) if x.text == "import" else self.call(x, "require", "nonliteral require may hide a consumer") if self.is_("(", 1) else None
                    if self.k == kept:
                        self.take()
                else:
                    self.take()
            if not self.is_(","):
                return
            self.take()

    def line_ends(self, x: Token) -> bool:
        """Whether a statement word begins here, in a file that leaves semicolons out."""
        return x.kind == "name" and x.text in ("export", "import", "const", "let", "var", "function", "class", "interface", "enum") and self.tokens[self.k - 1].text not in (":", "=", "(", ",", "=>", ".", "typeof", "async", "?", "|", "&") and not self.is_("(", 1)

    def pattern(self) -> None:
        t = self.take()
        if t.kind == "name":
            self.facts.exports.append(Export(t.text, t.text, "value", t.start, t.end))
        elif t.text == "{":
            while not self.is_("}"):
                if self.is_("..."):
                    self.take()
                    self.pattern()
                elif self.is_("["):
                    self.skip_group()
                    self.need(":")
                    self.pattern()
                elif self.is_(":", 1):
                    self.take()
                    self.take()
                    self.pattern()
                else:
                    self.pattern()
                self.default_value(t.depth + 1)
            self.need("}")
        elif t.text == "[":
            while not self.is_("]"):
                if self.is_(","):
                    self.take()
                    continue
                if self.is_("..."):
                    self.take()
                self.pattern()
                self.default_value(t.depth + 1)
            self.need("]")
        else:
            raise NotPlaced(f"binding expected at {t.start}")

    def default_value(self, depth: int) -> None:
        while (x := self.peek()) is not None and not (x.text in ("}", "]") and x.depth == depth - 1 or x.text == "," and x.depth == depth):
            self.take()
        if self.is_(","):
            self.take()

    def skip_group(self) -> None:
        depth = self.take().depth
        while not (self.peek() is not None and self.peek().depth == depth and self.peek().text in _CLOSE):
            self.take()
        self.take()


def module_facts(data: bytes, kind: str) -> Facts:
    """The facts of a source. A file that is not UTF-8, is CommonJS by its kind or does not scan has no facts and one
    reason."""
    if kind in COMMONJS_KINDS:
        return Facts(unknown=["CommonJS exports are not lowered"])
    try:
        text = data.decode("utf-8")
        return _Reader(tokenize(text, kind in ("tsx", "jsx"))).read().ordered().in_bytes(text)
    except UnicodeDecodeError:
        return Facts(unknown=["source is not UTF-8"])
    except NotPlaced as e:
        return Facts(unknown=[f"source does not parse: {e}"])
