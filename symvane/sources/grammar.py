"""Declarations and references of languages with braces, from one pass over tokens.

Tokens up to a brace, a semicolon or a line end that closes a statement form a head. Rules of the
language tell what a head declares; what follows in braces is its scope, a module, a type or a
callable. A stack of scopes names declarations after what they stand in, gives references to the
innermost symbol, and adds calls to the outlines of all symbols around them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from symvane.functions.text import fnv1a_bytes, fnv1a_many

#: Bounds of one file: symbols, references, names in an outline, characters of a signature, open scopes, and those among them that declare.
MOST_SYMBOLS, MOST_REFS, MOST_OUTLINE, MOST_SIGNATURE, MOST_OPEN, MOST_DECLARED = 200_000, 20_000, 24, 240, 4_096, 64
# Words before a bracket that call nothing.
NO_CALLS = set("if for while switch match return catch throw new delete sizeof typeof await yield in is not and or do else elif case when until with assert function fn func fun super defer go select foreach using lock fixed synchronized instanceof as where let const var try finally echo print isset empty list array pub import package crate extern async".split())
# Words of a head that name no type.
NO_TYPES = set("Self String Object None Some Ok Err True False".split())
LANGUAGES = {"rust", "javascript", "typescript", "tsx", "go", "java", "csharp", "c", "cpp", "php"}
SEPARATOR = {"rust": "::", "cpp": "::", "c": "::", "php": "::"}
_ECMA, _JVM, _CFAM = ("javascript", "typescript", "tsx"), ("java", "csharp"), ("c", "cpp")

#: Signs that go on with a name in scripts that write vowels as marks.
_MARKS = "\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_STRING = r"\"(?:\\.|[^\"\\])*+(?:\"|$)"
_QUOTE = {"rust": r"'(?:\\(?:u\{[^}]*\}|.)|[^'\\])'|'[^\W\d]\w*+", "go": r"'(?:\\.|[^'\\\n])*+'|`[^`]*+`?", "c": r"'(?:\\.|[^'\\\n])*+'", "java": r"'(?:\\.|[^'\\\n])*+'"}
_QUOTE |= {"cpp": _QUOTE["c"], "csharp": _QUOTE["c"], "php": r"'(?:\\.|[^'\\])*+'?", **dict.fromkeys(_ECMA, r"'(?:\\.|[^'\\\n])*+'?|`(?:\\.|[^`\\])*+`?")}


def _lexer(language: str) -> re.Pattern:
    comment = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)" + (r"|\#(?!\[)[^\n]*+" if language == "php" else "")
    raw = r"r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|" if language == "rust" else "\"\"\"[\\s\\S]*?(?:\"\"\"|\\Z)|" if language in _JVM else ""
    line = r"(?P<pre>^[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*+)|" if language in (*_CFAM, "csharp") else ""
    name = rf"[\$#@]?[^\W\d][\w${_MARKS}]*+" if language in _ECMA else rf"\$?[^\W\d][\w{_MARKS}]*+" if language == "php" else rf"@?[^\W\d][\w{_MARKS}]*+"
    return re.compile(rf"{line}(?P<comment>{comment})|(?P<string>{raw}{_STRING}|{_QUOTE[language]})|(?P<name>{name})|(?P<number>\d[\w.]*+)|(?P<end>\n)|(?P<blank>[^\S\n]++)|(?P<mark>::|->|=>|\?\.|\.\.\.|<\?php|\?>|.)", re.M)


_LEXERS = {x: _lexer(x) for x in LANGUAGES}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int


@dataclass
class Scope:
    kind: str  # module, type, callable, group or block
    symbol: int | None
    prefix: str
    access: str
    saved: list[Token] | None = None  # the head that goes on after the brace, and brackets open in it
    brackets: int = 0
    word: str = ""
    told: int = 0
    declares: bool = False


@dataclass
class Decl:
    kind: str
    name: Token
    scope: str | None = None  # what its braces are
    bases: list[str] = field(default_factory=list)
    access: str | None = None
    owner: str | None = None  # the type it belongs to, where that isn't the scope around
    virtual: bool = False  # opens the scope of `owner` and declares nothing
    whole: bool = False  # the signature is the whole head


class Reader:
    """One file; `symbols` and `refs` as rows of the extractor."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.sep = text, language, SEPARATOR.get(language, ".")
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.named: dict[str, int] = {}
        self.scopes = [Scope("module", None, "", "public")]
        self.errors = 0

    # the rules of each language: what a head declares

    def rust(self, head: list[Token], end: str) -> Decl | None:
        k, access = 0, None
        while k < len(head) and head[k].text in ("pub", "default", "unsafe", "async", "extern", "const") or k < len(head) and head[k].kind == "string":
            if head[k].text == "const" and k + 1 < len(head) and head[k + 1].text not in ("fn", "unsafe", "async", "extern"):
                break
            if head[k].text == "pub":
                access = "public"
                if k + 1 < len(head) and head[k + 1].text == "(":
                    k += next((i for i, t in enumerate(head[k:]) if t.text == ")"), 0)
            k += 1
        word, rest = (head[k].text if k < len(head) else ""), head[k + 1 :]
        top = self.scopes[-1]
        access = access or ("public" if top.kind == "type" and top.access == "public" else "private")
        if word == "impl":
            rest = _past_angles(rest)
            at = next((i for i, t in enumerate(rest) if t.text == "for"), None)
            target = _first_name(_last_path(rest if at is None else rest[at + 1 :]))
            base = [n.text] if at is not None and (n := _first_name(_last_path(rest[:at]))) else []
            return Decl("", target, "type", base, "private", target.text, True) if target else None
        if word == "macro_rules":
            return Decl("macro", rest[1], "callable", access=access) if len(rest) > 1 else None
        kinds = {"fn": "method" if top.kind == "type" else "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "interface", "mod": "module", "const": "constant", "static": "constant", "type": "type"}
        rest = [t for t in rest if t.text != "mut"] if word == "static" else rest
        if word not in kinds or not rest or rest[0].kind != "name" or word in ("const", "static") and top.kind == "callable":
            return None
        bases = [t.text for t in _until(_after(rest, ":"), ("where",)) if t.kind == "name"] if word == "trait" else []
        scope = {"fn": "callable", "mod": "module", "trait": "type", "struct": "type", "union": "type", "enum": "type"}.get(word, "callable")
        return Decl(kinds[word], rest[0], scope, bases, access, whole=word in ("const", "static", "type"))

    def go(self, head: list[Token], end: str) -> Decl | None:
        top = self.scopes[-1]
        word, rest = (top.word, head) if top.kind == "group" else (head[0].text if head else "", head[1:])
        access = lambda t: "public" if t.text[:1].isupper() else "private"
        if word == "func" and rest and top.kind == "module":
            if rest[0].text == "(":
                close = next((i for i, t in enumerate(rest) if t.text == ")"), None)
                if close is None or close + 1 >= len(rest):
                    return None
                held = [t for t in _past_angles(rest[1:close], anywhere=True) if t.kind == "name"]
                return Decl("method", rest[close + 1], "callable", access=access(rest[close + 1]), owner=held[-1].text if held else None)
            return Decl("function", rest[0], "callable", access=access(rest[0])) if rest[0].kind == "name" else None
        if word in ("type", "const", "var") and rest and rest[0].kind == "name" and top.kind in ("module", "group"):
            if word != "type":
                return Decl("constant" if word == "const" else "variable", rest[0], "callable", access=access(rest[0]), whole=True)
            form = next((t.text for t in rest[1:] if t.text in ("struct", "interface")), "") if end == "{" else ""
            return Decl(form or "type", rest[0], "type" if form else "callable", access=access(rest[0]), whole=not form)
        if top.kind == "type" and top.word == "interface" and len(head) > 1 and head[1].text == "(":
            return Decl("method", head[0], "callable", access=access(head[0]), whole=True)
        return None

    def ecma(self, head: list[Token], end: str) -> Decl | None:
        k, told, top = 0, set(), self.scopes[-1]
        while k < len(head) and (head[k].text in ("export", "default", "async", "declare", "abstract", "static", "public", "private", "protected", "readonly", "override", "get", "set", "*") or head[k].text[0] == "@"):
            if head[k].text[0] == "@":
                k = _past_brackets(head, k + 1)
                continue
            if top.kind == "type" and k + 1 < len(head) and head[k + 1].text in ("(", "=", ":", "?"):
                break  # a member that is so named
            told.add(head[k].text)
            k += 1
        if k >= len(head):
            return None
        word, rest = head[k].text, head[k + 1 :]
        if top.kind == "type":
            hidden = bool(told & {"private", "protected"}) or word[0] == "#"
            name = head[k]
            if name.kind != "name" or top.word == "enum":
                return None
            after = _past_angles(rest)
            arrow = "=" in [t.text for t in rest[:40]] and _is_arrow(_after(rest, "="))
            if after and after[0].text == "(" and (end == "{" or top.word == "interface" or "abstract" in told) or arrow:
                return Decl("method", name, "callable", access="private" if hidden else top.access)
            return None
        access = "public" if "export" in told else "private"
        if word == "function":
            rest = [t for t in rest if t.text != "*"]
            return Decl("function", rest[0], "callable", access=access) if rest and rest[0].kind == "name" else None
        kinds = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module"}
        if word in kinds and rest and rest[0].kind == "name" and (end == "{" or word == "type" and "=" in [t.text for t in rest]):
            bases = [t.text for i, t in enumerate(rest) if t.kind == "name" and i and rest[i - 1].text in ("extends", "implements", ",") and word != "type"]
            return Decl(kinds[word], rest[0], {"class": "type", "interface": "type", "enum": "type"}.get(word, "module" if kinds[word] == "module" else "callable"), bases, access, whole=word == "type")
        if word in ("const", "let", "var") and rest and rest[0].kind == "name" and top.kind == "module":
            value = _after(rest, "=")
            if _is_arrow(value) or value and value[0].text == "function" or len(value) > 1 and value[1].text == "function":
                return Decl("function", rest[0], "callable", access=access)
            return Decl("constant" if word == "const" else "variable", rest[0], "callable", access=access, whole=True)
        return None

    def jvm(self, head: list[Token], end: str) -> Decl | None:
        k, told, top = 0, set(), self.scopes[-1]
        mods = set("public private protected internal static final abstract sealed readonly virtual override async extern unsafe partial default synchronized native transient volatile strictfp required const new event ref".split())
        while k < len(head):
            if head[k].text == "@interface":
                break
            if head[k].text[0] == "@":
                k = _past_brackets(head, k + 1)
            elif head[k].text == "[" and not told:
                k = _past_brackets(head, k)
            elif head[k].text in mods:
                told.add(head[k].text)
                k += 1
            else:
                break
        rest = _past_angles(head[k:])
        if not rest:
            return None
        open_to_all = "public" in told or top.word == "interface" and not told & {"private", "protected"}
        access = "public" if open_to_all else "private" if told & {"private", "protected", "internal"} or self.language == "csharp" else "unknown"
        word = rest[0].text
        kinds = {"class": "class", "interface": "interface", "enum": "enum", "record": "struct", "struct": "struct", "namespace": "module", "@interface": "interface"}
        if word in kinds and len(rest) > 1 and rest[1].kind == "name" and (end == "{" or word in ("record", "namespace")):
            rest = rest[1:] if word == "record" and rest[1].text in ("struct", "class") else rest
            if word == "namespace":
                name = Token("name", "".join(t.text for t in rest[1:]), rest[1].at, rest[1].line)
                return Decl("module", name, "module", access="public")
            tail = _past_brackets(_past_angles(rest[2:]), 0) if rest[2:] and _past_angles(rest[2:])[:1] and _past_angles(rest[2:])[0].text == "(" else 0
            held = _past_angles(rest[2:])[tail:]
            bases = [t.text for i, t in enumerate(held) if t.kind == "name" and i and held[i - 1].text in ("extends", "implements", ",", ":") and t.text not in ("extends", "implements")]
            return Decl(kinds[word], rest[1], "type", bases, access)
        if top.kind != "type":
            return None
        at = next((i for i, t in enumerate(rest) if t.text in ("(", "=")), None)
        if at and rest[at].text == "(" and rest[at - 1].kind == "name" and word not in NO_CALLS and end in ("{", ";", "=>"):
            if at == 1 and rest[0].text != top.prefix.split(self.sep)[-1]:
                return None
            return Decl("method", rest[at - 1], "callable", access=access, whole=True)
        fixed = {"static", "final"} <= told or "const" in told or {"static", "readonly"} <= told
        names = [t for t in rest[:at] if t.kind == "name"]
        return Decl("constant", names[-1], "callable", access=access, whole=True) if fixed and len(names) > 1 and end == ";" else None

    def cfam(self, head: list[Token], end: str) -> Decl | None:
        k, top = 0, self.scopes[-1]
        told = {t.text for t in head if t.text in ("static", "const", "constexpr", "typedef", "extern", "virtual")}
        while k < len(head) and head[k].text in ("static", "inline", "extern", "virtual", "explicit", "constexpr", "friend", "template", "typedef", "public", "private", "protected", ":") or k < len(head) and head[k].kind == "string":
            if head[k].text == "template":
                k += 1
                k = len(head) - len(_past_angles(head[k:]))
            elif head[k].text in ("public", "private", "protected") and k + 1 < len(head) and head[k + 1].text == ":":
                top.access = "public" if head[k].text == "public" else "private"
                k += 2
            else:
                k += 1
        rest = head[k:]
        if not rest:
            return None
        access = top.access if top.kind == "type" else "private" if "static" in told else "public"
        kinds = {"class": "class", "struct": "struct", "union": "struct", "enum": "enum", "namespace": "module"}
        word = rest[0].text
        at = next((i for i, t in enumerate(rest) if t.text == "("), None)
        if word in kinds and end == "{" and at is None:
            names = [t for t in _until(rest[1:], (":",)) if t.kind == "name" and t.text not in ("class", "struct", "final")]
            bases = [t.text for t in _after(rest, ":") if t.kind == "name" and t.text not in ("public", "private", "protected", "virtual")]
            return Decl(kinds[word], names[-1], "module" if word == "namespace" else "type", bases, access) if names else None
        if "typedef" in told or word == "using":
            names = [t for t in (_until(rest[1:], ("=",)) if word == "using" else rest) if t.kind == "name"]
            pointed = [rest[i + 1] for i, t in enumerate(rest[:-1]) if t.text == "*" and i and rest[i - 1].text == "(" and rest[i + 1].kind == "name"]
            name = pointed[0] if pointed else names[0] if word == "using" and names else names[-1] if names else None
            return Decl("type", name, access=access, whole=True) if name and end == ";" and len(names) > (word != "using") and word != "namespace" and rest[1:2] and rest[1].text != "namespace" else None
        if top.kind not in ("module", "type"):
            return None
        if at and rest[at - 1].kind == "name" and rest[at - 1].text not in NO_CALLS and (end == "{" or end == ";" and top.kind == "type") and "=" not in [t.text for t in rest[:at]]:
            owner = self.path_before(rest, at - 2)
            if at == 1 and top.kind != "type" and owner is None:
                return None
            if at > 1 and rest[at - 2].text == "~":
                rest[at - 1].text = f"~{rest[at - 1].text}"
                owner = self.path_before(rest, at - 3)
            return Decl("method" if top.kind == "type" or owner else "function", rest[at - 1], "callable", access=access, owner=owner)
        names = [t for t in _until(rest, ("=", "[")) if t.kind == "name"]
        if top.kind == "module" and at is None and end == ";" and len(names) > 1 and word not in ("return", "goto", "struct", "enum", "extern", "class", "using"):
            return Decl("constant" if told & {"const", "constexpr"} or "const" in [t.text for t in names] else "variable", names[-1], access=access, whole=True)
        return None

    @staticmethod
    def path_before(head: list[Token], k: int) -> str | None:
        """The path that ends in the `::` at k, if there is one."""
        parts: list[str] = []
        while k > 0 and head[k].text == "::" and head[k - 1].kind == "name":
            parts.append(head[k - 1].text)
            k -= 2
        return "::".join(reversed(parts)) or None

    def php(self, head: list[Token], end: str) -> Decl | None:
        k, told, top = 0, set(), self.scopes[-1]
        while k < len(head) and head[k].text in ("public", "private", "protected", "static", "final", "abstract", "readonly", "<?php"):
            told.add(head[k].text)
            k += 1
        rest = head[k:]
        if len(rest) < 2:
            return None
        word, names = rest[0].text, [t for t in rest[1:] if t.kind == "name"]
        access = "private" if told & {"private", "protected"} else "public"
        kinds = {"class": "class", "interface": "interface", "trait": "class", "enum": "enum"}
        if word in kinds and names and end == "{":
            bases = [t.text for i, t in enumerate(rest) if t.kind == "name" and i and rest[i - 1].text in ("extends", "implements", ",")]
            return Decl(kinds[word], names[0], "type", bases, access)
        if word == "namespace" and names:
            name = Token("name", "".join(t.text for t in rest[1:]), rest[1].at, rest[1].line)
            return Decl("module", name, "module" if end == "{" else None, access="public")
        if word == "function" and names and rest[1].text in ("&", names[0].text):
            return Decl("method" if top.kind == "type" else "function", names[0], "callable", access=access, whole=True)
        if word == "const" and names and end == ";" and top.kind in ("module", "type"):
            return Decl("constant", names[0], access=access, whole=True)
        return None

    # the engine

    def read(self) -> Reader:
        rules = self.rust if self.language == "rust" else self.go if self.language == "go" else self.ecma if self.language in _ECMA else self.jvm if self.language in _JVM else self.cfam if self.language in _CFAM else self.php
        lines = self.language == "go" or self.language in _ECMA
        head: list[Token] = []
        docs: list[Token] = []
        doc: list[Token] = []
        brackets, told, line, declared = 0, 0, 1, 0
        for m in _LEXERS[self.language].finditer(self.text):
            kind, token = m.lastgroup if m.lastgroup != "h" else "string", Token(m.lastgroup or "mark", m[0], m.start(), line)
            token.kind = kind
            line += m[0].count("\n")
            if kind == "blank":
                continue
            if kind == "comment":
                if not head:
                    docs = docs + [token] if docs and docs[-1].line + docs[-1].text.count("\n") >= token.line - 1 else [token]
                continue
            if kind == "pre":
                if d := re.match(r"\s*#\s*define\s+(\w+)(\([^)]*\))?", m[0]):
                    name = Token("name", d[1], m.start(), token.line)
                    self.declare(Decl("macro", name, access="public"), [Token("pre", re.sub(r"\s+", " ", d[0].strip()), m.start(), token.line)], docs, m.end())
                docs = []
                continue
            if kind == "end":
                if not (lines and head and not brackets and self.complete(head, m.end())):
                    continue
                self.flush(head[told:], rules(head, "\n"), head, doc, m.start())
                head, docs, told = [], [], 0
                continue
            if not head:
                doc = docs if docs and docs[-1].line + docs[-1].text.count("\n") >= token.line - 1 else []
            c = token.text if kind == "mark" else ""
            if c in ("(", "["):
                if self.language == "go" and c == "(" and len(head) == 1 and head[0].text in ("const", "var", "type") and not brackets:
                    self.scopes.append(Scope("group", self.scopes[-1].symbol, self.scopes[-1].prefix, "public", word=head[0].text))
                    head, docs = [], []
                    continue
                brackets += 1
            elif c in (")", "]"):
                if self.scopes[-1].kind == "group" and not brackets:
                    if head:
                        self.flush(head[told:], rules(head, "\n"), head, doc, m.start())
                    self.scopes.pop()
                    head, docs, told = [], [], 0
                    continue
                brackets = max(brackets - 1, 0)
            if c == "{":
                decl = rules(head, "{") if not brackets else None
                top = self.scopes[-1]
                goes_on = decl is None and (brackets > 0 or bool(head) and head[-1].text in ("=", ",", ":", "?", "return", "+", "&&", "||", ":=", "]", "..."))
                seq = self.flush(head[told:], decl, head, doc, m.start()) if decl or not goes_on else self.flush(head[told:], None, head, doc, m.start())
                if len(self.scopes) >= MOST_OPEN:
                    self.errors += 1
                    break
                if decl and decl.scope and declared < MOST_DECLARED:
                    declared += 1
                    prefix = self.symbols[seq]["qualified_name"] if seq is not None else (f"{top.prefix}{self.sep}" if top.prefix else "") + (decl.owner or decl.name.text)
                    access = decl.access or "private"
                    inner = {"rust": access if decl.kind == "interface" else "private"}.get(self.language, access if decl.kind != "class" or self.language in _ECMA else "private" if self.language in _CFAM else access)
                    inner = "public" if self.language in _CFAM and decl.kind == "struct" else inner
                    self.scopes.append(Scope(decl.scope, seq, prefix, inner, word="virtual" if decl.virtual else decl.kind, declares=True))
                else:
                    self.scopes.append(Scope("block" if top.kind != "module" or goes_on or head else "module", top.symbol, top.prefix, top.access, head if goes_on else None, brackets, told=len(head)))
                    if not goes_on and top.kind == "type":
                        self.scopes[-1].kind = "callable"
                head, docs, brackets, told = [], [], 0, 0
                continue
            if c == "}":
                if head:
                    self.flush(head[told:], rules(head, "}"), head, doc, m.start())
                head, docs, brackets, told = [], [], 0, 0
                if len(self.scopes) == 1:
                    self.errors += 1
                    continue
                gone = self.scopes.pop()
                declared -= gone.declares
                if gone.symbol is not None and gone.symbol != self.scopes[-1].symbol and not gone.word == "virtual":
                    self.close(gone.symbol, m.end(), token.line)
                if gone.saved is not None:
                    gone.saved.append(Token("mark", "{}", m.start(), token.line))
                    head, brackets, told = gone.saved, gone.brackets, gone.told
                continue
            if c == ";" and not brackets:
                self.flush(head[told:], rules(head, ";"), head, doc, m.start())
                head, docs, told = [], [], 0
                continue
            if self.language in ("rust", "php") and c == "]" and not brackets and head and head[0].text == "#":
                head, told = [], 0  # an attribute
                docs = doc + [Token("comment", "", m.start(), token.line)] if doc else []
                continue
            if self.language in _CFAM and c == ":" and len(head) == 1 and head[0].text in ("public", "private", "protected") and self.scopes[-1].kind == "type":
                self.scopes[-1].access = "public" if head[0].text == "public" else "private"
                head, docs = [], []
                continue
            head.append(token)
        if head:
            self.flush(head[told:], rules(head, ";"), head, doc, len(self.text))
        self.errors += len(self.scopes) - 1
        for scope in self.scopes[1:]:
            if scope.symbol is not None:
                self.close(scope.symbol, len(self.text), line)
        self.settle()
        return self

    def complete(self, head: list[Token], after: int) -> bool:
        """Whether a line end closes the statement that the head holds so far."""
        last = head[-1]
        if not (last.kind in ("name", "number", "string") or last.text in (")", "]", "{}", "++", "--")):
            return False
        if self.language == "go":
            return True
        nxt = self.text[after : after + 200].lstrip()[:2]
        return not nxt or not (nxt[0] in ".?:+*/%&|=<>,{)]" and nxt != "/*" and nxt != "//")

    def flush(self, fresh: list[Token], decl: Decl | None, head: list[Token], doc: list[Token], end: int) -> int | None:
        """Declare what the head declares and give its references to it, else to the scope; returns the symbol."""
        seq, name = None, None
        if decl is not None:
            name = decl.name
            if decl.virtual:
                top = self.scopes[-1]
                full = (f"{top.prefix}{self.sep}" if top.prefix else "") + decl.owner
                seq = self.named.get(full, self.named.get(decl.owner))
            else:
                seq = self.declare(decl, head, doc, end)
            for base in decl.bases:
                self.refer(seq, base, "inherit", name.line, None)
        self.references(fresh, seq if decl is not None and seq is not None else self.scopes[-1].symbol, name, decl)
        return seq

    def declare(self, decl: Decl, head: list[Token], doc: list[Token], end: int) -> int | None:
        if len(self.symbols) >= MOST_SYMBOLS:
            return None
        top, seq = self.scopes[-1], len(self.symbols)
        parent, prefix = top.symbol, top.prefix
        if decl.owner:
            prefix = (f"{top.prefix}{self.sep}" if top.prefix else "") + decl.owner
            parent = self.named.get(prefix, self.named.get(decl.owner))
        name = decl.name.text.lstrip("$") if self.language == "php" else decl.name.text
        qualified = f"{prefix}{self.sep}{name}" if prefix else name
        start, k = head[0].at, 0
        while self.language in (*_ECMA, *_JVM) and k < len(head) and (head[k].text[0] == "@" and head[k].text != "@interface" or head[k].text == "[" and self.language == "csharp"):
            k = _past_brackets(head, k if head[k].text == "[" else k + 1)
        told = head[0].text if head[0].kind == "pre" else self.text[head[min(k, len(head) - 1)].at : end]
        signature = re.sub(r"\s+", " ", told).strip()
        signature = signature.split(" => ")[0] if self.language == "csharp" else signature
        if not decl.whole and decl.kind not in ("macro",):
            signature = re.sub(r"\s*(?:=|=>)?\s*$", "", signature)
        if self.language == "rust" and decl.kind == "macro":
            signature = re.sub(r"\s*!\s*", "! ", signature)
        line = head[0].line
        self.symbols.append({"seq": seq, "name": name, "qualified_name": qualified, "kind": decl.kind, "signature": signature[:MOST_SIGNATURE], "doc": _plain(doc), "visibility": decl.access or "unknown", "start_line": line, "end_line": line + self.text.count("\n", start, end), "start_byte": start, "end_byte": end, "parent_seq": parent, "outline": [], "sig_hash": fnv1a_bytes(signature.encode()), "body_hash": 0})
        self.named.setdefault(qualified, seq)
        return seq

    def close(self, seq: int, end: int, line: int) -> None:
        symbol = self.symbols[seq]
        if end > symbol["end_byte"]:
            symbol["end_byte"], symbol["end_line"] = end, line

    def references(self, head: list[Token], owner: int | None, name: Token | None, decl: Decl | None) -> None:
        typed = set()
        if decl is None and self.scopes[-1].kind == "type" and self.scopes[-1].word in ("enum", "struct"):
            return  # variants and fields
        for i, t in enumerate(head):
            if t.kind != "name" or t.text[0] == "@" or t is name or name is not None and t.at == name.at:
                continue
            nxt = head[i + 1].text if i + 1 < len(head) else ""
            before = head[i - 1].text if i else ""
            if nxt == "!" and self.language == "rust" and i + 2 < len(head) and head[i + 2].text in ("(", "["):
                nxt = "("
            if before == "new":
                self.refer(owner, t.text, "type", t.line, None)
            elif nxt == "(" and t.text not in NO_CALLS and before not in ("function", "fn", "func", "#"):
                self.refer(owner, t.text, "call", t.line, self.qualifier(head, i))
            elif decl is not None and not decl.virtual and t.text[:1].isupper() and t.text not in NO_TYPES and t.text not in typed and t.text not in decl.bases and len(t.text) > 1:
                typed.add(t.text)
                self.refer(owner, t.text, "type", t.line, None)

    def qualifier(self, head: list[Token], i: int) -> str | None:
        if i < 1 or head[i - 1].text not in (".", "::", "->", "?."):
            return None
        k, parts = i - 2, []
        while k >= 0 and head[k].kind == "name":
            parts.append(head[k].text)
            if k < 2 or head[k - 1].text not in (".", "::", "->", "?."):
                return "".join(reversed(parts))
            parts.append(head[k - 1].text)
            k -= 2
        return "(expr)"

    def refer(self, owner: int | None, name: str, kind: str, line: int, qualifier: str | None) -> None:
        if len(self.refs) >= MOST_REFS:
            return
        self.refs.append({"owner_seq": owner, "name": name, "kind": kind, "line": line, "qualifier": qualifier})
        around = {owner, *(s.symbol for s in self.scopes)} if kind == "call" else ()
        for s in around:
            if s is not None:
                held = self.symbols[s]["outline"]
                if len(held) < MOST_OUTLINE and name not in held:
                    held.append(name)

    def settle(self) -> None:
        """Offsets in bytes, and hashes of bodies."""
        ascii_only = self.text.isascii()
        marks = sorted({x for s in self.symbols for x in (s["start_byte"], s["end_byte"])})
        size, at, total = {}, 0, 0
        for x in marks:
            total += x - at if ascii_only else len(self.text[at:x].encode())
            size[x], at = total, x
        hashes = fnv1a_many([" ".join(self.text[s["start_byte"] : s["end_byte"]].split()) for s in self.symbols]).tolist()
        for s, hashed in zip(self.symbols, hashes):
            s["body_hash"] = hashed
            s["start_byte"], s["end_byte"] = size[s["start_byte"]], size[s["end_byte"]]


def _plain(doc: list[Token]) -> str | None:
    lines = []
    for t in doc:
        body = re.sub(r"^/\*+!?|\*+/$", "", t.text)
        lines += [re.sub(r"^\s*(?:///?!?|\*(?!/)|#+)\s?", "", x).rstrip() for x in body.split("\n")]
    return "\n".join(lines).strip() or None


def _after(head: list[Token], mark: str) -> list[Token]:
    return next((head[i + 1 :] for i, t in enumerate(head) if t.text == mark), [])


def _until(head: list[Token], marks: tuple[str, ...]) -> list[Token]:
    return next((head[:i] for i, t in enumerate(head) if t.text in marks), head)


def _past_angles(head: list[Token], anywhere: bool = False) -> list[Token]:
    """A head without the angle brackets it begins with, or without all."""
    out, depth = [], 0
    for i, t in enumerate(head):
        if t.text in ("<", "[") and (t.text == "<" or anywhere):
            depth += 1
        elif t.text in (">", "]") and depth:
            depth -= 1
        elif not depth:
            if not anywhere:
                return head[i:]
            out.append(t)
    return out


def _past_brackets(head: list[Token], k: int) -> int:
    """The place after the bracket that opens at k, or k."""
    if k >= len(head) or head[k].text not in ("(", "["):
        return k
    depth = 0
    for i in range(k, len(head)):
        depth += head[i].text in ("(", "[")
        depth -= head[i].text in (")", "]")
        if not depth:
            return i + 1
    return len(head)


def _last_path(head: list[Token]) -> list[Token]:
    """A path's last part: what follows its last `::` before an angle bracket or `where`."""
    head = [t for t in _until(head, ("<", "where")) if t.text not in ("&", "mut", "dyn") and not t.text.startswith("'")]
    at = max((i for i, t in enumerate(head) if t.text == "::"), default=-1)
    return head[at + 1 :]


def _first_name(head: list[Token]) -> Token | None:
    return next((t for t in head if t.kind == "name"), None)


def _is_arrow(value: list[Token]) -> bool:
    if value and value[0].text == "async":
        value = value[1:]
    if not value:
        return False
    if value[0].text == "function":
        return True
    k = len(value) - len(_past_angles(value))
    k = _past_brackets(value, k) if value[k : k + 1] and value[k].text == "(" else k + 1
    return "=>" in [t.text for t in value[k : k + 40]] and (value[0].text in ("(", "<") or len(value) > 1 and value[1].text == "=>")
