"""Symbols and references of source files, one pass a file on the executors.

Python goes through its own parser, Rust, ECMAScript, Go, Java, C#, C, C++ and PHP through their
token rules (`grammar.py`); other languages through lines: declarations by patterns, bodies by
braces, indentation, end keywords or a semicolon, comments before a declaration as its
documentation, and names before a parenthesis as calls.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from symvane.functions.text import fnv1a_bytes
from symvane.sources import grammar

#: Bounds of one file: symbols, references, names in an outline, characters of a signature, open declarations.
MOST_SYMBOLS, MOST_REFS, MOST_OUTLINE, MOST_SIGNATURE, MOST_OPEN = 200_000, 20_000, 24, 240, 64
# Words before a parenthesis that are no calls.
KEYWORDS = set("if for while switch match return catch fn func function def class struct enum trait impl let const var new delete sizeof typeof await async yield in is not and or do else elif except with assert print raise throw case when unless until lambda super self this".split())
_MOD = r"(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|internal|static|async|final|abstract|override|virtual|inline|unsafe|extern|const|local|open|sealed|data|partial)\s+)*"
_NAME = r"(?P<name>[^\W\d][\w]*[!?]?)"
#: Patterns by language: (kind, pattern); the first that matches a line declares.
COMMON = [
    ("class", rf"^\s*{_MOD}(?:class|object|record)\s+{_NAME}"), ("struct", rf"^\s*{_MOD}struct\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum(?:\s+class)?\s+{_NAME}"),
    ("interface", rf"^\s*{_MOD}(?:interface|protocol)\s+{_NAME}"), ("trait", rf"^\s*{_MOD}trait\s+{_NAME}"), ("module", rf"^\s*{_MOD}(?:mod|module|namespace|package)\s+(?P<name>[\w.:\\]+)"),
    ("type", rf"^\s*{_MOD}(?:type|typedef|using)\s+{_NAME}\s*(?:=|\b)"), ("macro", rf"^\s*(?:macro_rules!\s*{_NAME}|\#define\s+(?P<name2>\w+))"),
    ("function", rf"^\s*{_MOD}(?:fn|func|fun|function\*?|def|defp?|sub|proc)\s+(?:\([^)]*\)\s*)?(?:self\.)?{_NAME}"),
    ("constant", rf"^\s*{_MOD}(?:const|static|final)\s+(?:mut\s+)?{_NAME}\s*[:=]"), ("variable", rf"^\s*{_MOD}(?:let|var|val|local)\s+(?:mut\s+)?{_NAME}\s*[:=]"),
]
SPECIAL = {
    "shell": [("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?")],
    "r": [("function", r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(")],
    "clojure": [("function", r"^\s*\(defn-?\s+(?P<name>[\w!?*<>=/+-]+)"), ("variable", r"^\s*\(def\s+(?P<name>[\w!?*<>=/+-]+)")],
    "sql": [("type", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|index|type)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?P<name>[\w.\"]+)")],
    "haskell": [("function", r"^(?P<name>[a-z][\w']*)\s*::"), ("type", r"^(?:data|newtype|type|class)\s+(?P<name>[A-Z]\w*)")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(?P<name>\w+)"), ("struct", r"^\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?struct")],
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[!?]?)"), ("macro", r"^\s*defmacrop?\s+(?P<name>\w+[!?]?)")],
    "java": [("method", rf"^\s*(?!return\b|new\b|throw\b|else\b){_MOD}(?:<[^>]+>\s+)?[\w<>\[\],.?]+\s+{_NAME}\s*\([^;]*$")],
}
SPECIAL |= {k: SPECIAL["java"] for k in ("csharp", "c", "cpp", "kotlin", "scala")}
SEPARATOR = {"rust": "::", "cpp": "::", "c": "::", "ruby": "::", "php": "::"}
ENDED = {"ruby", "lua", "elixir"}
INDENTED = {"haskell", "text"}
_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|for|case|begin|function|defmodule|defp?|defmacro)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|\bthen\s*$|\bfunction\s*\(")
_CALL = re.compile(r"(?:(?P<q>[\w$)\]]+)(?:\.|::|->))?(?P<n>[^\W\d]\w*)\s*\(")
_COMMENT = re.compile(r"^\s*(?://[/!]?|#(?!\[|!|define|include)|--|;+|%|\*|/\*+)\s?")


@dataclass
class Extract:
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    lines: int = 0
    parse_errors: int = 0


def _hash(text: str) -> int:
    return fnv1a_bytes(" ".join(text.split()).encode())


def _visibility(line: str, name: str, language: str) -> str:
    if language == "python":
        return "private" if name.startswith("_") else "public"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if re.match(r"\s*pub\b", line) else "private"
    found = re.search(r"\b(public|private|protected|internal|export)\b", line)
    return "unknown" if not found else "public" if found[1] in ("public", "export") else "private"


def _ends(lines: list[str], at: int, language: str) -> int:
    """Last line of a declaration that starts on line `at`."""
    if language in ENDED:
        depth = 0
        for k in range(at, len(lines)):
            depth += bool(_OPEN.search(lines[k])) - bool(re.match(r"^\s*end\b", lines[k])) - bool(k == at and re.search(r"\bend\s*$", lines[k]) and not re.match(r"^\s*end\b", lines[k]))
            if depth <= 0:
                return k
        return len(lines) - 1
    if language in INDENTED:
        pad, last = len(lines[at]) - len(lines[at].lstrip()), at
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= pad:
                    break
                last = k
        return last
    depth, opened = 0, False
    for k in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*$", "", lines[k])
        for c in bare:
            if c in "{(" :
                depth += 1
                opened |= c == "{"
            elif c in "})":
                depth -= 1
        if opened and depth <= 0 or not opened and depth <= 0 and (bare.rstrip().endswith(";") or k > at or not bare.rstrip().endswith((",", "=", "{"))):
            return k
    return len(lines) - 1


def lexical(text: str, language: str) -> Extract:
    """Symbols and references by lines."""
    out = Extract(lines=text.count("\n") + (1 if text and not text.endswith("\n") else 0))
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    patterns = [(k, re.compile(p)) for k, p in SPECIAL.get(language, []) + COMMON]
    stack: list[tuple[int, int]] = []  # (symbol, last line)
    comment: list[str] = []
    for i, line in enumerate(lines):
        while stack and stack[-1][1] < i:
            stack.pop()
        if _COMMENT.match(line) and not re.match(r"^\s*#define", line):
            comment.append(_COMMENT.sub("", line).rstrip().removesuffix("*/").rstrip())
            continue
        declared = -1
        for kind, pattern in patterns:
            m = pattern.match(line)
            if m and len(out.symbols) < MOST_SYMBOLS and len(stack) < MOST_OPEN:
                name = (m.groupdict().get("name") or m.groupdict().get("name2") or "").strip('"')
                if not name or name in KEYWORDS:
                    continue
                end = _ends(lines, i, language)
                parent = stack[-1][0] if stack else None
                if kind == "function" and parent is not None and out.symbols[parent]["kind"] in ("class", "struct", "interface", "trait", "enum"):
                    kind = "method"
                sep = SEPARATOR.get(language, ".")
                qualified = f"{out.symbols[parent]['qualified_name']}{sep}{name}" if parent is not None else name
                body = "\n".join(lines[i : end + 1])
                signature = line.strip().rstrip("{").rstrip()[:MOST_SIGNATURE]
                declared = len(out.symbols)
                out.symbols.append({"seq": declared, "name": name, "qualified_name": qualified, "kind": kind, "signature": signature, "doc": "\n".join(comment).strip() or None, "visibility": _visibility(line, name, language), "start_line": i + 1, "end_line": end + 1, "start_byte": starts[i], "end_byte": starts[end + 1] - 1, "parent_seq": parent, "outline": [], "sig_hash": _hash(signature), "body_hash": _hash(body)})
                if end > i:
                    stack.append((declared, end))
                break
        if line.strip() and not line.strip().startswith(("@", "#[")):
            comment = []
        own = declared if declared >= 0 else stack[-1][0] if stack else None
        for m in _CALL.finditer(line):
            if m["n"] in KEYWORDS or declared >= 0 and m["n"] == out.symbols[declared]["name"] or len(out.refs) >= MOST_REFS:
                continue
            out.refs.append({"owner_seq": own, "name": m["n"], "kind": "call", "line": i + 1, "qualifier": m["q"]})
            for s in {own, *(k for k, _ in stack)} - {None}:
                held = out.symbols[s]["outline"]
                if len(held) < MOST_OUTLINE and m["n"] not in held:
                    held.append(m["n"])
    return out


def python_source(text: str) -> Extract:
    """Symbols and references by Python's parser; a file it can't read goes by lines and counts an error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out = lexical(text, "text")
        out.parse_errors = 1
        return out
    out = Extract(lines=text.count("\n") + (1 if text and not text.endswith("\n") else 0))
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)

    def visit(node: ast.AST, owner: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            now = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and len(out.symbols) < MOST_SYMBOLS:
                inside = out.symbols[owner] if owner is not None else None
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside and inside["kind"] == "class" else "function"
                first, last = child.lineno, child.end_lineno or child.lineno
                signature = lines[first - 1].strip().rstrip(":")[:MOST_SIGNATURE]
                now = len(out.symbols)
                out.symbols.append({"seq": now, "name": child.name, "qualified_name": f"{inside['qualified_name']}.{child.name}" if inside else child.name, "kind": kind, "signature": signature, "doc": ast.get_docstring(child), "visibility": _visibility("", child.name, "python"), "start_line": first, "end_line": last, "start_byte": starts[first - 1], "end_byte": starts[last] - 1, "parent_seq": owner, "outline": [], "sig_hash": _hash(signature), "body_hash": _hash("\n".join(lines[first - 1 : last]))})
                if isinstance(child, ast.ClassDef):
                    for base in child.bases:
                        if isinstance(base, (ast.Name, ast.Attribute)):
                            out.refs.append({"owner_seq": now, "name": base.id if isinstance(base, ast.Name) else base.attr, "kind": "inherit", "line": child.lineno, "qualifier": None})
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)) and len(out.refs) < MOST_REFS:
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr
                q = None
                if isinstance(child.func, ast.Attribute):
                    q = ast.unparse(child.func.value) if isinstance(child.func.value, (ast.Name, ast.Attribute)) else "(expr)"
                out.refs.append({"owner_seq": owner, "name": name, "kind": "call", "line": child.lineno, "qualifier": q})
                at = owner
                while at is not None:
                    held = out.symbols[at]["outline"]
                    if len(held) < MOST_OUTLINE and name not in held:
                        held.append(name)
                    at = out.symbols[at]["parent_seq"]
            elif isinstance(child, ast.AnnAssign) and isinstance(child.annotation, ast.Name):
                out.refs.append({"owner_seq": owner, "name": child.annotation.id, "kind": "type", "line": child.lineno, "qualifier": None})
            visit(child, now)

    visit(tree, None)
    return out


def _read(text: str, language: str) -> Extract:
    read = grammar.Reader(text, language).read()
    return Extract(read.symbols, read.refs, text.count("\n") + (1 if text and not text.endswith("\n") else 0), read.errors)


_CPP = re.compile(r"\b(?:class|template|namespace|typename|constexpr|nullptr)\b|\b(?:public|private|protected)\s*:|::")


def extract(text: str, language: str) -> Extract:
    """Symbols and references of a file; a C file with errors that looks like C++ is read again as such, and kept so if errors are fewer."""
    if language == "python":
        return python_source(text)
    if language not in grammar.LANGUAGES:
        found = lexical(text, language)
        found.parse_errors = int(language not in ENDED | INDENTED and text.count("{") != text.count("}"))
        return found
    found = _read(text, language)
    if language == "c" and _CPP.search(text):
        found.parse_errors += len(_CPP.findall(text))  # what C has no words for
        again = _read(text, "cpp")
        if again.parse_errors < found.parse_errors:
            return again
    return found


SYMBOL_ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("name", "qualified_name", "kind", "signature", "doc", "visibility")], *[T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "start_byte", "end_byte", "parent_seq")], T.StructField("outline", T.ArrayType(T.StringType())), T.StructField("sig_hash", T.LongType()), T.StructField("body_hash", T.LongType())])
REF_ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("owner_seq", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("qualifier", T.StringType())])


def _rows(sources: DataFrame, schema: T.StructType, part: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"]):
                rows += [{"path": path} | r for r in getattr(extract(text or "", language), part)]
            frame = pd.DataFrame(rows, columns=schema.names)
            for f in schema:
                if isinstance(f.dataType, T.IntegerType):
                    frame[f.name] = frame[f.name].astype("Int32")
            yield frame

    return sources.select("path", "language", "text").mapInPandas(run, schema)


def symbol_rows(sources: DataFrame) -> DataFrame:
    """Symbols of sources (path, language, text)."""
    return _rows(sources, SYMBOL_ROWS, "symbols")


def ref_rows(sources: DataFrame) -> DataFrame:
    """References of sources (path, language, text)."""
    return _rows(sources, REF_ROWS, "refs")
