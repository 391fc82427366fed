"""Functions paired with their documentation.

Signatures are found by regular expressions over lines; a stack of indentations, braces and
end keywords delimits bodies; the comment block next to a signature, by line distance, or the
string that opens its body is its documentation. Pairs whose documentation says nothing beyond
the name, the signature, bare tags, pointers, placeholders or standing notices are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that may lie between a comment and its signature (attributes and decorators aside).
DISTANCE = 1
#: Most lines of a signature; a bracket that stays open longer begins none.
SIGNATURE_LINES = 500

_MODIFIER = r"(?:pub(?:\([^()]*+\))?|export|default|public|private|protected|internal|static|async|final|abstract|override|virtual|inline|constexpr|extern(?:\s++\"[^\"]*+\")?|unsafe|const|sealed|synchronized|native|local|suspend|open|fileprivate|mutating|class)"
_NAME = r"(?P<name>[^\W\d]\w*+[!?=]?)"
_WORDED = re.compile(rf"^(?P<pad>\s*+)(?:{_MODIFIER}\s++)*+(?P<word>defp?|fn|func|fun|function)\b\s*+\*?\s*+(?:\([^()]*+\)\s*+)?(?:[^\W\d]\w*+(?:::|[.:]))*+{_NAME}")
_ASSIGNED = re.compile(rf"^(?P<pad>\s*+)(?:export\s++)?(?:const|let|var)\s++{_NAME}\s*+=\s*+(?:async\s*+)?(?P<form>function\b|\()")
_TYPED_NAME = re.compile(rf"^[&*]*+(?:\w++::)*+~?{_NAME}$")
_TYPE_WORD = re.compile(r"^(?:[^\W\d][\w:.<>,\[\]&*?]*+|[&*]++|\"\w*+\")$")
#: Before a bracket these open no function.
_STATEMENTS = set("return else new throw case if for while switch catch await let var import using delete typedef goto function with do try elif unless until match yield assert del and or not in is".split())
_OPENS = re.compile(r"^\s*+(?:(?:local\s++)?function\b|def\b|defp\b|class\b|module\b|if\b|unless\b|while\b|until\b|for\b|case\b|begin\b|do\b)|\bdo\s*+(?:\|[^|]*+\|\s*+)?$|\bthen\s*+$")
_INLINE_END = re.compile(r"\bend\b\s*+$")
_END = re.compile(r"^\s*+end\b")
_COMMENT_LINE = re.compile(r"^\s*+(?:///?[/!]?|#(?!\[|!\[|include|define|if|endif|pragma)|--+|;+|%+|\*(?!\w)|/\*)")
_ATTRIBUTE = re.compile(r"^\s*+(?:@\w[\w.]*+(?:\(.*\))?|#!?\[.*\]|\[[A-Z].*\])\s*+$")
_TRIPLE = re.compile(r"^\s*+[rRuUbB]?(\"\"\"|''')")
_FENCED = re.compile(r"^\s*+(`{3,}+|~{3,}+)([^`]*+)$")

_COMMENTED = re.compile(r"(?<!\s)\s++(?://|#(?!\[)|--\s).*$")
_QUOTED = r"\"(?:\\.|[^\"\\])*+(?:\"|$)|'(?:\\.|[^'\\])'"
_CURLY = re.compile(_QUOTED + r"|//.*$|/\*.*?(?:\*/|$)")
_QUIET = re.compile(_QUOTED + r"|'[^'\\]*+'(?=\s*+[,)\]])|//.*$|#(?!\[).*$|--\s.*$|/\*.*?(?:\*/|$)")
_NEXT = re.compile(r"^\s*+(?:(?:pub(?:\([^()]*+\))?|export|default|public|private|protected|static|async|local|unsafe|const|suspend|override)\s++)*+(?:def|fn|func|fun|function|class|struct|impl|interface|trait|enum)\s++\w")
_AFTER_WORD = re.compile(r"^\s*+(?:\{|->|:|=|where\b|throws\b|;|//|#|do\b|$)")
_AFTER_TYPED = re.compile(r"^\s*+(?:(?:const|noexcept|override|final|mutable|volatile|async)\b\s*+)*+(?:(?:throws\s|where\s|->|:)[^{;]*+)?(?:\{|$)")


@dataclass
class Function:
    name: str
    signature: str
    doc: str
    line: int
    end_line: int


@dataclass
class _Open:
    """A function whose body hasn't ended: what was open around it when it began."""

    at: int
    kind: str
    pad: int
    depth: int
    ends: int
    opened: bool = False


def _fences(lines: list[str]) -> set[int]:
    """Lines that open or close fenced code, those inside comments and docstrings left out."""
    out: set[int] = set()
    fence, until = "", None
    for k, line in enumerate(lines):
        m = _FENCED.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                out.add(k)
                fence = ""
        elif until:
            until = None if until in line else until
        elif m:
            out.add(k)
            fence = m[1]
        elif (t := _TRIPLE.match(line)) and line.count(t[1]) == 1:
            until = t[1]
        elif line.lstrip().startswith("/*") and "*/" not in line:
            until = "*/"
    return out


def _closings(lines: list[str], fences: set[int]) -> dict[int, int]:
    """For lines that leave a bracket open the line that closes the first of these, unless another definition comes first."""
    out: dict[int, int] = {}
    stack: list[tuple[int, bool]] = []  # (line, first one open of its line)
    for k, line in enumerate(lines):
        if k in fences or stack and _NEXT.match(line):
            stack = []
        if not any(c in line for c in "()[]"):
            continue
        for c in _QUIET.sub("", line):
            if c in "([":
                stack.append((k, not stack or stack[-1][0] != k))
            elif c in ")]" and stack:
                at, first = stack.pop()
                if first and at < k <= at + SIGNATURE_LINES:
                    out[at] = k
    return out


def _after(text: str, at: int) -> str | None:
    """What follows the bracket that is closed after position `at`; None if none is, or it stays open."""
    depth = 0
    for m in re.finditer(_QUOTED + r"|[()]", text[at:]):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if depth <= 0:
                return text[at + m.end() :] if not depth else None
    return None


def _signature(text: str, below: str, ends_later: bool) -> tuple[str, str, int] | None:
    """(kind, name, indentation) of the function that a line or joined lines declare; a name beside a bracket in prose declares none.

    `below` is the next line that isn't blank: it may hold the brace that opens the body.
    """
    if m := _WORDED.match(text):
        rest, word = text[m.end() :], m["word"]
        at = rest.find("(")
        if at < 0 or rest[:at].strip() and rest.lstrip()[0] not in "<[":
            return ("end", m["name"], len(m["pad"])) if word.startswith("def") and rest.strip() in ("", "do") else None
        after = _after(rest, at)
        if after is None and not rest.rstrip().endswith(("(", ",")):
            return None
        if after is not None and not _AFTER_WORD.match(after) and not (word[0] == "f" and after.rstrip().endswith(("{", "}"))):
            return None
        if word.startswith("def"):
            block = after is None or bool(re.match(r"\s*+(?:->.*)?:", after))
            return "indent" if word == "def" and (block or not ends_later) else "end", m["name"], len(m["pad"])
        lua = word == "function" and after is not None and not after.strip() and not below.lstrip().startswith("{") and ends_later
        return "end" if lua else "brace", m["name"], len(m["pad"])
    if m := _ASSIGNED.match(text):
        after = _after(text, m.end() - 1) if m["form"] == "(" else "=>"
        return ("brace", m["name"], len(m["pad"])) if after and re.match(r"\s*+(?::[^=]++)?=>", after) else None
    at = text.find("(")
    if at <= 0 or "{" not in text and "=>" not in text and not below.lstrip().startswith("{"):
        return None
    head = text[:at].split()
    if not head or head[0] in _STATEMENTS or not (m := _TYPED_NAME.match(head[-1])) or m["name"] in _STATEMENTS or not all(_TYPE_WORD.match(w) for w in head[:-1]):
        return None
    after = _after(text, at)
    if after is None:
        return None
    opened = "{" in after and bool(_AFTER_TYPED.match(after)) or len(head) > 1 and after.lstrip().startswith("=>")
    if opened or len(head) > 1 and below.lstrip().startswith("{") and _AFTER_TYPED.match(after):
        return "brace", m["name"], len(text) - len(text.lstrip())
    return None


def functions(source: str, declared: dict[int, str] | None = None) -> list[Function]:
    """All functions and methods of a source text, with the comment that documents each ('' if none).

    Bodies are delimited in one pass by a stack of open functions: those of an indentation end where a line comes
    back to it, those of braces where their depth is reached again, those of end keywords at their own `end`. Fenced
    code is code of its own: neither comments nor bodies reach over a fence. `declared` names lines (from 1) that are
    known to declare a function, whatever they look like.
    """
    lines = re.split(r"\r\n|\n|\r", source)
    fences = _fences(lines)
    closings = _closings(lines, fences)
    last_end = max((k for k, x in enumerate(lines) if _END.match(x)), default=-1)
    below = [""] * (len(lines) + 1)  # the next line that isn't blank
    for k in range(len(lines) - 1, -1, -1):
        below[k] = below[k + 1] if k + 1 >= len(lines) or not lines[k + 1].strip() else lines[k + 1]
    out: list[Function] = []
    stack: list[_Open] = []
    block: list[str] = []  # comment lines just met, the last of them on line `closed`
    closed, until, ink, depth, ends = -1, None, -1, 0, 0

    def end(line: int) -> None:
        out[stack.pop().at].end_line = line + 1

    def count(first: int, last: int, declared: bool) -> None:
        """Braces and end keywords of lines, and what they end."""
        nonlocal depth, ends
        for k in range(first, last + 1):
            line = lines[k]
            plain = _CURLY.sub("", line) if "{" in line or "}" in line else ""
            depth += plain.count("{") - plain.count("}")
            if stack and stack[-1].kind == "brace":
                stack[-1].opened |= "{" in plain
                while stack and stack[-1].kind == "brace" and stack[-1].opened and depth <= stack[-1].depth:
                    end(k)
                if k == last and stack and stack[-1].kind == "brace" and not stack[-1].opened and (line.rstrip().endswith(";") or k + 1 >= len(lines) or not lines[k + 1].strip()):
                    end(k)
            elif stack and stack[-1].kind == "end" and not declared:
                if _END.match(line):
                    ends -= 1
                    if ends <= stack[-1].ends:
                        end(k)
                elif _OPENS.search(line) and not _INLINE_END.search(line):
                    ends += 1

    k = 0
    while k < len(lines):
        line = lines[k]
        if k in fences:
            while stack:
                end(ink if stack[-1].kind == "indent" else k - 1)
            block, closed, until, depth, ends = [], -1, None, 0, 0
            k += 1
            continue
        if until is not None:
            block.append(line)
            closed = k
            if until in line:
                until = None
            ink = k if line.strip() else ink
            k += 1
            continue
        if not line.strip():
            k += 1
            continue
        indent = len(line) - len(line.lstrip())
        while stack and stack[-1].kind == "indent" and indent <= stack[-1].pad:
            end(ink)
        opening = "*/" if line.lstrip().startswith("/*") and "*/" not in line else None
        triple = _TRIPLE.match(line)
        if triple and line.count(triple[1]) == 1:
            opening = triple[1]
        if opening or triple or _COMMENT_LINE.match(line):
            if k - closed > DISTANCE + 1:
                block = []
            block.append(line)
            closed, until, ink = k, opening, k
            k += 1
            continue
        if _ATTRIBUTE.match(line):
            closed += 1 if closed == k - 1 else 0
            ink = k
            k += 1
            continue
        last, whole = k, line
        if k in closings and (_NEXT.match(line) or _COMMENTED.sub("", line).rstrip().endswith(("(", ",", "["))):
            last = closings[k]
            inner = [_COMMENTED.sub("", x).strip() for x in lines[k : last + 1]]
            whole = re.match(r"\s*", line)[0] + re.sub(r"([(\[]) | (?=[)\]])", r"\1", " ".join(x for x in inner if x))
        found = _signature(whole, below[last], last_end > last)
        if found is None and declared and k + 1 in declared:
            found = "brace", declared[k + 1], indent
        if found is None:
            last = k
            count(k, k, False)
        else:
            kind, name, pad = found
            if stack and stack[-1].kind == "brace" and not stack[-1].opened:
                end(ink)  # one without a body
            doc = "\n".join(block) if block and k - closed - 1 <= DISTANCE else ""
            first = last + 1
            while kind == "indent" and first + 1 < len(lines) and not lines[first].strip() and first not in fences:
                first += 1
            if not doc and kind == "indent" and first < len(lines) and (t := _TRIPLE.match(lines[first])) and len(lines[first]) - len(lines[first].lstrip()) > pad:
                held = [lines[first]]
                for j in range(first + 1, len(lines)):
                    if held[-1].count(t[1]) and (len(held) > 1 or held[0].count(t[1]) > 1) or j in fences:
                        break
                    held.append(lines[j])
                doc = "\n".join(held)
            stack.append(_Open(len(out), kind, pad, depth, ends))
            ends += kind == "end"
            out.append(Function(name, whole.strip().rstrip("{").strip(), doc, k + 1, last + 1))
            count(k, last, True)
        block = []
        ink = last
        k = last + 1
    while stack:
        end(ink if stack[-1].kind == "indent" else len(lines) - 1)
    return out


# Words that stand for documentation still to be written, and what they ask for.
PLACEHOLDERS = "todo fixme xxx tbd tba hack wip n/a na none null nil undocumented placeholder missing lorem ipsum pendiente por hacer completar a fazer preencher à a compléter completer faire zu erledigen offen fehlt noch ausfüllen задача сделать todo: 待办 待补充 待定 要修正 要確認 未記入 未定 할일 할 일 작성 예정 추후 قيد الإنجاز لاحقا करना है बाद में รอเขียน ต้องทำ"
ASKED = "docs doc document documentation describe description write fill add explain implement later here me this it beschreibung beschreiben описать описание documentar describir documenter décrire descrever comment comments text please needed required"
# Words that only introduce the name again.
FILLER = "a an the this that these those it its is are was be been being of to in on for and or with by from as at which used use uses using order item method function func fn class struct enum trait interface type module macro constant variable field property value object instance implementation helper utility routine procedure gets get sets set returns return represents represent implements implement defines define provides provide performs perform does do makes make creates create given new constructor holds hold contains contain handles handle describes simple"
# Standing notices.
NOTICES = r"licensed under|all rights reserved|\bcopyright\b|\(c\)\s*\d{4}|spdx-license|this file is part of|follows the terms of|see the (?:notice|license|licence|copying)|(?:auto|automatically)[- ]?generated|^\W*generated (?:by|from|with)|do not (?:edit|modify)|don't edit|see the build output|permission is hereby granted|without warranty|bajo (?:la )?licencia|généré automatiquement|automatisch erzeugt|自动生成|自動生成"

_PLACEHOLDER_WORDS, _ASKED, _FILLER = set(PLACEHOLDERS.split()), set(ASKED.split()), set(FILLER.split())
_NOTICE = re.compile(NOTICES, re.I)
_SYNTAX = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)(?=\s|$|@)|//[/!]*|#+(?=\s|$)|--+(?=\s|$)|;+|%+|\"\"\"|'''|<!--)?[ \t]?", re.M)
_SYNTAX_END = re.compile(r"(?:(?<!\*)\*++/|\"\"\"|'''|-->)\s*$", re.M)
_FENCE_BLOCK = re.compile(r"^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_XML = re.compile(r"</?[A-Za-z][^<>]*/?>")
_BRACED = re.compile(r"\{@\w[^{}]*+\}")
_TAG_LINE = re.compile(r"^[ \t]*(?:[@\\](?P<tag>\w+)|:(?P<field>[\w ]+):|#(?P<region>(?:end)?region\b.*)|(?P<section>(?:Args|Arguments|Parameters|Params|Returns|Raises|Throws|Yields)):)(?P<rest>.*)$", re.M)
_NAMED_TAGS = {"param", "arg", "argument", "throws", "throw", "exception", "raises", "raise", "tparam", "typeparam", "property", "prop", "field", "var", "type", "rtype", "template"}
_POINTER_TAGS = {"see", "link", "seealso", "sa", "inheritdoc", "copydoc", "ref", "since", "version", "author", "date", "override", "internal", "private", "public", "protected", "ignore", "hidden", "meta", "api", "deprecated", "category", "package", "module", "file"}
_POINTER = re.compile(r"^\W*(?:see(?: also)?|cf\.?|refer to|siehe|vgl\.?|voir|véase|ver|см\.?|参见|参照)(?:\s*+:)?\s++(?:the\s++)?[`'\"]?[\w./:#()<>-]++[`'\"]?\W*+$", re.I)
_CODE_LINE = re.compile(r"->|=>|::\w+\(|^\s*(?:(?:pub|async|static|export|public|private|protected|inline|unsafe|extern|abstract|final|override)\s+)*(?:fn|def|func|function|let|const|var|class|struct|enum|interface|trait|impl|macro_rules!|type|mod|module|namespace|import|use|package)\s+\S+\s*[(<{=:;]|[;{}]\s*$|^\s*(?:[\w<>\[\]:*&]+\s+)+\w+\([^.!?]*\)\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PART = re.compile(r"[A-ZÀ-ÞА-Я]+(?![^\W\d_A-ZÀ-ÞА-Я])|[A-ZÀ-ÞА-Я]?[^\W\d_A-ZÀ-ÞА-Я]+|\d+")


def _stem(w: str) -> str:
    w = unicodedata.normalize("NFC", w).casefold().replace("’", "'").removesuffix("'s")
    for end in ("ing", "ies", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w.removesuffix("e") if len(w) > 3 else w


def _parts(text: str) -> set[str]:
    return {_stem(p) for p in _PART.findall(text)} | {_stem(w) for w in _WORD.findall(text)}


def plain_doc(doc: str) -> str:
    """The text of a documentation comment, without comment syntax, code, tags, pointers and notices."""
    text = _SYNTAX_END.sub("", doc.replace("\r\n", "\n").replace("\r", "\n"))
    text = _SYNTAX.sub("", text)
    text = _SYNTAX.sub("", _SYNTAX_END.sub("", text))
    text = _BRACED.sub(" ", _FENCE_BLOCK.sub("\n", text))
    text = _XML.sub(lambda m: "\n" if m[0].startswith("<br") else " ", text)

    def tag(m: re.Match) -> str:
        name = (m["tag"] or (m["field"] or "").split(" ")[0]).casefold()
        rest = m["rest"].strip()
        if m["region"] or m["section"] and not rest:
            return ""
        if name in _NAMED_TAGS:
            inline = (m["field"] or "").split(" ")[1:]
            rest = rest if inline else re.sub(r"^(?:\{[^}]*\}\s*)?\[?[\w.$*]+\]?\s*[-:]?\s*", "", rest)
        elif name in _POINTER_TAGS:
            rest = "" if len(rest.split()) <= 2 else rest
        return rest

    text = _TAG_LINE.sub(tag, text)
    kept = []
    for line in text.split("\n"):
        if not _CODE_LINE.search(line) and not _POINTER.match(line):
            kept.append(line)
        else:
            kept.append("")
    out = []
    for paragraph in re.split(r"\n\s*\n", "\n".join(kept)):
        for sentence in re.split(r"(?<=[.!?。！？])\s+", paragraph):
            if not _NOTICE.search(sentence):
                out.append(sentence)
    return "\n".join(x for x in out if x.strip())


def informative(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation says anything beyond the name, the signature and what needs no reading.

    Null and blank documentation says nothing; a null name or signature counts as empty.
    """
    if not doc or not doc.strip():
        return False
    text = plain_doc(doc)
    unspaced = re.findall(r"[぀-ヿ㐀-鿿฀-๿]+", text)
    own = _parts(name or "") | _parts(signature or "")
    if unspaced:
        rest = "".join(unspaced)
        for p in sorted(_PLACEHOLDER_WORDS, key=len, reverse=True):
            rest = rest.replace(p, "")
        for run in re.findall(r"[぀-ヿ㐀-鿿฀-๿]+", name or ""):
            rest = rest.replace(run, "")
        alone = not _WORD.search(re.sub(r"[぀-ヿ㐀-鿿฀-๿]+", " ", text))  # a short run beside words is a term or what is to do
        if len(rest) >= 4 or alone and len(rest) >= 2 and rest == "".join(unspaced) and rest not in (name or ""):
            return True
        text = re.sub(r"[぀-ヿ㐀-鿿฀-๿]+", " ", text)
    words = [w for w in _WORD.findall(text) if len(w) > 1 or not w.isascii()]
    if not words:
        return False
    low = [w.casefold() for w in words]
    if re.match(r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|задача|wip)\b", text.casefold()) and len(words) <= 4:
        return False
    left = [w for w in low if w not in _PLACEHOLDER_WORDS and w not in _ASKED] if len(low) <= 4 else low
    content = {_stem(w) for w in left if w not in _FILLER}
    split = {s for w in words for s in ({_stem(p) for p in _PART.findall(w)} if _stem(w) not in own else set())}
    beyond = {w for w in content if w not in own and not ({_stem(w)} <= own)}
    return bool(beyond) and bool(split - own - {_stem(f) for f in _FILLER})


def source_functions(sources: DataFrame, id_col: str, text_col: str, documented: bool = False) -> DataFrame:
    """Functions of source texts: (id, name, signature, doc, line, end_line), doc being '' where no comment is attached.

    With `documented` only those with informative documentation. Null and empty sources have none; repeated rows come
    out as often as they are given; other columns are ignored.
    """
    slim = sources.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    schema = T.StructType([slim.schema["id"], *[T.StructField(c, T.StringType()) for c in ("name", "signature", "doc")], T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for f in functions(text):
                    if not documented or informative(f.doc, f.name, f.signature):
                        rows.append(row)
                        found.append(f)
            cols = [pa.array([f.name for f in found], pa.string()), pa.array([f.signature for f in found], pa.string()), pa.array([f.doc for f in found], pa.string()), pa.array([f.line for f in found], pa.int32()), pa.array([f.end_line for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=schema.names)

    return slim.mapInArrow(run, schema)


def code_doc_pairs(sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Functions of source texts with informative documentation, as `source_functions` gives them."""
    return source_functions(sources, id_col, text_col, documented=True)


def as_source(doc: str, signature: str) -> tuple[str, int]:
    """A stored comment and signature as the source lines they came from, with an empty body, and the line of the signature."""
    lines = re.split(r"\r\n|\n|\r", doc)
    held = doc.strip()
    whole = any(held.startswith(a) and len(held) >= len(a) + len(b) and held.find(b, len(a)) == len(held) - len(b) for a, b in (("/*", "*/"), ('"""', '"""'), ("'''", "'''")))
    if not whole and (held.startswith("/*") or not all(_COMMENT_LINE.match(x) and "/*" not in x or not x.strip() for x in lines)):
        lines = [f"// {x}" for x in lines]
    while lines and not lines[-1].strip():
        lines.pop()
    head = signature.split("\n")[0].strip().rstrip("{").rstrip()
    body = [f"{head.rstrip(':')}:", "    pass"] if re.match(r"(?:async\s+)?def\b", head) else [f"{head.rstrip(';')} {{", "}"]
    return "\n".join([*lines, *body]), len(lines) + 1


def stored_pairs(rows: DataFrame, id_col: str, name_col: str, signature_col: str, doc_col: str) -> DataFrame:
    """Pairs (id, name, signature, doc) of stored rows whose documentation is informative.

    Each row's comment and signature are set as source, with an empty body, and go through the extractor: a row counts
    only if the comment is attached to the signature's line. That line declares a function by the row's own kind, so a
    null or odd signature is no reason to drop the row; null and blank documentation is.
    """
    slim = rows.filter(F.length(F.trim(F.col(doc_col))) > 0).select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(signature_col).alias("signature"), F.col(doc_col).alias("doc"))

    def attached(name: str, signature: str, doc: str) -> str:
        source, line = as_source(doc, signature)
        return next((f.doc for f in functions(source, {line: name}) if f.line == line), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            yield batch.filter(pa.array([informative(attached(name or "", signature or "", doc), name, signature) for name, signature, doc in columns], pa.bool_()))

    return slim.mapInArrow(run, slim.schema)
