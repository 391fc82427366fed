"""Sentence boundaries in texts of many languages and scripts.

A text is cut into blocks first: fenced code is left out, line markers (headings, lists,
quotes, comment signs) are recognised, and blank lines, headings and list items end a block.
Over a block runs a pushdown automaton: its stack holds open quotations and brackets, its
input are the block's terminators and marks; a terminator ends a sentence only at an empty
stack, and only if neither an abbreviation (found by tries over the reversed token) nor the
following text says that the sentence goes on. Blocks keep a map to code points of the text,
so a sentence that runs over a line break keeps the markers inside.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.runtime import spread

# Abbreviations, without the last period.
#: Never the end of a sentence, as written here.
TITLES = "Mr Mrs Ms Dr Prof St Hr Hrn Fr Sr Sra Srta Dra Mme Mlle M MM Lt Col Sgt Rev Hon Messrs Gen"
#: Never the end of a sentence, in small letters.
MIDDLE = "cf vgl approx e.g i.e eg ie vs vers viz resp bzw ca inkl exkl zzgl sog ggf evtl z p.ej p.ex ej ex см напр т.е г-н г-жа ул"
#: Not the end before a number.
NUMBERED = "no nos nr fig figs abb tab eq sec ch vol pp p v s bd art núm num n рис стр табл гл п ст т"
#: The end only if what follows doesn't start with a small letter.
ENDING = "etc usw etc usf u.s.w a.m p.m ff f jr sr inc ltd co corp пр др д т.д т.п г ч мин сек с h min sek s std bl"
#: Words before which a number with a period is an ordinal (am 3. Schritt).
ORDINAL_AFTER = "am im vom zum beim der die das den dem des seit bis ab den dem jeder jede jedes jedem den ersten"
# Characters.
CLOSERS = "”’\"'»›)]}」』）】》〉〕］｝＂＇"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］"}
#: After a closing quotation these go on with the sentence.
GO_ON = "とっなのにをはがもでへや的地得之"


class Trie:
    """Abbreviations, read from their last letter."""

    def __init__(self, words: str):
        self.root: dict = {}
        for w in words.split():
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = True

    def ends(self, token: str) -> bool:
        """Whether the whole token (small letters) is in the trie."""
        node = self.root
        for c in reversed(token):
            node = node.get(c)
            if node is None:
                return False
        return "" in node


_TITLES, _MIDDLE, _NUMBERED, _ENDING, _ORDINAL = Trie(TITLES), Trie(MIDDLE), Trie(NUMBERED), Trie(ENDING), set(ORDINAL_AFTER.split())
_EDGE = "﻿​‌‍⁠­"
_LINE = re.compile(r"\r\n|\n|\r| | ")
_FENCE = re.compile(r"[\s" + _EDGE + r"]*+(?:(?:>|/{2,}+!?|--|\*|#|;++|%++)[ \t]*+)*+(`{3,}+|~{3,}+)([^`\n]*+)$")
_COMMENT = re.compile(r"[\s" + _EDGE + r"]*+(?:(?:///?!?|//!|--+|;+|%+|/\*+!?|\"\"\"|'''|<!--|>|\||＞)(?=\s|$)[ \t ]*)*")
_STAR = re.compile(r"[" + _EDGE + r"]*[ \t]\*(?=\s|$)[ \t]*")
_GLUED = re.compile(r"(?:///?!?|--|>|\"\"\"|''')(?=[^\W\d_]|[“«¿¡])")
_HASH = re.compile(r"(#{1,6})[ \t ]+")
_BULLET = re.compile(r"(?:[-*+•‣◦▪–·]|\[[ xX]\])[ \t 　]+(?:\[[ xX]\][ \t]+)?")
_NUMBER = re.compile(r"\(?(\d{1,3}|[a-zA-Z])([.)])[ \t 　]+")
_BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace()) + _EDGE
_MARK = re.compile("[" + re.escape("".join(PAIRS) + "”»›」』)]}）】》〉］\"") + "]")
_STOP = re.compile(r"[.!?…]+|[。！？｡．؟۔।॥‼⁇⁈⁉]+[.!?…。！？｡]*")
_TOKEN_STOPS = set("([{“”„«»\"「」‚‘")
_NEXT = re.compile(r"[^\s,;:!?)\]}”»]+")
_CODELIKE = re.compile(r"\w*_\w|[^\W\d_]+[a-z\d][A-Z]|\w+(?:/[\w.]+)+|\w+\(|\w+(?:::|\.)\w[.(\w]*$")
_THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-ๅ็-๿])")
_WESTERN = "A-Za-zÀ-ɏЀ-ӿ"
_THAI_OUT = re.compile(rf"(?<=[\u0e00-\u0e7f])\s+(?=[A-ZÀ-ÞА-Я][a-zà-ÿа-яё]*(?:['’][{_WESTERN}]+)?\s+[{_WESTERN}\d][^\s]*\s+[{_WESTERN}\d])")
_ALNUM = re.compile(r"[^\W_]")
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]$")


#: Which openers a closer may close.
_OPENERS = {c: [o for o, ends in PAIRS.items() if c in ends] for c in set("".join(PAIRS.values()))} | {'"': ['"']}


def _tail(line: str) -> int:
    """Where the blanks and the sign that closes a comment at the end of a line begin."""
    held = line.rstrip(_BLANKS)
    for sign in ("*/", "-->", '"""', "'''"):
        if held.endswith(sign):
            held = held[: -len(sign)]
            return len((held.rstrip("*") if sign == "*/" else held).rstrip(_BLANKS))
    return len(held)


def _token(u: str, end: int) -> tuple[int, str]:
    """The token that ends before position `end`, and where it begins."""
    at = end
    while at and not u[at - 1].isspace() and u[at - 1] not in _TOKEN_STOPS:
        at -= 1
    return at, u[at:end]


def _token_before(u: str, end: int) -> str:
    """The token before `end`, blanks between left out."""
    while end and u[end - 1].isspace():
        end -= 1
    return _token(u, end)[1]


def _pairs(u: str) -> list[tuple[int, int]]:
    """Outermost matched quotations and brackets of a block, as (open, close)."""
    stack: list[tuple[str, int]] = []
    held: dict[str, list[int]] = {}  # of each opener its places on the stack
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(u):
        c, i = m[0], m.start()
        at = max((held[o][-1] for o in _OPENERS.get(c, ()) if held.get(o)), default=None)
        if at is not None and (c == '"' or c not in PAIRS or c == "“"):
            found.append((stack[at][1], i))
            for o, _ in stack[at:]:
                held[o].pop()
            del stack[at:]  # what was opened inside and never closed counts as plain text
        elif c in PAIRS or c == '"':
            held.setdefault(c, []).append(len(stack))
            stack.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _ends(u: str, a: int, b: int, e: int, nxt: int, look: int, ink: int) -> bool:
    """Whether the terminator u[a:b], closed by u[b:e] and followed by u[nxt:], ends a sentence.

    `look` is where the next letter or digit stands, `ink` where the block's first character that isn't blank does.
    """
    run, closed, gap = u[a:b], e > b, nxt > e
    c = u[nxt]
    if c in ",;:，、；：،؛)]}）】" and not gap:
        return False
    if run[0] in "。！？｡．‼⁇⁈⁉" or run[0] == "…" and (_cjk(c) or a and _cjk(u[a - 1]) and not gap and not c.isascii()):
        return not (closed and (c in GO_ON or c in ",;:，、；："))
    if not gap:
        return run[0] in "।॥؟۔" and c.isalpha()
    first = u[look] if look < len(u) else c
    small = first.islower()
    if run[0] in "!?؟।॥۔" or (len(run) > 1 and set(run) & set("!?")):
        return not (closed and small)
    word = _NEXT.match(u, look)
    code = bool(word and small and not closed and _CODELIKE.match(word[0].rstrip(".")))
    if len(run) > 1 or run == "…":
        return not small or code
    if closed:
        return not small
    at, token = _token(u, a)
    low = token.casefold()
    digit = first.isdigit() or bool(word and re.match(r"v\d", word[0]))
    if _TITLES.ends(token) or _MIDDLE.ends(low):
        return False
    if _ENDING.ends(low):
        if _NUMBERED.ends(low) and digit:
            return False
        return not small or code
    if _NUMBERED.ends(low) and (digit or len(low) == 1):
        return False
    if len(token) == 1 and token.isalpha():
        if not token.isupper():
            return not small
        before = _token_before(u, at)
        return c in PAIRS or c == '"' or len(before) > 1 and before.isalpha() and before.isupper()  # else an initial
    if _ACRONYM.match(token):
        return not small
    if token.isdigit():
        if at <= ink:
            return False
        if len(token) <= 3 and _token_before(u, at).casefold() in _ORDINAL:
            return False
        return not small or code
    if not small or code:
        return True
    last = re.split(r"['’]", token)[-1]
    return len(last) >= 2 and (last.isalpha() or "/" in last or "_" in last) or token[-1:] in (")", "]", "»", "”")


def split_block(u: str) -> list[tuple[int, int]]:
    """Sentences of one block of running text as (start, end)."""
    pairs = _pairs(u)
    opens = [p[0] for p in pairs]
    quotes = {b for _, b in pairs}
    cuts = []
    ink, look = len(u) - len(u.lstrip()), 0

    def inside(i: int) -> bool:
        k = bisect_right(opens, i) - 1
        return k >= 0 and pairs[k][0] < i <= pairs[k][1]

    for m in _STOP.finditer(u):
        a, b = m.span()
        e = b
        while e < len(u):
            if u[e] in CLOSERS and (u[e] != '"' or e in quotes):
                e += 1
            elif u[e] == "“" and e in quotes:
                e += 1
            elif u[e] in "   " and e + 1 < len(u) and u[e + 1] == "»" and e + 1 in quotes:
                e += 2
            else:
                break
        if e < len(u) and inside(e):
            continue
        nxt = e
        while nxt < len(u) and (u[nxt].isspace() or u[nxt] in _EDGE):
            nxt += 1
        if look < nxt:
            look = nxt
            while look < len(u) and not u[look].isalnum():
                look += 1
        if nxt >= len(u) or _ends(u, a, b, e, nxt, look, ink):
            cuts.append(e)
    if any("฀" <= c <= "๿" for c in u):
        cuts = sorted({*cuts, *(m.start() for form in (_THAI, _THAI_OUT) for m in form.finditer(u) if not inside(m.start()))})
    out, at = [], 0
    for e in [*cuts, len(u)]:
        s = at
        while s < e and (u[s].isspace() or u[s] in _EDGE):
            s += 1
        t = e
        while t > s and (u[t - 1].isspace() or u[t - 1] in _EDGE):
            t -= 1
        if s < t and _ALNUM.search(u, s, t):
            out.append((s, t))
        at = e
    return out


def _closed(text: str, start: int, end: int) -> bool:
    """Whether a line ends in a terminator or colon, whatever marks follow it."""
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        if text[end - 1] in ".!?:…。！？।؟":
            return True
        end -= 1
    return False


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points."""
    out: list[tuple[int, int]] = []
    block: list[tuple[int, int]] = []  # spans of lines' contents

    def flush() -> None:
        if not block:
            return
        u = "\n".join(text[s:e] for s, e in block)
        starts, n = [], 0
        for s, e in block:
            starts.append(n)
            n += e - s + 1

        def back(i: int) -> int:
            k = bisect_right(starts, i) - 1
            return block[k][0] + i - starts[k]

        out.extend((back(s), back(t - 1) + 1) for s, t in split_block(u))
        block.clear()

    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    fence, kind = "", ""
    levels: list[tuple[int, int]] = []  # open list levels as (indent, number), 0 for bullets

    def level_of(indent: int, new: int) -> int | None:
        """Which open level a number goes on with: the innermost one, or the one that it returns to."""
        at = len(levels) - 1
        if at >= 0 and levels[at][1] and levels[at][1] + 1 == new:
            return at
        while at > 0 and levels[at][0] > indent:
            at -= 1
        if at > 0 and not levels[at][1] and levels[at][0] == indent == levels[at - 1][0]:
            at -= 1  # bullets as far in as the numbers they stand below
        return at if at >= 0 and levels[at][1] and levels[at][1] + 1 == new else None

    def enter(indent: int, new: int) -> None:
        at = level_of(indent, new) if new > 1 else None
        if at is not None:
            indent = min(indent, levels[at][0])
            del levels[at:]
        while levels and (levels[-1][0] > indent or levels[-1][0] == indent and (new or not levels[-1][1])):
            levels.pop()
        levels.append((indent, new))

    for k, (s, e) in enumerate(lines):
        line = text[s:e]
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not f[2].strip():
                fence = ""
            continue
        if f:
            flush()
            fence, kind = f[1], ""
            continue
        if not _ALNUM.search(line):
            flush()
            kind = ""
            continue
        p = (_STAR.match(line) or _COMMENT.match(line)).end()
        if g := _GLUED.match(line, p):
            p = g.end()
        while p < len(line) and (line[p].isspace() or line[p] in _EDGE):
            p += 1
        end = _tail(line)
        rest = line[p:]
        if h := _HASH.match(rest):
            alone = len(h[1]) > 1 or not any(0 <= j < len(lines) and re.match(r"[\s﻿]*#[ \t]", text[lines[j][0] : lines[j][1]]) for j in (k - 1, k + 1))
            if alone:
                flush()
                block.append((s + p + h.end(), s + max(end, p + h.end())))
                flush()
                kind = ""
                levels.clear()
                continue
            p += h.end()
            rest = line[p:]
        indent = len(line[:p].expandtabs(4))
        item = _BULLET.match(rest)
        if item:
            body = rest[item.end() :]
            if block and kind != "item" and body[:1].islower() and not _closed(text, *block[-1]):
                item = None
            new = 0
        elif (item := _NUMBER.match(rest)) is not None:
            new = int(item[1]) if item[1].isdigit() else 1
            if not item[1].isdigit() and item[2] == ".":
                item = None  # an initial
            elif block and not (new == 1 or kind == "item" and level_of(indent, new) is not None):
                item = None  # a number at the start of a wrapped line
        if item:
            flush()
            p += item.end()
            kind = "item"
            enter(indent, new)
        elif not block:
            kind = ""
            if levels and indent <= levels[0][0]:
                levels.clear()
        block.append((s + p, s + max(end, p)))
    flush()
    return out


def split_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (doc_id, start_pos, end_pos) per sentence of every text.

    Offsets are code points from 0. Null, empty and blank texts and those without a letter or digit have no
    rows; repeated rows come out as often as they are given; other columns are ignored.
    """
    slim = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull()))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for s, e in sentences(text):
                    rows.append(row)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    return slim.mapInArrow(run, schema)
