"""Comment, string and prose masks by table-driven automata over byte classes.

A 256-entry table maps bytes to classes, a second table states and classes to states. Texts
are laid end to end in one byte buffer (each followed by a byte that resets the automaton),
which is cut into equal pieces. All pieces run in step, first from every possible state, then,
once it is known which state each piece starts in, from that one; so numpy does the work of a
sequential automaton a column at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Byte put between texts; it can't occur in UTF-8.
END = 0xFF


class Automaton:
    """States and rules: (state, bytes or None for all others) to state."""

    def __init__(self, states: list[str], rules: list[tuple[str, bytes | None, str]], start: str):
        number = {s: i for i, s in enumerate(states)}
        table = np.zeros((len(states), 256), np.uint8)
        for s in states:
            table[number[s], :] = number[s]
        for s, chars, to in sorted(rules, key=lambda r: r[1] is not None):
            table[number[s], list(chars) if chars is not None else slice(None)] = number[to]
        table[:, END] = number[start]
        columns, classes = np.unique(table, axis=1, return_inverse=True)
        self.states, self.number, self.start = states, number, number[start]
        self.classes = classes.reshape(-1).astype(np.uint8)
        self.table = np.ascontiguousarray(columns)

    def run(self, data: np.ndarray) -> np.ndarray:
        """The state before each byte of the buffer."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint8)
        width = max(16, int(np.sqrt(n / 4)))
        pieces = -(-n // width)
        classes = np.zeros(pieces * width, np.uint8)
        classes[:n] = self.classes[data]
        columns = np.ascontiguousarray(classes.reshape(pieces, width).T)
        k, flat = self.table.shape[1], self.table.reshape(-1)
        ends = np.broadcast_to(np.arange(len(self.states), dtype=np.int32), (pieces, len(self.states))).copy()
        for c in columns:
            ends = flat[ends * k + c[:, None]].astype(np.int32)
        first = np.empty(pieces, np.int32)
        state = self.start
        for i in range(pieces):
            first[i] = state
            state = ends[i, state]
        out = np.empty((width, pieces), np.uint8)
        now = first
        for i, c in enumerate(columns):
            out[i] = now
            now = flat[now * k + c].astype(np.int32)
        return out.T.reshape(-1)[:n]


_BLANK, _WORD = b" \t\r\x0b\x0c", bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58)) + b"_.:-"

#: Text of a comment: what is comment syntax, tag or code is told apart from prose.
PROSE = Automaton(
    ["line", "text", "code", "tick", "tick2", "fence", "fence_line", "fence_t1", "fence_t2", "wave", "wave2", "wave_body", "wave_line", "wave_t1", "wave_t2", "close", "tag", "brace", "at", "lt", "entity"],
    [
        ("line", None, "text"), ("line", _BLANK + b"/*#!-\"';%>|", "line"), ("line", b"\n", "line"), ("line", b"`", "tick"), ("line", b"~", "wave"), ("line", b"<", "lt"), ("line", b"{", "brace"), ("line", b"@", "at"), ("line", b":", "at"),
        ("text", b"\n", "line"), ("text", b"`", "tick"), ("text", b"<", "lt"), ("text", b"{", "brace"), ("text", b"@", "at"),
        ("tick", None, "code"), ("tick", b"`", "tick2"), ("tick", b"\n", "line"), ("code", b"`", "text"), ("code", b"\n", "line"),
        ("tick2", None, "code"), ("tick2", b"`", "fence"), ("tick2", b"\n", "line"), ("tick2", _BLANK, "text"),
        ("fence", b"\n", "fence_line"), ("fence_line", None, "fence"), ("fence_line", _BLANK + b"/*#!-;%>|", "fence_line"), ("fence_line", b"\n", "fence_line"), ("fence_line", b"`", "fence_t1"),
        ("fence_t1", None, "fence"), ("fence_t1", b"`", "fence_t2"), ("fence_t1", b"\n", "fence_line"), ("fence_t2", None, "fence"), ("fence_t2", b"`", "close"), ("fence_t2", b"\n", "fence_line"),
        ("close", b"\n", "line"),
        ("wave", None, "text"), ("wave", b"~", "wave2"), ("wave", b"\n", "line"), ("wave2", None, "text"), ("wave2", b"~", "wave_body"), ("wave2", b"\n", "line"),
        ("wave_body", b"\n", "wave_line"), ("wave_line", None, "wave_body"), ("wave_line", _BLANK + b"/*#!-;%>|", "wave_line"), ("wave_line", b"\n", "wave_line"), ("wave_line", b"~", "wave_t1"),
        ("wave_t1", None, "wave_body"), ("wave_t1", b"~", "wave_t2"), ("wave_t1", b"\n", "wave_line"), ("wave_t2", None, "wave_body"), ("wave_t2", b"~", "close"), ("wave_t2", b"\n", "wave_line"),
        ("lt", None, "text"), ("lt", bytes(range(65, 91)) + bytes(range(97, 123)) + b"/!", "tag"), ("lt", b"\n", "line"), ("tag", b">", "text"), ("tag", b"\n", "line"),
        ("brace", b"}", "text"), ("brace", b"\n", "line"),
        ("at", None, "text"), ("at", _WORD, "at"), ("at", b"\n", "line"),
    ],
    "line",
)

_FAMILY_STATES = ["code", "slash", "line", "block", "star", "dq", "dq_esc", "sq", "sq_esc", "bq", "bq_esc", "dash", "d1", "d2", "ddd", "ddd1", "ddd2", "s1", "s2", "sss", "sss1", "sss2"]


#: States of a family that tells where a line begins.
_LINE_STATES = ["start", "bullet", "hash1", "minus", "tick1", "tick2", "tick3"]
_NEWLINE = b"\r\n"


def _family(slashes: bool, hashes: bool, dashes: bool, triple: bool) -> Automaton:
    """Source code of a family of languages with these kinds of comments and strings."""
    rules: list[tuple[str, bytes | None, str]] = [("line", b"\n", "code"), ("block", b"*", "star"), ("star", None, "block"), ("star", b"*", "star"), ("star", b"/", "code")]
    enter = [(b"\"", "d1" if triple else "dq"), (b"'", "s1" if triple else "sq"), (b"`", "bq")]
    enter += [(b"/", "slash")] * slashes + [(b"#", "line")] * hashes + [(b"-", "dash")] * dashes
    rules += [("code", c, to) for c, to in enter]
    for c, s, esc in ((b'"', "dq", "dq_esc"), (b"'", "sq", "sq_esc"), (b"`", "bq", "bq_esc")):
        rules += [(s, c, "code"), (s, b"\\", esc), (esc, None, s)]
        if s != "bq":
            rules.append((s, b"\n", "code"))
    for back in ("slash", "dash"):
        rules += [(back, None, "code")] + [(back, c, to) for c, to in enter]
    rules += [("slash", b"/", "line"), ("slash", b"*", "block"), ("dash", b"-", "line")]
    for c, q1, q2, body, b1, b2, plain in ((b'"', "d1", "d2", "ddd", "ddd1", "ddd2", "dq"), (b"'", "s1", "s2", "sss", "sss1", "sss2", "sq")):
        rules += [(q1, None, plain), (q1, c, q2), (q1, b"\\", f"{plain}_esc"), (q1, b"\n", "code"), (q2, None, "code"), (q2, c, body), (body, c, b1), (b1, None, body), (b1, c, b2), (b2, None, body), (b2, c, "code")]
    return Automaton(_FAMILY_STATES, rules, "code")


def _mixed(marks: bool) -> Automaton:
    """Excerpts of source code: //, /* */ anywhere, * (a line of a block comment opened before) where a line begins, with `marks` # and -- there too.

    A line's opening ``` is markup and no string; #[ opens an attribute.
    """
    rules: list[tuple[str, bytes | None, str]] = [("block", b"*", "star"), ("star", None, "block"), ("star", b"*", "star"), ("star", b"/", "code")]
    enter = [(b'"', "d1"), (b"'", "s1"), (b"`", "bq"), (b"/", "slash"), (_NEWLINE, "start")]
    rules += [("code", c, to) for c, to in enter]
    rules += [("start", None, "code"), *[("start", c, to) for c, to in enter], ("start", _BLANK.replace(b"\r", b"") + b"\xef\xbb\xbf", "start"), ("start", b"*", "bullet"), ("start", b"`", "tick1")]
    rules += [("start", b"#", "hash1"), ("start", b"-", "minus")] * marks
    for back in ("slash", "bullet", "minus", "tick2", "tick3"):
        rules += [(back, None, "code")] + [(back, c, to) for c, to in enter]
    rules += [("slash", b"/", "line"), ("slash", b"*", "block"), ("bullet", b"*", "bullet"), ("bullet", b" \t/", "line"), ("minus", b"-", "line"), ("line", _NEWLINE, "start")]
    rules += [("hash1", None, "line"), ("hash1", b"!", "hash1"), ("hash1", b"[", "code"), ("hash1", _NEWLINE, "start")]
    rules += [("tick1", None, "bq"), ("tick1", b"\\", "bq_esc"), ("tick1", b"`", "tick2"), ("tick2", b"`", "tick3"), ("tick3", b"`", "tick3")]
    for c, s, esc in ((b'"', "dq", "dq_esc"), (b"'", "sq", "sq_esc"), (b"`", "bq", "bq_esc")):
        rules += [(s, c, "code"), (s, b"\\", esc), (esc, None, s)]
        if s != "bq":
            rules.append((s, _NEWLINE, "start"))
    for c, q1, q2, body, b1, b2, plain in ((b'"', "d1", "d2", "ddd", "ddd1", "ddd2", "dq"), (b"'", "s1", "s2", "sss", "sss1", "sss2", "sq")):
        rules += [(q1, None, plain), (q1, c, q2), (q1, b"\\", f"{plain}_esc"), (q1, _NEWLINE, "start"), (q2, None, "code"), *[(q2, x, to) for x, to in enter], (q2, c, body), (body, c, b1), (b1, None, body), (b1, c, b2), (b2, None, body), (b2, c, "code")]
    return Automaton([*_FAMILY_STATES, *_LINE_STATES], rules, "start")


#: Source code by family of comment signs.
SOURCE = {"mixed": _mixed(True), "star": _mixed(False), "slash": _family(True, False, False, False), "hash": _family(False, True, False, True), "dash": _family(False, False, True, False)}
_IN_COMMENT = {"line", "block", "star"}
_IN_STRING = {"dq", "dq_esc", "sq", "sq_esc", "bq", "bq_esc", "tick1", "d1", "ddd", "ddd1", "ddd2", "s1", "sss", "sss1", "sss2"}


def _buffer(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each with a reset byte after it, and where each begins. Arrow arrays are taken from their own buffers; null is empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    column = texts.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    sizes = np.diff(at)
    out = np.full(int(at[-1] - at[0]) + n, END, np.uint8)
    if len(out) > n:
        out[np.arange(at[-1] - at[0]) + np.repeat(np.arange(n), sizes)] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return out, np.r_[0, np.cumsum(sizes + 1)]


def _blanked(data: np.ndarray, keep: np.ndarray, at: np.ndarray) -> list[str]:
    out = np.where(keep | (data == 10), data, 32).astype(np.uint8).tobytes()
    return [out[s : e - 1].decode("utf-8", "replace") for s, e in zip(at, at[1:])]


def prose(texts: list[str] | pa.Array) -> list[str]:
    """Texts of comments with everything but prose blanked, byte by byte; lines stay."""
    data, at = _buffer(texts)
    state = PROSE.run(data)
    inside = (state == PROSE.number["text"]) | (state == PROSE.number["line"])
    nxt = np.r_[state[1:], PROSE.start]
    keep = inside & ((nxt == PROSE.number["text"]) | (nxt == PROSE.number["line"]) & (data == 10))
    return _blanked(data, keep, at)


def natural(texts: list[str], families: list[str]) -> list[tuple[str, str]]:
    """Of each source text its (comments, strings), the rest blanked."""
    out: list[tuple[str, str]] = [("", "")] * len(texts)
    for family, machine in SOURCE.items():
        rows = [i for i, f in enumerate(families) if f == family]
        if rows:
            data, at = _buffer([texts[i] for i in rows])
            state = machine.run(data)
            both = [np.isin(state, [machine.number[s] for s in kind if s in machine.number]) for kind in (_IN_COMMENT, _IN_STRING)]
            for i, comment, string in zip(rows, _blanked(data, both[0], at), _blanked(data, both[1], at)):
                out[i] = (comment, string)
    return out


_FENCE = re.compile(r"\s*+(`{3,}+|~{3,}+)([^`\n]*+)$")


def fenced_code(text: str) -> str:
    """The lines of a text's fenced code, all others blank; a fence never closed runs to the end."""
    out, fence = [], ""
    for line in re.split(r"\r\n|\n|\r", text):
        m = _FENCE.match(line)
        if m and (not fence or m[1].startswith(fence) and not m[2].strip()):
            fence = "" if fence else m[1]
            out.append("")
        else:
            out.append(line if fence else "")
    return "\n".join(out)
