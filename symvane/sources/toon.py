"""TOON, a line format of JSON trees: tables for arrays of like objects, indentation for nesting."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|"}
_BARE_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")
_NUMBER = re.compile(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")
_HEADER = re.compile(r"^(?P<key>\"(?:\\.|[^\"\\])*\"|[^\"\[\]:{}]*)\[(?P<n>\d+)(?P<d>[\t|]?)\](?:\{(?P<fields>.*)\})?:(?: (?P<rest>.*))?$")


def _quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _key(k: str) -> str:
    return k if _BARE_KEY.match(k) else _quote(k)


def _number(x: float) -> str:
    if isinstance(x, int):
        return str(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e16:
        return str(int(x))
    text = repr(x)
    return format(x, ".20f").rstrip("0") if "e" in text and 1e-7 < abs(x) < 1e16 else text


def _scalar(v, d: str) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return _number(v)
    s = str(v)
    plain = s and s == s.strip() and s not in ("true", "false", "null") and not _NUMBER.match(s) and not re.match(r"^0\d+$", s) and not re.search(r"[:\"\\\[\]{}\n\r\t]", s) and d not in s and not s.startswith("-")
    return s if plain else _quote(s)


def _simple(v) -> bool:
    return v is None or isinstance(v, (str, int, float, bool))


def encode(value, delimiter: str = "comma", indent: int = 2) -> str:
    """A JSON tree as TOON. Numbers that aren't finite become null."""
    d = DELIMITERS[delimiter]
    mark = "" if d == "," else d
    lines: list[str] = []

    def array(prefix: str, items: list, level: int, pad: str) -> None:
        head = f"{pad}{prefix}[{len(items)}{mark}]"
        if not items:
            lines.append(f"{head}:")
        elif all(_simple(x) for x in items):
            lines.append(f"{head}: " + d.join(_scalar(x, d) for x in items))
        elif all(isinstance(x, dict) and x and list(x) and set(x) == set(items[0]) and all(_simple(v) for v in x.values()) for x in items):
            fields = list(items[0])
            lines.append(f"{head}{{{d.join(_key(f) for f in fields)}}}:")
            lines.extend(" " * indent * (level + 1) + d.join(_scalar(x[f], d) for f in fields) for x in items)
        else:
            lines.append(f"{head}:")
            for x in items:
                item(x, level + 1)

    def item(x, level: int) -> None:
        pad = " " * indent * level
        if _simple(x):
            lines.append(f"{pad}- {_scalar(x, d)}")
        elif isinstance(x, list):
            array("- ", x, level, pad)
        elif not x:
            lines.append(f"{pad}-")
        else:
            at = len(lines)
            mapping(x, level + 1)
            lines[at] = f"{pad}- {lines[at][indent * (level + 1):]}"

    def mapping(x: dict, level: int) -> None:
        pad = " " * indent * level
        for k, v in x.items():
            if _simple(v):
                lines.append(f"{pad}{_key(str(k))}: {_scalar(v, d)}")
            elif isinstance(v, dict):
                lines.append(f"{pad}{_key(str(k))}:")
                mapping(v, level + 1)
            else:
                array(_key(str(k)), list(v), level, pad)

    if _simple(value):
        return _scalar(value, d)
    if isinstance(value, dict):
        mapping(value, 0)
    else:
        array("", list(value), 0, "")
    return "\n".join(lines)


def _split(text: str, d: str) -> list[str]:
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and quoted and i + 1 < len(text):
            cur += text[i : i + 2]
            i += 2
            continue
        quoted ^= c == '"'
        if c == d and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    if quoted:
        raise ValueError("a quoted text isn't closed")
    return [*out, cur]


def _value(token: str):
    t = token.strip()
    if t.startswith('"'):
        if len(t) < 2 or not t.endswith('"'):
            raise ValueError(f"bad quoted text {t}")
        if re.search(r"\\[^\\\"nrt]", t.replace("\\\\", "")):
            raise ValueError(f"bad escape in {t}")
        return json.loads(t.replace("\t", "\\t"))
    if t in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[t]
    if _NUMBER.match(t) and not re.match(r"^-?0\d", t):
        x = float(t)
        return int(t) if re.match(r"^-?\d+$", t) else int(x) if x == int(x) and abs(x) < 1e15 else x
    return t


def decode(text: str, indent: int = 2):
    """A TOON text as a JSON tree. Raises ValueError where counts, widths or indentation are wrong."""
    rows: list[tuple[int, str]] = []
    for raw in text.split("\n"):
        if not raw.strip():
            continue
        pad = len(raw) - len(raw.lstrip(" "))
        if pad % indent or raw[pad : pad + 1] == "\t":
            raise ValueError(f"bad indentation: {raw!r}")
        rows.append((pad // indent, raw[pad:].rstrip("\r")))
    if not rows:
        return {}
    at = 0

    def array(m: re.Match, level: int):
        nonlocal at
        n, d = int(m["n"]), m["d"] or ","
        out: list = []
        if m["fields"] is not None:
            fields = [_value(f) if f.strip().startswith('"') else f.strip() for f in _split(m["fields"], d)]
            while at < len(rows) and rows[at][0] == level + 1 and len(out) < n:
                cells = _split(rows[at][1], d)
                if len(cells) != len(fields):
                    raise ValueError(f"{len(cells)} values for {len(fields)} fields")
                out.append(dict(zip(fields, map(_value, cells))))
                at += 1
        elif m["rest"] is not None and m["rest"] != "":
            out = [_value(x) for x in _split(m["rest"], d)]
        else:
            while at < len(rows) and rows[at][0] == level + 1 and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                body = rows[at][1][2:]
                head = _HEADER.match(body)
                if rows[at][1] == "-":
                    at += 1
                    out.append({})
                elif head and head["key"] == "":
                    at += 1
                    out.append(array(head, level + 1))
                elif head or re.match(r"^(?:\"(?:\\.|[^\"\\])*\"|[^\"\s:][^\":]*):(?: |$)", body):
                    rows[at] = (level + 2, body)
                    out.append(mapping(level + 2))
                else:
                    at += 1
                    out.append(_value(body))
        if len(out) != n:
            raise ValueError(f"{len(out)} items where {n} are announced")
        return out

    def mapping(level: int) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(rows) and rows[at][0] == level:
            line = rows[at][1]
            head = _HEADER.match(line)
            if head and head["key"] != "":
                at += 1
                key = _value(head["key"]) if head["key"].startswith('"') else head["key"]
                out[key] = array(head, level)
                continue
            m = re.match(r"^(\"(?:\\.|[^\"\\])*\"|[^\"\s:][^\":]*):(?: (.*))?$", line)
            if not m:
                raise ValueError(f"no key in {line!r}")
            key = _value(m[1]) if m[1].startswith('"') else m[1]
            at += 1
            if m[2] is not None and m[2] != "":
                out[key] = _value(m[2])
            else:
                out[key] = mapping(level + 1) if at < len(rows) and rows[at][0] == level + 1 else {}
        if at < len(rows) and rows[at][0] > level:
            raise ValueError(f"too deep: {rows[at][1]!r}")
        return out

    head = _HEADER.match(rows[0][1])
    if head and head["key"] == "":
        at = 1
        out = array(head, 0)
    elif len(rows) == 1 and not head and not re.match(r"^(?:\"(?:\\.|[^\"\\])*\"|[^\"\s:][^\":]*):(?: |$)", rows[0][1]):
        return _value(rows[0][1])
    else:
        out = mapping(0)
    if at < len(rows):
        raise ValueError(f"left over: {rows[at][1]!r}")
    return out


def to_toon(column, delimiter: str = "comma"):
    """A column of JSON texts as TOON; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else encode(json.loads(x), delimiter))

    return run(column)


def from_toon(column):
    """A column of TOON texts as JSON; null and malformed texts give null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else json.dumps(decode(x), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return run(column)
