"""Scalar functions on text and paths as column expressions; Arrow UDFs only where none exists."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of the token estimate.
DIGIT, WORD, PIECE, PUNCT, NEWLINE, NON_ASCII = 0.4878, 0.2783, 0.8258, 0.402, 1.7999, 0.8308
# Phrases that carry nothing, with what takes their place.
FILLERS = {
    "it is important to note that ": "", "it's important to note that ": "", "please be aware that ": "", "it should be noted that ": "", "it is worth noting that ": "", "it's worth noting that ": "",
    "note that ": "", "keep in mind that ": "", "bear in mind that ": "", "in order to ": "to ", "due to the fact that ": "because ", "as a matter of fact ": "", "for the purpose of ": "to ",
    "in the event that ": "if ", "with regard to ": "regarding ", "with respect to ": "regarding ", "it is recommended to ": "", "it's recommended to ": "", "you may want to ": "", "you might want to ": "",
    "i think ": "", "i believe ": "", "it seems ": "", "it appears ": "", "basically ": "", "essentially ": "", "fundamentally ": "", "generally speaking ": "", "in general ": "", "actually ": "",
    "pretty much ": "", "sort of ": "", "kind of ": "", "very ": "", "quite ": "", "rather ": "", "somewhat ": "", "just ": "",
}


def content_hash(content: Column, hashed: Column | None = None) -> Column:
    """16 hex digits of a hash, a dash and the length in bytes. The hash is xxHash64, which stays in the JVM, unless another (say `fnv1a`) is given."""
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(content) if hashed is None else hashed), 16, "0")), F.lit("-"), F.octet_length(content).cast("string"))


#: FNV-1a, 64 bit: start and factor.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
#: Texts from which on taking their bytes together pays.
FNV_TOGETHER = 16


def _fnv_on(h: int, data: bytes) -> int:
    for b in data:
        h = ((h ^ b) * FNV_FACTOR) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_bytes(data: bytes) -> int:
    """FNV-1a of bytes, 64 bit, as a signed number."""
    h = _fnv_on(FNV_START, data)
    return h - (1 << 64) if h >> 63 else h


def fnv1a_many(texts: list[str]) -> np.ndarray:
    """FNV-1a of many texts at once: the k-th bytes of all texts that have one are taken together, while there are FNV_TOGETHER of them."""
    data = [t.encode() for t in texts]
    order = np.argsort([-len(d) for d in data], kind="stable")
    sizes = np.array([len(data[i]) for i in order])
    whole = np.frombuffer(b"".join(data[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    h = np.full(len(data), FNV_START, np.uint64)
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")  # texts with at least k bytes
    most = int((live >= FNV_TOGETHER).sum())
    with np.errstate(over="ignore"):
        for k, n in enumerate(live[:most]):
            h[:n] = (h[:n] ^ whole[starts[:n] + k]) * np.uint64(FNV_FACTOR)
    for i in range(int(live[most]) if most < len(live) else 0):
        h[i] = _fnv_on(int(h[i]), data[order[i]][most:])
    out = np.empty(len(data), np.int64)
    out[order] = h.view(np.int64)
    return out


@F.pandas_udf(T.LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a, 64 bit, of the UTF-8 bytes; distinct texts of a batch are hashed once; null stays null."""
    once = list(text.dropna().unique())
    known = dict(zip(once, fnv1a_many(once).tolist()))
    return text.map(known).astype("Int64")


def fnv1a_normalized(text: Column) -> Column:
    """FNV-1a of the text with runs of white space as one blank and none at the ends."""
    return fnv1a(F.trim(F.regexp_replace(text, r"\s+", " ")))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: weighted counts of digits, words, pieces, signs, line ends and others; '' costs 0, any other text at least 1."""
    bare = F.regexp_replace(text, r"[^A-Za-z0-9_]+", " ")
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    digits = count(text, "[0-9]")
    words = count(bare, "[A-Za-z0-9_]+")
    pieces = count(bare, "[0-9]+|[A-Z]+(?![a-zA-Z])|[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+")
    puncts = count(text, r"[!-/:-@\[-^`{-~\x00-\x08\x0b\x0e-\x1f\x7f]")
    raw = F.round(digits * DIGIT + words * WORD + pieces * PIECE + puncts * PUNCT + count(text, "\n") * NEWLINE + count(text, r"[^\x00-\x7f]") * NON_ASCII)
    return F.when(text == "", 0).otherwise(F.greatest(raw.cast("int"), F.lit(1)))


def first_sentence(doc: Column) -> Column:
    """Up to the first period followed by a blank, of the first paragraph, white space collapsed."""
    paragraph = F.element_at(F.split(F.regexp_replace(F.trim(F.regexp_replace(doc, r"\r\n?", "\n")), r"^\s+", ""), r"\n[ \t]*\n"), 1)
    flat = F.trim(F.regexp_replace(paragraph, r"\s+", " "))
    at = F.instr(flat, ". ")
    return F.when(at > 0, F.substring(flat, F.lit(1), at)).otherwise(flat)


def common_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix."""
    from symvane.operators.resolve import common_prefix as shared

    return shared(a, b)


#: What counts as one word part: acronym, capitalised or small word, letters without case, digits.
PARTS = r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|[\p{Lo}\p{Lm}\p{Lt}\p{M}]+|\p{N}+"


def word_parts(text: Column) -> Column:
    """Small word parts in order: parseConfig, HTTPServer2Go and snake_case fall apart."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), F.lower)


def index_terms(text: Column) -> Column:
    """Word parts and, for runs that fall into several, the run glued together."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda run: F.when(F.size(word_parts(run)) > 1, F.concat(word_parts(run), F.array(F.lower(run)))).otherwise(word_parts(run))))


# Letters with marks and what they fold to.
_MARKED, _PLAIN = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõøōőřśšşťúùûüūůűýÿžźż", "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooorssstuuuuuuuyyzzz"


def fold(text: Column) -> Column:
    """Small letters without marks."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def echo_chars(budget: Column) -> Column:
    """Characters of a query that are shown again: a fifth of the budget, 24 to 160."""
    return F.least(F.greatest(F.floor(budget / 5), F.lit(24)), F.lit(160)).cast("int")


def clip_chars(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis, `most` in all."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


_ARTICLE = re.compile(r"(?i:an?|the) (?=[a-z])")
#: Shortest text, in bytes, that is compressed.
COMPRESS_BYTES = 24


def compressed(text: str) -> str:
    """As `compress`, of one text: the first phrase of the list that it holds goes, until none is left."""
    out = text
    while (phrase := next((p for p in FILLERS if p in out.lower()), None)) is not None:
        out = re.sub(re.escape(phrase), FILLERS[phrase], out, flags=re.I)
    out = _ARTICLE.sub("", out, count=1) if _ARTICLE.match(out) else out
    out = out.strip()
    return out if len(text.encode()) >= COMPRESS_BYTES and len(out.encode()) < len(text.encode()) else text


@F.pandas_udf(T.StringType())
def compress(text: pd.Series) -> pd.Series:
    """Text without filler phrases and without a leading article before a small letter; short texts and those it doesn't shorten stay."""
    return text.map(lambda t: compressed(t) if t is not None else None)


def sanitize(text: Column) -> Column:
    """Memory text: one kind of line end, no control characters but tabs, no blanks at line ends, at most two blank lines in a row."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\p{Cc}&&[^\n\t]]", "")
    lines = F.regexp_replace(F.regexp_replace(clean, r"(?U)[\s&&[^\n]]+(?=\n)", ""), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


# Patterns of secrets and what they are called.
SECRETS = {
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)",
    "aws-key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "slack-token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "url-password": r"(?<=://)[^/\s:@]+:[^/\s@]+(?=@)",
    "assigned": r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*['\"]?[^\s'\"]{8,}['\"]?",
}


def redact(text: Column) -> Column:
    """Text with secrets replaced by their kind in brackets."""
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[redacted {kind}]")
    return text


def region(path: Column, depth: int) -> Column:
    """The first `depth` directories of a path; '.' for files at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def count_lines(text: Column) -> Column:
    """Line feeds, plus one if the last line has none; '' has no line."""
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test."""
    return path.rlike(r"(?i)(^|/)(tests?|spec|__tests__)/") | path.rlike(r"(?i)[_.](test|spec)\.[^/]*$")


def blank(text: Column) -> Column:
    """Whether a text is null or only white space."""
    return F.coalesce(F.trim(text, F.lit(" \t\r\n")), F.lit("")) == ""


# Reasons of the guard and the patterns that give them (on small letters, look-alikes folded).
BLOCKING = {
    "override-instructions": r"\b(ignore|disregard|forget|override|bypass)\b(\W+\w+){0,4}?\W+(instructions?|rules|guidelines|directives)\b",
    "new-instructions": r"\b(new|updated|revised)\s+(system\s+)?instructions?\s*:",
    "role-hijack": r"\byou (are now|will now act as|must now act as)\b",
    "reveal-prompt": r"\b(reveal|show|print|repeat|output)\b(\W+\w+){0,4}?\W+(system prompt|hidden instructions|words above|instructions above)\b",
    "unrestricted-persona": r"\bdo anything now\b|\bact as\b(\W+\w+){0,8}?\W+without (any )?(restrictions?|limits|rules)\b",
    "tag-characters": r"[\x{E0000}-\x{E007F}]",
    "bidi-control": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]",
    "zero-width-run": r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]{3,}",
    "protocol-markup": r"</?(tool_calls?|function_calls?|function_results?|tool_use|tool_results?|invoke)\b|\"method\"\s*:\s*\"tools/call\"|<\|im_(start|end)\|>|\[/?inst\]",
    "run-command": r"\brun the following (command|script|code)\b|\b(download|fetch) and (run|execute)\b|\bexecute the following\b",
    "pipe-to-shell": r"\b(curl|wget|base64|iwr|invoke-webrequest)\b[^\n|]*\|\s*(sudo\s+)?(sh|bash|zsh|dash|ksh|fish|pwsh|powershell|iex|python3?|perl|ruby|node)\b|\b(sh|bash|zsh|dash|ksh|eval|source)\b[^\n]{0,10}\$\((curl|wget)\b",
    "encoded-powershell": r"\bpowershell(\.exe)?\b[^\n]*\s-e(nc|ncodedcommand)?\b",
    "ansi-escape": r"\x{1B}",
}
DIRECTIVES = r"\byou (must|should always|have to)\b|\bnever tell the user\b|\bdo not (mention|tell|reveal)\b|\balways (respond|answer|reply)\b"
_LOOK_ALIKE, _LATIN = "аеорсхуіѕјԁһոαοερνɡ", "aeopcxyisjdhnaoepvg"


def guard(text: Column) -> Column:
    """Names of the reasons to refuse or to doubt a text, blocking ones first; empty for a clean one."""
    low = F.translate(F.lower(text), _LOOK_ALIKE, _LATIN)
    seen = F.regexp_replace(low, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    raw = {"tag-characters", "bidi-control", "zero-width-run", "ansi-escape"}
    flags = [F.when((low if name in raw else seen).rlike(pattern), F.lit(name)) for name, pattern in BLOCKING.items()]
    letters, capitals = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    blob = F.regexp_extract(text, "([A-Za-z0-9+/=]{200,})", 1)
    flags += [
        F.when(seen.rlike(DIRECTIVES), F.lit("directive-language")),
        F.when((blob != "") & (F.size(F.array_distinct(F.split(blob, ""))) >= 12), F.lit("base64-blob")),
        F.when(F.regexp_count(text, F.lit("(?i)https?://")) >= 4, F.lit("many-urls")),
        F.when((letters >= 40) & (capitals * 10 >= letters * 6), F.lit("shouting")),
        F.when(F.length(text) > 2000, F.lit("too-long")),
    ]
    return F.array_compact(F.array(*flags))


def simhash64(words: Column) -> Column:
    """64-bit similarity hash of a set of words: the sign of the bit sums of their hashes; 0 for none."""
    hashes = F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))

    def bit(b: int) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, F.lit(b)) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    bits = [bit(b) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


@F.pandas_udf(T.LongType())
def simhash(words: pd.Series) -> pd.Series:
    """As `simhash64` over FNV-1a hashes, a batch at a time."""
    once = sorted({w for ws in words if ws is not None for w in ws})
    at = {w: i for i, w in enumerate(once)}
    votes = np.unpackbits(fnv1a_many(once).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1

    def one(ws) -> int | None:
        if ws is None:
            return None
        total = votes[[at[w] for w in set(ws)]].sum(axis=0) if len(ws) else np.zeros(64, np.int32)
        return int(np.packbits(total > 0, bitorder="little").view(np.int64)[0])

    return words.map(one).astype("Int64")


def hamming(a: Column, b: Column) -> Column:
    """Bits two hashes differ in."""
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two word sets; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


#: Words of a note that its order is judged by.
SEQUENCE_WORDS = 400


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of the first SEQUENCE_WORDS words of two lists, by bit-parallel rows."""

    def one(x, y) -> int:
        if x is None or y is None:
            return 0
        x, y = x[:SEQUENCE_WORDS], y[:SEQUENCE_WORDS]
        where: dict[str, int] = {}
        for i, w in enumerate(x):
            where[w] = where.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for w in y:
            hit = row & where.get(w, 0)
            row = (row + hit | row & ~hit) & full if hit else row
        return len(x) - bin(row).count("1")

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def similarity(a: Column, b: Column, few: int = 4) -> Column:
    """Mean of set overlap and order overlap; below `few` words only equal sets are alike."""
    order = 2 * lcs_length(a, b) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) < few) | (F.size(b) < few), F.when(same, 1.0).otherwise(0.0)).otherwise(0.5 * jaccard(a, b) + 0.5 * order)


_PIECE = re.compile(r"[0-9]+|[A-Z]+(?![a-zA-Z])|[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+")


def estimate_tokens(text: str) -> int:
    """As `token_estimate`, of one text inside a task."""
    if not text:
        return 0
    words = re.findall(r"[A-Za-z0-9_]+", text)
    others = sum(not c.isascii() for c in text)
    puncts = len(re.findall(r"[!-/:-@\[-^`{-~\x00-\x08\x0b\x0e-\x1f\x7f]", text))
    raw = DIGIT * len(re.findall(r"[0-9]", text)) + WORD * len(words) + PIECE * sum(len(_PIECE.findall(w)) for w in words) + PUNCT * puncts + NEWLINE * text.count("\n") + NON_ASCII * others
    return max(int(raw + 0.5), 1)
