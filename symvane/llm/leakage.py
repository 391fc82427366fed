"""Passages of held-out items inside a training corpus.

Texts become words (runs of letters or digits) that don't depend on case, markup, layout or
characters that don't show. Winnowing keeps, of every window of consecutive k-gram hashes, the
smallest, so any shared run of `min_words` words shares at least one kept fingerprint. Kept
fingerprints of corpus and items are joined, and each hit is extended to see whether a shared
run of `min_words` words really spans it.

While the items have at most `BLOCK` distinct fingerprint hashes, these are sent to the tasks,
which drop all other fingerprints of the corpus before anything is shuffled. Beyond that bound
nothing is sent: the corpus is winnowed once to pairs of document and hash, which meet the items'
hashes in a join placed by load, and only documents with a hit are read again for the words
around it. Both ways give the same rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.operators.skew import balanced_join
from symvane.runtime import cut, spread

#: Least length of a leaked passage, and words in a fingerprinted run.
MIN_WORDS, GRAM = 12, 9
#: Most distinct hashes of items that are sent to all tasks (8 bytes each); beyond, they are joined.
BLOCK = 2_000_000

_HIDDEN = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏⠀ㅤ︀-️ﾠ]|\x1b\[[0-9;]*[A-Za-z]")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_TAG_OR_NOTE = re.compile(_TAG.pattern + r"|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)|\]\[[^\]\n]*\]")
_ESCAPE = re.compile(r"\\(?:[nrt]|u200[b-f]|ufeff)")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?=\{)")
_ROLE = re.compile(r":[A-Za-z][A-Za-z-]*:(?=`)")
_NOTE = re.compile(r"\[\^?\d{1,3}\]")
_PARTED = re.compile(r"(?<=[^\W\d_])[-‐]\r?\n[ \t]*+(?:(?:/{2,}+!?|\*|#|>|--|\|)[ \t]*+)*+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_NUMBERED = re.compile(r"^([^\w\n]*)\d{1,4}([.):\]|]|\t| {2,})(?=\s|\W)", re.M)


def words(text: str) -> list[str]:
    """The words of a text, folded so that equal passages give equal words however they are set."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    elif "\x1b" in text:
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _INLINE.sub("", text)
        closed = text.rfind("-->") + 3  # beyond it no note ends, so none is looked for
        text = _TAG_OR_NOTE.sub(" ", text[:closed]) + _TAG.sub(" ", text[closed:]) if closed > 2 else _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "](" in text or "][" in text:
        text = _LINK.sub("]", text)
    return _WORD.findall(text.casefold())


def readings(text: str) -> list[list[str]]:
    """The word sequences a text may be read as: as it stands, and also without what a setting may have put in.

    That is numbers of lines and notes, escapes in strings, names of markup commands, and words parted at line ends.
    """
    out = [words(text)]
    other = text
    if "\\" in text:
        other = _ESCAPE.sub(" ", _COMMAND.sub("", other))
    if ":`" in text:
        other = _ROLE.sub("", other)
    other = _PARTED.sub("", _NOTE.sub("", _NUMBERED.sub(r"\1", other)))
    if other != text:
        out.append(words(other))
    return out


def _hash(known: dict[str, int], ws: list[str]) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    for w in set(ws).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def fingerprints(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps: the rightmost smallest of each window."""
    n = len(hashes) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))
    return at, h[at].view(np.int64)


def _slim(texts: DataFrame, id_col: str, text_col: str, as_id: str) -> DataFrame:
    return texts.select(F.col(id_col).alias(as_id), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())


def _prints(slim: DataFrame, min_words: int, gram: int, pad: str | None, wanted: np.ndarray | None = None) -> DataFrame:
    """Kept fingerprints (id, hash) of (id, text) or (id, text, hashes), with `pad` also the words around each.

    Only those in `wanted`, or in the row's own list of hashes, where one is given.
    """
    own = len(slim.columns) > 2
    fields = [slim.schema[0], T.StructField("hash", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("around", T.ArrayType(T.StringType()))] if pad else []))
    window, side = min_words - gram + 1, min_words - gram
    shared = slim.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value if shared is not None else None
        known: dict[str, int] = {}
        for batch in batches:
            ids, hs, around = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if own:
                    keep = np.sort(np.array(batch.column(2)[row].as_py(), np.int64))
                for ws in readings(text):
                    at, h = fingerprints(_hash(known, ws), gram, window)
                    if keep is not None and len(h):
                        found = np.searchsorted(keep, h)
                        ok = keep[np.minimum(found, len(keep) - 1)] == h
                        at, h = at[ok], h[ok]
                    ids += [row] * len(h)
                    hs += h.tolist()
                    if pad and len(at):
                        padded = [pad] * side + ws + [pad] * side
                        around += [padded[p : p + gram + 2 * side] for p in at.tolist()]
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(hs, pa.int64())] + ([pa.array(around, pa.list_(pa.string()))] if pad else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Pairs (doc_id, item_id): the document holds at least `min_words` consecutive words of the item.

    Each pair comes out once, however often the passage or the rows are repeated. Null, empty and shorter
    texts hold nothing; empty tables give no rows; other columns are ignored.
    """
    if not 0 < gram <= min_words:
        raise ValueError("gram must lie between 1 and min_words")
    held = cut(_prints(spread(_slim(items, item_id, item_text, "item_id")), min_words, gram, "\x00item").distinct())
    total = held.select("hash").distinct().count()
    if not total:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType)]))
    slim = spread(_slim(docs, doc_id, doc_text, "doc_id"))
    if total <= block:
        wanted = np.sort(np.array([r[0] for r in held.select("hash").distinct().collect()], np.int64))  # at most `block`
        hits = _prints(slim, min_words, gram, "\x00doc", wanted)
    else:
        every = cut(_prints(slim, min_words, gram, None).distinct())
        met = balanced_join(every, held.select("hash").distinct(), ["hash"], ["doc_id"], "left_semi")
        asked = met.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("hash").alias("__hashes"))  # of one document its own fingerprints
        again = slim.join(asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "__text", "__hashes")
        hits = _prints(again, min_words, gram, "\x00doc")
    hits = cut(hits.distinct())
    pairs = balanced_join(hits, held.withColumnRenamed("around", "item_around"), ["hash"], ["doc_id", "around"])
    spans = None
    for o in range(min_words - gram + 1):
        one = F.slice("around", o + 1, min_words) == F.slice("item_around", o + 1, min_words)
        spans = one if spans is None else spans | one
    return pairs.filter(spans).select("doc_id", "item_id").distinct()
