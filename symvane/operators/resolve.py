"""References to edges: four tiers of confidence, each a join, united and collapsed.

A reference's candidates are the symbols of its name in files of its language family. Equal
(name, family, receiver) triples are judged once, and equal (name, family, file) triples
ranked once, so a name that a tenth of all references carry costs what one reference costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symvane.runtime import cut
from symvane.schemas import GUESS, HEURISTIC, RESOLVED

#: Most edges one reference gives, and candidates ranked for it (one more, for its owner may be skipped).
MAX_LINKS, PICKS = 4, 5
#: Most candidates of a name in a family that every asking file is compared with.
FEW = 200
# Qualifiers that mean the symbol itself, or its module.
SELF = ["self", "this", "Self", "cls", "$this", "static"]
MODULE = ["super", "crate", "parent"]
# Languages that share a family; others are their own.
FAMILIES = {"javascript": "ecmascript", "typescript": "ecmascript", "tsx": "ecmascript", "c": "c_family", "cpp": "c_family"}
EDGE_KINDS = {"call": "calls", "type": "uses", "inherit": "inherits"}
# What stands between a type and its member.
SEPARATORS = ("::", ".")
#: Receivers and names with these have no fixed length as a pattern, and meet every candidate of their name.
ODD = r"[%\\]"


def family_of(language: Column) -> Column:
    """The family of a language."""
    return F.coalesce(*[F.when(language == k, v) for k, v in FAMILIES.items()], language)


def edge_kind(kind: Column) -> Column:
    """The edge kind of a reference kind."""
    return F.coalesce(*[F.when(kind == k, v) for k, v in EDGE_KINDS.items()], kind)


def no_self(owner_name: Column, name: Column, qualifier: Column) -> Column:
    """1 if a reference must not link to its own owner: same name, but said of something else."""
    return F.when((owner_name == name) & qualifier.isNotNull() & ~qualifier.isin(SELF), 1).otherwise(0)


def receiver_word(qualifier: Column) -> Column:
    """Last word of a receiver in small letters; null for none, '' for an expression."""
    q = F.trim(qualifier)
    last = F.regexp_extract(q, r"([^.:>\\/#@]+)[.:>\\/#@]*$", 1)
    bare = F.regexp_replace(F.regexp_replace(last, r"^\$+", ""), "-+$", "")
    none = q.isNull() | (q == "") | q.isin(SELF + MODULE)
    return F.when(none, None).when(q == "(expr)", "").when(bare.isin(SELF), None).otherwise(F.lower(bare))


def _like_tail(text: Column, tail: Column) -> Column:
    """Whether text ends with tail, ignoring case; `_` in it stands for any one character, as in LIKE."""
    return F.call_function("ilike", text, F.concat(F.lit("%"), tail))


def _flat(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def names_type(recv: Column, name: Column, qualified: Column, parent: Column) -> Column:
    """Whether a receiver names the candidate's type: its parent, or the segment before its own name."""
    flat, plain = _flat(F.lower(parent)), _flat(recv)
    long = F.length(recv) >= 4
    by_parent = (flat == plain) | long & F.endswith(flat, plain)
    by_segment = F.lit(False)
    for sep in SEPARATORS:
        tail = F.concat(recv, F.lit(sep), name)
        by_segment |= F.call_function("ilike", qualified, tail) | _like_tail(qualified, F.concat(F.lit(sep), tail)) | long & _like_tail(qualified, tail)
    return F.coalesce((recv != "") & (F.coalesce(by_parent, F.lit(False)) | by_segment), F.lit(False))


def names_place(recv: Column, path: Column) -> Column:
    """Whether a receiver names the candidate's file or one of its directories."""
    like = lambda *parts: F.call_function("ilike", path, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.coalesce((recv != "") & (like("%/", recv, ".%") | like(recv, ".%") | like("%/", recv, "/%") | like(recv, "/%")), F.lit(False))


def common_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix of two texts, by bisection over prefixes of their bytes."""
    x, y = F.encode(a, "utf-8"), F.encode(b, "utf-8")
    n = F.least(F.octet_length(a), F.octet_length(b))
    step = lambda acc, i: F.when((acc + i <= n) & (F.substring(x, F.lit(1), acc + i) == F.substring(y, F.lit(1), acc + i)), acc + i).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(11, -1, -1)]), F.lit(0), step)


def candidates_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols as candidates: sid, name, qualified, start_line, sfile, spath, family, parent."""
    parents = symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    mine = symbols.select(F.col("id").alias("sid"), "name", F.col("qualified_name").alias("qualified"), "start_line", F.col("file_id").alias("sfile"), "parent_id")
    places = files.select(F.col("file_id").alias("sfile"), F.col("path").alias("spath"), "family")
    return mine.join(parents, "parent_id", "left").join(places, "sfile").drop("parent_id")


def load_refs(refs: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """References in scope with counts of candidates: nsame in their file, cnt in their family."""
    named = candidates.groupBy("name", "family").agg(F.count(F.lit(1)).alias("all"))
    near = refs.filter("owner_id IS NOT NULL").join(files.select("file_id", "path", "family"), "file_id")
    here = candidates.select("name", F.col("sfile").alias("file_id"), "sid", "qualified", "parent", "spath")
    same = near.filter("recv IS NULL").join(here.groupBy("name", "file_id").agg(F.count(F.lit(1)).alias("here")), ["name", "file_id"]).select("id", (F.col("here") - F.col("no_self")).alias("nsame"))
    said = near.filter("recv IS NOT NULL AND recv <> ''").join(here, ["name", "file_id"])
    allowed = names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent")) | names_place(F.col("recv"), F.col("path"))
    pointed = said.filter(((F.col("no_self") == 0) | (F.col("sid") != F.col("owner_id"))) & allowed).groupBy("id").agg(F.count(F.lit(1)).alias("nsame"))
    both = same.unionByName(pointed)
    return near.join(both, "id", "left").join(named, ["name", "family"], "left").select(
        "id", "file_id", F.col("owner_id").alias("owner"), "name", "kind", "line", F.col("no_self").alias("excl"), "family", "path", "recv",
        F.coalesce("nsame", F.lit(0)).alias("nsame"), (F.coalesce("all", F.lit(0)) - F.col("no_self")).alias("cnt"))


def same_file(loaded: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tier 1: candidates of the reference's own file, the nearest four."""
    here = candidates.select("name", F.col("sfile").alias("file_id"), "sid", "start_line", "qualified", "parent")
    pairs = loaded.filter("nsame > 0").join(here, ["name", "file_id"])
    allowed = F.col("recv").isNull() | names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent")) | names_place(F.col("recv"), F.col("path"))
    pairs = pairs.filter(((F.col("excl") == 0) | (F.col("sid") != F.col("owner"))) & allowed)
    near = Window.partitionBy("id").orderBy(F.abs(F.col("start_line") - F.col("line")), "sid")
    return pairs.withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= MAX_LINKS).select(
        F.col("owner").alias("src"), F.col("sid").alias("dst"), "kind", F.lit(RESOLVED).alias("confidence"), "line", F.col("file_id").alias("src_file"), F.col("file_id").alias("dst_file"))


def _odd(asked: DataFrame, candidates: DataFrame, holds: Column) -> DataFrame:
    strange = asked.filter(F.col("recv").rlike(ODD) | F.col("name").rlike(ODD))
    return strange.join(candidates, ["name", "family"]).filter(holds).select("name", "family", "recv", "sid")


def _plain(asked: DataFrame) -> DataFrame:
    return asked.filter(~(F.col("recv").rlike(ODD) | F.col("name").rlike(ODD)))


def typed_pairs(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Asked (name, family, recv; distinct, recv not empty) with the candidates whose type the receiver names: name, family, recv, sid.

    The pairs of `names_type`, from equal keys: a receiver's own end, behind its last `_`, is an end of the candidate's
    parent or of what stands before its name. Only ends of lengths asked for are made.
    """
    low, name = F.lower("qualified"), F.lower("name")

    def head(sep: str) -> Column:  # before the separator and the name, in which `_` stands for any character
        tail = F.concat(F.lit(sep), name)
        ends = F.when(F.contains(name, F.lit("_")), F.call_function("like", low, F.concat(F.lit("%"), tail))).otherwise(F.endswith(low, tail))
        return F.when(ends & (F.length(low) > F.length(tail)), F.substring(low, F.lit(1), F.length(low) - F.length(tail)))

    text = {"parent": _flat(F.lower("parent"))} | {sep: head(sep) for sep in SEPARATORS}
    texts = candidates.select("name", "family", "sid", F.explode(F.array(*[F.struct(F.lit(k).alias("how"), v.alias("text")) for k, v in text.items()])).alias("x")).select("name", "family", "sid", "x.*").filter("text IS NOT NULL")
    piece = {"parent": _flat(F.col("recv"))} | {sep: F.substring_index(F.lower("recv"), "_", -1) for sep in SEPARATORS}
    wanted = _plain(asked).select("name", "family", "recv", F.explode(F.array(*[F.struct(F.lit(k).alias("how"), v.alias("piece")) for k, v in piece.items()])).alias("x")).select("name", "family", "recv", "x.*")
    lengths = wanted.groupBy("name", "family", "how").agg(F.collect_set(F.length("piece")).alias("lengths"))
    n = F.length("text")
    ends = F.transform(F.filter("lengths", lambda k: k <= n), lambda k: F.substring(F.col("text"), n - k + 1, k))
    tails = texts.select("name", "family", "how", "text").distinct().join(lengths, ["name", "family", "how"]).select("name", "family", "how", "text", F.explode(ends).alias("piece"))
    long, recv, like = F.length("recv") >= 4, F.lower("recv"), lambda *parts: F.call_function("like", F.col("text"), F.concat(*parts))
    by_segment = like(recv) | like(F.lit("%"), F.col("how"), recv) | long & like(F.lit("%"), recv)
    found = tails.join(wanted, ["name", "family", "how", "piece"]).filter(F.when(F.col("how") == "parent", (F.col("text") == F.col("piece")) | long).otherwise(by_segment))
    pairs = texts.join(found.select("name", "family", "how", "text", "recv"), ["name", "family", "how", "text"]).select("name", "family", "recv", "sid").distinct()
    return pairs.unionByName(_odd(asked, candidates, names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent"))))


def placed_pairs(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Asked (name, family, recv; distinct, recv not empty) with the candidates whose file or directory the receiver names: name, family, recv, sid.

    The pairs of `names_place`: every file is matched once with all receivers, by length and end of what stands in its
    path between separators, and its candidates take the receivers asked for their name.
    """
    plain = _plain(asked)
    said = plain.select("recv").distinct().withColumn("low", F.lower("recv"))
    wanted = said.select("recv", "low", F.length("low").alias("n"), F.substring_index("low", "_", -1).alias("piece"))
    places = candidates.select("sfile", "spath").distinct().crossJoin(F.broadcast(wanted.agg(F.max("n").alias("most"))))  # one row
    path = F.lower("spath")
    at = lambda i: F.substring(path, i, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: (i == 1) | (at(i - 1) == "/"))
    stops = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: at(i).isin("/", "."))
    parts = F.flatten(F.transform("starts", lambda b: F.transform(F.filter("stops", lambda e: (e > b) & (e - b <= F.col("most"))), lambda e: F.substring(path, b, e - b))))
    parted = places.filter("spath <> ''").withColumns({"starts": starts, "stops": stops}).select("sfile", F.explode(F.array_distinct(parts)).alias("part"))
    n = F.length("part")
    tails = parted.select("part").distinct().select("part", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("k")).select("part", "n", F.substring(F.col("part"), F.col("n") - F.col("k") + 1, F.col("k")).alias("piece"))
    named = tails.join(wanted, ["n", "piece"]).filter((F.col("part") == F.col("low")) | F.contains("low", F.lit("_")) & F.call_function("like", F.col("part"), F.col("low")))
    placed = parted.join(named.select("part", "recv"), "part").select("sfile", "recv").distinct()
    pairs = candidates.select("name", "family", "sid", "sfile").join(placed, "sfile").join(plain, ["name", "family", "recv"]).select("name", "family", "recv", "sid")
    return pairs.unionByName(_odd(asked, candidates, names_place(F.col("recv"), F.col("spath"))))


def hints(loaded: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per reference with a receiver and none in its file: the one candidate the receiver points at (id, hint)."""
    scope = loaded.filter("nsame = 0 AND recv IS NOT NULL AND recv <> '' AND excl IN (0, 1)")
    key = ["name", "family", "recv"]
    asked = scope.select(*key).distinct()
    none = F.lit(None).cast(candidates.schema["sid"].dataType)
    seen = typed_pairs(asked, candidates).select(*key, F.col("sid").alias("t"), none.alias("p")).unionByName(placed_pairs(asked, candidates).select(*key, none.alias("t"), F.col("sid").alias("p")))
    stats = seen.groupBy(*key).agg(*[f(c).alias(f"{c}_{f.__name__}") for c in "tp" for f in (F.count, F.min, F.max)])
    # at most one of two is the owner, so the counts and both ends tell the one candidate that is left without it
    owners = candidates.select(F.col("sid").alias("owner"), "name", "family", "qualified", "parent", "spath", F.lit(1).alias("excl"))
    told = scope.join(stats, key).join(owners, ["owner", "name", "family", "excl"], "left")
    own = {"t": names_type(F.col("recv"), F.col("name"), F.col("qualified"), F.col("parent")), "p": names_place(F.col("recv"), F.col("spath"))}
    told = told.withColumns({f"{c}_own": (F.col("excl") == 1) & own[c] for c in "tp"})
    left = {c: F.col(f"{c}_count") - F.col(f"{c}_own").cast("int") for c in "tp"}
    one = {c: F.when(F.col(f"{c}_own") & (F.col(f"{c}_max") == F.col("owner")), F.col(f"{c}_min")).otherwise(F.col(f"{c}_max")) for c in "tp"}
    hint = F.when(left["t"] == 1, one["t"]).when((left["t"] == 0) & (left["p"] == 1), one["p"])
    return told.select("id", hint.alias("hint")).filter("hint IS NOT NULL")


def beginnings(places: DataFrame) -> DataFrame:
    """Per file (file_id, path; distinct) the beginnings of its path where paths part, and the whole path: file_id, node, depth.

    Two paths part at one of these. A beginning is named by the least file below it and its bytes.
    """
    data = F.hex(F.encode("path", "utf-8"))
    long = places.select("file_id", data.alias("data"), F.explode(F.sequence(F.lit(0), F.octet_length("path"))).alias("depth"))
    begun = long.select("file_id", "depth", F.expr("substring(data, 1, 2 * depth)").alias("start"), F.expr("substring(data, 2 * depth + 1, 2)").alias("next"))
    parting = begun.groupBy("start").agg(F.min("file_id").alias("node"), F.min("next").alias("a"), F.max("next").alias("b")).filter("a <> b OR a = ''")
    return begun.select("file_id", "depth", "start").join(parting.select("start", "node"), "start").select("file_id", "node", "depth")


def picks(loaded: DataFrame, candidates: DataFrame, few: int = FEW) -> DataFrame:
    """Best candidates of ambiguous names per file: (name, family, file_id, rank, sid, sfile), longest shared path first.

    Files meet all candidates of a name while a family has at most `few`. Beyond that they meet, for each
    beginning of their path where paths part, the five first candidates below it, which always holds the five best:
    cost then grows with candidates and files, not with their product.
    """
    asked = loaded.filter("nsame = 0 AND cnt >= 2 AND hint IS NULL").select("name", "family", "file_id", "path", (F.col("cnt") + F.col("excl") > few).alias("many")).distinct()
    own = candidates.select("name", "family", "sid", "sfile", "spath")
    keys = ["name", "family", "file_id"]
    pairs = asked.filter("NOT many").join(own, ["name", "family"]).select(*keys, "sid", "sfile", "spath", common_prefix(F.col("spath"), F.col("path")).alias("shared"))
    hot = asked.filter("many")
    held = own.join(hot.select("name", "family").distinct(), ["name", "family"], "left_semi")
    at = cut(beginnings(held.select(F.col("sfile").alias("file_id"), F.col("spath").alias("path")).unionByName(hot.select("file_id", "path")).distinct()))
    met = hot.select(*keys).join(at, "file_id")
    below = held.join(at.withColumnRenamed("file_id", "sfile"), "sfile")
    begin = Window.partitionBy("node", "depth", "name", "family").orderBy("spath", "sid")  # the limit below is applied in each task before the shuffle too
    first = below.withColumn("nth", F.row_number().over(begin)).filter(F.col("nth") <= PICKS).drop("nth")
    near = met.join(first, ["node", "depth", "name", "family"]).groupBy(*keys, "sid", "sfile", "spath").agg(F.max("depth").alias("shared"))  # the last they meet at is where they part
    best = Window.partitionBy(*keys).orderBy(F.col("shared").desc(), "spath", "sid")
    ranked = pairs.unionByName(near).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= PICKS).select(*keys, "rank", "sid", "sfile")


def collapse(tiers: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind): its best confidence and first line."""
    return tiers.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"), F.min("src_file").alias("src_file"), F.min("dst_file").alias("dst_file"))


def resolve(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of all references.

    refs: id, file_id, owner_id, name, kind, line, no_self, recv. symbols: id, file_id, name, qualified_name,
    start_line, parent_id, one row per id. files: file_id, path, family. References without an owner, or of
    names nobody carries, give none; empty tables give none.
    """
    candidates = cut(candidates_of(symbols, files))
    loaded = cut(load_refs(refs, candidates, files))
    loaded = cut(loaded.join(hints(loaded, candidates), "id", "left"))
    first = same_file(loaded, candidates)
    free = loaded.filter("nsame = 0")
    to = [F.col("owner").alias("src"), F.col("sid").alias("dst"), "kind"]
    ends = ["line", F.col("file_id").alias("src_file"), F.col("sfile").alias("dst_file")]
    unique = free.filter("cnt = 1").join(candidates.select("name", "family", "sid", "sfile"), ["name", "family"]).filter("excl = 0 OR sid <> owner")
    sure = F.when(F.col("recv").isNull() | F.coalesce(F.col("hint") == F.col("sid"), F.lit(False)), HEURISTIC).otherwise(GUESS)
    second = unique.select(*to, sure.alias("confidence"), *ends)
    third = free.filter("cnt >= 2 AND hint IS NOT NULL").join(candidates.select(F.col("sid").alias("hint"), "sfile"), "hint").withColumnRenamed("hint", "sid").select(*to, F.lit(HEURISTIC).alias("confidence"), *ends)
    some = free.filter("cnt >= 2 AND hint IS NULL").join(picks(loaded, candidates), ["name", "family", "file_id"]).filter("excl = 0 OR sid <> owner")
    order = Window.partitionBy("id").orderBy("rank")
    fourth = some.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= MAX_LINKS).select(*to, F.lit(GUESS).alias("confidence"), *ends)
    return collapse(first.unionByName(second).unionByName(third).unionByName(fourth))


def touching(refs: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, file_ids: DataFrame, dirty: DataFrame) -> DataFrame:
    """Edges after a change, from the edges before it: only references in `file_ids` (file_id) or to names in
    `dirty` (name, family) are resolved again; edges from those files, into symbols of those names in their
    families, or into symbols that are gone are dropped. Equal to `resolve` of everything."""
    placed = symbols.select("id", "name", "file_id").join(files.select("file_id", "family"), "file_id")
    stale = placed.join(dirty, ["name", "family"], "left_semi").select(F.col("id").alias("dst"))
    redo_refs = refs.join(files.select("file_id", "family"), "file_id")
    redo = redo_refs.join(file_ids, "file_id", "left_semi").unionByName(redo_refs.join(dirty, ["name", "family"], "left_semi")).drop("family").distinct()
    kept = edges.join(file_ids.withColumnRenamed("file_id", "src_file"), "src_file", "left_anti").join(stale, "dst", "left_anti")
    alive = symbols.select(F.col("id").alias("dst"))
    kept = kept.join(alive, "dst", "left_semi")  # edges from what is gone went with its file
    return collapse(kept.select(*edges.columns).unionByName(resolve(redo, symbols, files).select(*edges.columns)))
