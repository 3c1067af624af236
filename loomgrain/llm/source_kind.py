"""Problem 5: generated, minified, vendored and data-only source files.

Method: files are cut into tokens once; identifiers, numbers and strings are masked, and five-token shingles of the
masked sequence are clustered by MinHash banding with verification, as are those of the tokens as they stand.

* A masked family of several different texts within one repository indicates generation: people do not write the same code
  again with other names. Across repositories short texts are alike by chance, so a family counts within one.
* A cluster of (unmasked) near-copies in several repositories indicates vendoring.
* A masked cluster of little but literals is a blob, one without room between its tokens is minified.
* What a family declares about itself speaks for other files: the lines of the comments before the first and after the last
  code, with the file's own path words masked, are templates; a template that families use is a tool's, and the files that
  bear it are the tool's output.

No word list or pattern decides: a cluster does, by counts over its members. A file alone is a cluster of one. Wordings
and path conventions (``declared``) are reported beside the result for the reader.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.buckets import bucket_groups
from loomgrain.llm.set_join import Banding, band_keys
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, hot_join, with_stats
from loomgrain.tables import spread

SHINGLE = 5
# masked code has few different shingles, so its families are held to 0.9, of which a pair is missed with 7e-3; copies
# are held to 0.8, missed with 2e-3. Groups are joined through any pair, so members of larger groups are missed far less.
LIMITS = {"masked": 0.9, "plain": 0.8}
BANDINGS = {"masked": Banding(bands=40, rows=20, seed=5, pool=128), "plain": Banding(bands=16, rows=5, seed=5)}
FIELD_BITS = 24
PIECE_BYTES = 1 << 20
# Declarations of tools and of foreign code, and path conventions; they explain and do not decide.
DECLARED = re.compile(r"(?i)@generated|auto-?generated|(?:machine|automatically|code)[- ](?:written|generated|made)|generated (?:by|from|with|using) \S+|do not (?:edit|modify)|copied (?:verbatim )?from|vendored (?:from|copy)")
DECLARED_PATH = re.compile(r"(?i)(?:^|/)(?:__generated__|gen|autogen|node_modules|third[_-]party|vendor|vendored|external)/|\.(?:generated|pb|min|bundle)\.\w+$|_pb2?(?:_grpc)?\.\w+$")
# Words that masking leaves as they are.
WORDS = (
    "abstract and as assert async await break case catch class const continue crate def default del do dyn elif else enum except export extends finally fn for from function global if impl implements "
    "import in instanceof interface is lambda let loop match mod move mut new nonlocal not null or pass pub raise ref return self static struct super switch this throw trait try type typeof unsafe use var void where while with yield "
    "None True False true false Self"
).split()
QUOTED = re.compile(
    r"(?P<f>```)|(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<![\w\])}])#(?![!\[])[^\n]*)|(?P<s>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)"
)
WORD = re.compile(r"\d[\w.]*|[^\W\d]\w*|\$[\w$]*|[^\s\w]")
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HEAD_TOKEN = re.compile(r"[^\W\d_]+|\d\w*|[^\s\w]")


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


NAME, NUMBER, STRING, FENCE = (_word_hash(w) for w in ("<name>", "<number>", "<string>", "```"))
IS_NAME, IS_NUMBER, IS_STRING = 1, 2, 3


class _Words(dict):
    """Word -> its place in ``table``: hash, hash under the mask, kind and length. Started anew when its words or their characters
    are many, so a worker's memory is bounded."""

    def __init__(self) -> None:
        super().__init__()
        self.start()

    def start(self) -> None:
        self.clear()
        self.table = np.zeros((1 << 16, 4), np.uint64)
        self.chars = 0

    def renew(self) -> None:
        if len(self) > 100_000 or self.chars > 1 << 22:
            self.start()

    def __missing__(self, word: str) -> int:
        h, c = _word_hash(word), word[0]
        self.chars += len(word)
        if c in "\"'`" and len(word) > 1:
            entry = (h, FENCE if word == "```" else STRING, IS_STRING, len(word))
        elif c.isdigit():
            entry = (h, NUMBER, IS_NUMBER, len(word))
        elif c == "_" or c == "$" or c.isalpha():
            entry = (h, h if word in _kept else NAME, IS_NAME, len(word))
        else:
            entry = (h, h, 0, len(word))
        place = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[place] = entry
        self[word] = place
        return place


_words = _Words()
_kept = set(WORDS)


def leading_comment(text: str) -> str:
    """The comments before the first code."""
    at, out = 0, []
    part = re.compile(r"\s+|﻿|#![^\n]*|//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/")
    while m := part.match(text, at):
        out.append(m.group())
        at = m.end()
    return "".join(out)


def _shingles(tokens: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five tokens, each once; fewer tokens make one run."""
    if not len(tokens):
        return np.empty(0, np.int64)
    runs = max(1, len(tokens) - SHINGLE + 1)
    out = np.zeros(runs, np.uint64)
    for k in range(min(SHINGLE, len(tokens))):
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ (tokens[k : runs + k] + (out >> np.uint64(31)))
    return np.unique(out.view(np.int64))


def head_lines(path: str, head: str) -> list[int]:
    """The lines of an enclosing comment as templates: words of the file's own path and numbers masked, each line as one hash."""
    own = {w.lower() for w in PIECE.findall(path)}
    stems = tuple(w for w in own if len(w) > 3)
    out = set()
    for line in head.split("\n"):
        parts, named = [], False
        for word in HEAD_TOKEN.findall(line.lower()):
            if word[0].isdigit():
                parts.append("N")
            elif word in own or word.startswith(stems):
                parts.append("I")
            else:
                parts.append(word)
                named = named or word[0].isalpha()
        if named:
            out.add(_word_hash(" ".join(parts).strip("/*#! =")) - (1 << 63))
    return sorted(out)


def describe(path: str | None, text: str, repo: str | None = None) -> dict:
    """What one file shows by itself: shingles, template lines and counts. Documents (markup, JSON, patches) are no code."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    head = leading_comment(text)
    _words.renew()
    rows: list[int] = []
    first, after, at, templates = "", [], len(head), 0
    for m in QUOTED.finditer(text, at):
        found = WORD.findall(text, at, m.start())
        if found:
            first = first or found[0]
            rows += [_words[w] for w in found]
            after.clear()
        at = m.end()
        if m.lastgroup == "c":
            after.append(m.start())
            continue
        word = m.group()
        after.clear()
        first = first or word
        rows.append(_words[word])  # the fence of a quoted listing is no string: what it holds is code
        templates += len(word) if word[0] == "`" else 0
    found = WORD.findall(text, at)
    if found:
        first = first or found[0]
        rows += [_words[w] for w in found]
        after.clear()
    plain, masked, kinds, lengths = _words.table[rows].T if rows else np.zeros((4, 0), np.uint64)
    values = kinds >= IS_NUMBER
    literal, total = int(lengths[values].sum()) - templates, int(lengths.sum())
    numbers, strings, names = (int((kinds == k).sum()) for k in (IS_NUMBER, IS_STRING, IS_NAME))
    tail = text[after[0] :] if after and rows else ""
    said = f"{head}\n{tail}"
    body = text[len(head) :]
    return {
        "code": bool(rows) and first not in ("{", "[", "<", "-"),
        "names": names,
        "vals": strings + numbers,
        "literal": literal,
        "total": total,
        "lines": sum(1 for x in body.split("\n") if x.strip()),
        "chars": len(body) - body.count("\n"),
        "gaps": len(body.split()),
        "tokens": len(rows),
        "heads": head_lines(f"{repo or ''}/{path or ''}", said) if said.strip() else [],
        "declared": bool(DECLARED.search(said) or DECLARED_PATH.search(path or "")),
        "masked": masked,
        "plain": plain,
    }


COUNTS = ["names", "vals", "literal", "total", "lines", "chars", "gaps", "tokens"]
EVIDENCE = (
    "file_id long, repo string, code boolean, declared boolean, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", heads array<long>, masked_set binary, plain_set binary, masked_bands array<long>, plain_bands array<long>, masked_shingles array<int>"
)


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches by column, about ``PIECE_BYTES`` of text at a time: what a worker makes of them does not follow the size of a batch."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("content")).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // PIECE_BYTES
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for start, stop in zip(starts, np.append(starts[1:], len(sizes))):
            yield batch.slice(start, stop - start).to_pydict()


def _low_halves(shingles: np.ndarray) -> np.ndarray:
    return (shingles & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def file_evidence(files: DataFrame) -> DataFrame:
    """One row of evidence per row of ``files``; null ids and contents are left out. Texts are read whole and stay behind."""
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in EVIDENCE.split(", "))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            found, sets = [], {kind: [] for kind in BANDINGS}
            for path, text, repo in zip(piece["file_path"], piece["content"], piece["repo"]):
                d = describe(path, text, repo)
                for kind in BANDINGS:  # tokens of one file at a time
                    tokens = d.pop(kind)
                    sets[kind].append(_shingles(tokens) if d["code"] else np.empty(0, np.int64))
                found.append(d)
            columns = {"file_id": piece["file_id"], "repo": piece["repo"], **{k: [d[k] for d in found] for k in ("code", "declared", *COUNTS, "heads")}}
            for kind, banding in BANDINGS.items():
                full = [i for i, s in enumerate(sets[kind]) if len(s)]
                ids, bands = [None] * len(found), [np.empty(0, np.int64)] * len(found)
                if full:
                    starts = np.concatenate([[0], np.cumsum([len(sets[kind][i]) for i in full])[:-1]])
                    keys = band_keys(np.concatenate([sets[kind][i] for i in full]), starts, banding)
                    for i, row in zip(full, keys):
                        ids[i], bands[i] = hashlib.blake2b(sets[kind][i].tobytes(), digest_size=16).digest(), row
                columns |= {f"{kind}_set": ids, f"{kind}_bands": bands}
            columns["masked_shingles"] = [_low_halves(s) for s in sets["masked"]]
            yield pa.RecordBatch.from_pydict(columns, schema)

    rows = files.where("file_id is not null and content is not null").select("file_id", "repo", "file_path", "content")
    return spread(rows, "file_id").mapInArrow(look, EVIDENCE)


def _field_of(ids: DataFrame) -> np.ndarray:
    """A bit field of fixed size over hashed ids: what lies outside it is none of them. At most 2^18 longs come to the driver."""
    slots = ids.select(F.pmod(F.xxhash64("file_id"), F.lit(1 << FIELD_BITS)).alias("slot"))
    bits = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    for r in bits.collect():
        field[r["at"]] = r["bits"]
    return field


def plain_shingles(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(file_id, s)`` of the files of ``wanted(file_id)``, cut again where they lie; no text is moved."""
    field = files.sparkSession.sparkContext.broadcast(_field_of(wanted))

    schema = pa.schema([("file_id", pa.int64()), ("s", pa.list_(pa.int32()))])

    def probable_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        return batch.filter(pa.array((field.value[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(map(probable_rows, batches)):
            yield pa.RecordBatch.from_pydict({"file_id": piece["file_id"], "s": [_low_halves(_shingles(describe(None, t)["plain"])) for t in piece["content"]]}, schema)

    rows = files.where("file_id is not null and content is not null").select("file_id", "content", F.pmod(F.xxhash64("file_id"), F.lit(1 << FIELD_BITS)).alias("slot"))
    probable = spread(rows, "file_id").mapInArrow(cut, "file_id long, s array<int>")
    return probable.join(wanted, "file_id", "left_semi").dropDuplicates(["file_id"])


def clusters(rows: DataFrame, files: DataFrame, floor: int = FLOOR) -> DataFrame:
    """``(cid, cluster)``: near-copies among the distinct shingle sets, masked ones and plain ones, verified exactly.

    ``rows`` are those of the files that name a set (``masked_of`` or ``plain_of`` is their own id); a set is named 2 id, a
    plain one 2 id + 1. Both kinds go through one pass, kept apart by hashing the kind into the bucket keys.
    """

    def named(kind: str, tag: int) -> DataFrame:
        return rows.where(f"file_id = {kind}_of").select((F.shiftleft("file_id", 1) + tag).alias("cid"), F.explode(f"{kind}_bands").alias("b")).select("cid", F.xxhash64("b", F.lit(tag)).alias("bucket"))

    banded = with_stats(named("masked", 0).unionByName(named("plain", 1)), "bucket", {"n": F.count("*")}, floor=floor).where("n > 1")
    banded = cut_lineage(banded.select("bucket", "cid"))
    shared = banded.select("cid").distinct()
    masked = rows.where("file_id = masked_of").select(F.shiftleft("file_id", 1).alias("cid"), F.col("masked_shingles").alias("s")).join(shared, "cid", "left_semi")
    wanted = cut_lineage(shared.where("cid & 1 = 1").select(F.shiftright("cid", 1).alias("file_id")))
    plain = plain_shingles(files, wanted).select((F.shiftleft("file_id", 1) + 1).alias("cid"), "s")
    sets = cut_lineage(masked.unionByName(plain))
    a = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    limit = F.when(F.col("a").bitwiseAND(F.lit(1)) == 1, LIMITS["plain"]).otherwise(LIMITS["masked"])
    common = F.size(F.array_intersect("sa", "sb"))
    alike = (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(1)) == 0) & (common >= limit * (F.size("sa") + F.size("sb") - common))
    found = bucket_groups(banded, "bucket", "cid", lambda pairs: pairs.join(a, "a").join(b, "b").where(alike).select("a", "b"), floor=floor)
    return found.select(F.col("id").alias("cid"), F.col("group_id").alias("cluster"))


def source_kinds(files: DataFrame, family: int = 3, share: float = 0.3, line_share: float = 0.05, rounds: int = 2, floor: int = FLOOR) -> DataFrame:
    """Every file with a non-null content and why it isn't hand-written: ``file_id``, ``repo``, ``generated``, ``minified``, ``vendored``, ``data``, ``declared``.

    A redelivered file counts once. ``family``: so many different texts of one masked cluster within a repository show a tool at
    work; ``share``: of a cluster, tool output that speaks for the rest; ``line_share``: of the files with a template line, tool output that
    makes the line a tool's. ``rounds``: how often evidence passes from clusters to lines and back. ``declared`` says whether the
    wording or the path says so too; it decides nothing.
    """
    evidence = cut_lineage(file_evidence(files))
    narrow = evidence.drop("masked_bands", "plain_bands", "masked_shingles").dropDuplicates(["file_id"])
    narrow = with_stats(cut_lineage(narrow.withColumn("masked_set", F.coalesce("masked_set", F.unhex(F.lpad(F.hex("file_id"), 20, "0")))).withColumn("plain_set", F.coalesce("plain_set", F.unhex(F.lpad(F.hex("file_id"), 20, "0"))))), "masked_set", {"masked_of": F.min("file_id")}, floor=floor)
    narrow = cut_lineage(with_stats(cut_lineage(narrow), "plain_set", {"plain_of": F.min("file_id")}, floor=floor).drop("masked_set", "plain_set"))
    reps = narrow.where("code and (file_id = masked_of or file_id = plain_of)").select("file_id", "masked_of", "plain_of")
    rows = evidence.select("file_id", "masked_bands", "plain_bands", "masked_shingles").join(reps, "file_id").dropDuplicates(["file_id"])
    labels = cut_lineage(clusters(cut_lineage(rows), files, floor))

    def placed(df: DataFrame, kind: str, tag: int) -> DataFrame:
        own = labels.where(F.col("cid").bitwiseAND(F.lit(1)) == tag).select(F.shiftright("cid", 1).alias(f"{kind}_of"), F.shiftright("cluster", 1).alias(f"{kind}_cluster"))
        joined = hot_join(df, own, f"{kind}_of", "left", floor=floor)
        return joined.withColumn(f"{kind}_cluster", F.coalesce(f"{kind}_cluster", f"{kind}_of"))

    base = cut_lineage(placed(cut_lineage(placed(narrow, "masked", 0)), "plain", 1))
    code = base.where("code")
    # distinct texts first: the counts of a large family combine before they meet
    texts = code.groupBy("masked_cluster", "repo", "plain_of").agg(*[F.sum(c).alias(c) for c in COUNTS])
    own = texts.groupBy("masked_cluster", "repo").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in COUNTS])
    shapes = own.groupBy("masked_cluster").agg(F.max("texts").alias("texts"), *[F.sum(c).alias(c) for c in COUNTS])
    blob = (F.col("vals") > 0) & ((F.col("literal") > 0.75 * F.col("total")) | (F.col("names") <= 0.2 * F.col("vals")))
    dense = (F.col("chars") > 100 * F.col("lines")) & (F.col("tokens") > 3 * F.col("gaps"))
    shapes = shapes.select("masked_cluster", (F.col("texts") >= family).alias("kin"), blob.alias("blob"), dense.alias("dense"))
    copies = code.groupBy("plain_cluster", "repo").agg(F.lit(1)).groupBy("plain_cluster").agg((F.count("*") > 1).alias("copied")).where("copied")
    base = hot_join(cut_lineage(hot_join(base, shapes, "masked_cluster", "left", floor=floor)), copies, "plain_cluster", "left", floor=floor)
    no = F.lit(False)
    base = base.select(
        "file_id", "repo", "code", "declared", "heads", "masked_cluster",
        (F.coalesce("blob", no) & F.col("code")).alias("data"),
        (F.coalesce("dense", no) & F.col("code")).alias("minified"),
        (F.coalesce("copied", no) & F.col("code")).alias("vendored"),
        (F.coalesce("kin", no) & F.col("code")).alias("kin"),
    )
    base = cut_lineage(base)
    lines = cut_lineage(base.select("file_id", F.explode("heads").alias("line")))
    made = base.withColumn("made", F.col("kin") & ~F.col("data") & ~F.col("vendored")).select("file_id", "masked_cluster", "code", "vendored", "made")
    for _ in range(rounds):
        made = cut_lineage(made)
        seeds = lines.join(made.select("file_id", "made"), "file_id")
        tool = cut_lineage(seeds).groupBy("line").agg(F.count("*").alias("n"), F.count_if("made").alias("s")).where(F.col("s") >= F.greatest(F.lit(1.0), F.col("n") * line_share)).select("line")
        borne = hot_join(lines, tool, "line", floor=floor).select("file_id").distinct().withColumn("borne", F.lit(True))
        made = made.join(borne, "file_id", "left").withColumn("made", F.col("made") | F.coalesce("borne", no)).drop("borne")
        kin = cut_lineage(made)
        kinship = kin.where("code").groupBy("masked_cluster").agg(F.count("*").alias("n"), F.count_if("made").alias("m")).where(F.col("m") >= F.col("n") * share).select("masked_cluster", F.lit(True).alias("spoken"))
        made = hot_join(kin, kinship, "masked_cluster", "left", floor=floor).withColumn("made", F.col("made") | (F.coalesce("spoken", no) & F.col("code") & ~F.col("vendored"))).drop("spoken")
    out = base.join(made.select("file_id", "made"), "file_id")
    return out.select("file_id", "repo", (F.col("made") & ~F.col("minified")).alias("generated"), (F.col("minified") & ~F.col("data")).alias("minified"), "vendored", "data", "declared")
