"""Problem 10: one form for texts that look the same.

Method: confusables skeleton. A text is decomposed, every character is replaced by
its prototype, and the result is decomposed again; texts with equal skeletons look
the same. Prototypes come from rules over the Unicode character database (width and
font variants, numerals that are drawn as letters, spaces, invisible characters) and a
table of look-alike letters of other scripts. Letter case, accents and digits stay apart:
an accent is only brought to its decomposed spelling, and a digit is never made a letter.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgrain.llm.buckets import BLOCK, member_pairs
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, cell_pairs, hot_join
from loomgrain.tables import spread, wide_hash

# Letters of other scripts that are drawn like a Latin letter, by script: the letters, and the
# Latin letters that stand in the same places.
LOOK_ALIKES = {
    "Cyrillic": ("АВСԌЕНІӀЈКМОРԚЅТѴԜХҮасԁеһіјӏорԛѕѵԝхуү", "ABCGEHIIJKMOPQSTVWXYacdehijlopqsvwxyy"),
    "Greek": ("ΑΒΕϜΖΗΙͿΚΜΝΟΡϹΤΥΧαιϳκνορϲυτ", "ABEFZHIJKMNOPCTYXaijkvopcut"),
    "Armenian": ("ՍՏՕցհոսօ", "USOghnuo"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏂᏏᏒᏔᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiyAJEWMHYGZhbRWVSLCPKdB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Coptic": ("ⲀⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲬ", "ABHIKMNOoPpCcTX"),
    "Latin forms": ("ɑɡᴄᴏꜱᴜᴠᴡᴢ", "agcosuvwz"),
}
# Fillers and joiners without ink whose category is not format.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str | None]:
    """Code point -> prototype; None removes the character."""
    table: dict[int, str | None] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xDFFF or 0x20000 <= code <= 0xDFFFF:
            continue  # ideographs, syllables and private planes have no rule
        ch = chr(code)
        kind = unicodedata.category(ch)
        decomposed = unicodedata.decomposition(ch)
        if kind == "Zs":
            table[code] = " "
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or ch in INVISIBLE:
            table[code] = None
        elif decomposed.startswith(("<wide>", "<narrow>", "<font>")) or kind == "Nl" and decomposed.startswith("<compat>"):
            table[code] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
    for others, latin in LOOK_ALIKES.values():
        for ch, like in zip(others, latin, strict=True):
            table[ord(ch)] = like
    return {k: v if v is None else "".join(table.get(ord(c), c) or "" for c in v) for k, v in table.items()}


def skeleton(text: str) -> str:
    """The skeleton of one text; plain ASCII is its own skeleton."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


@F.pandas_udf(StringType())
def skeleton_udf(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def with_skeleton(df: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """``df`` with the skeleton of ``text``. A null text has a null skeleton, an empty one an empty one."""
    return df.withColumn(out, skeleton_udf(F.col(text)))


def visual_classes(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 61) -> DataFrame:
    """One row per record: ``key``, ``form`` (128-bit hash of the skeleton) and ``cid`` (of the text as stored).

    Null keys and texts, and skeletons of fewer than ``min_length`` characters, are left out; repeated keys
    with equal texts count once.
    """
    rows = df.select(F.col(key), F.col(text).alias("_t")).where(f"`{key}` is not null and _t is not null").select(key, wide_hash("_t").alias("cid"), "_t")

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # as a stage of its own: an expression would be evaluated for the filter and again for the hashes
            yield b.drop(columns="_t").assign(_s=b["_t"].map(skeleton))

    form = spread(rows, key).mapInPandas(shape, f"`{key}` {dict(df.dtypes)[key]}, cid binary, _s string")
    return form.where(F.char_length("_s") >= min_length).select(key, wide_hash("_s").alias("form"), "cid").distinct()


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 61, block: int = BLOCK, floor: int = FLOOR) -> DataFrame:
    """Pairs ``(doc_a, doc_b)`` of records with equal skeletons and different stored texts, smaller key first.

    Stored texts of one form are paired first, each once, and their records are put in last, so copies of a stored text are
    never compared. A form of more than ``block`` stored texts is cut into a triangle of cells.
    """
    rows = cut_lineage(visual_classes(df, key, text, min_length))  # hashes only
    spelt = rows.select("form", "cid").distinct()
    texts = cut_lineage(cell_pairs(spelt, "form", "cid", block=block, floor=floor))
    spelt = texts.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    mixed = spelt.select("cid", F.lit(True).alias("_mixed"))
    members = hot_join(rows.select("cid", F.col(key).alias("key")), mixed, "cid", floor=floor).select("cid", "key")
    pairs = member_pairs(texts, members, block=block, floor=floor).where("key_a != key_b")
    return pairs.select(F.least("key_a", "key_b").alias("doc_a"), F.greatest("key_a", "key_b").alias("doc_b")).distinct()


def form_classes(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 0, floor: int = FLOOR) -> DataFrame:
    """One row per record with a text: ``(key, form_id, members, spellings)``.

    ``form_id`` is the least key among records of equal skeletons, ``spellings`` how many different texts they are stored as.
    """
    rows = cut_lineage(visual_classes(df, key, text, min_length))
    spelt = rows.groupBy("form", "cid").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    classes = spelt.groupBy("form").agg(F.min("least").alias("form_id"), F.sum("n").alias("members"), F.count("*").alias("spellings"))
    return hot_join(rows, classes, "form", floor=floor).select(key, "form_id", "members", "spellings")
