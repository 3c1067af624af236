"""Problem 8: evaluation texts that occur in training texts.

Method: an FM-index per training shard. The words of a shard are suffix-sorted, their
Burrows-Wheeler sequence is held in a wavelet tree with block ranks, every window of
``min_words`` words of the evaluation items is backward-searched (all windows at once),
hits are located by sampled suffix positions and overlapping windows merge into spans.

Words that no evaluation item has, and the ends of documents, become symbols of their
own, all different: no window can run over them, and the suffix sort stops at them.

Words are 64-bit hashes. Tasks cut the items into words and write them to the shared folder; each task over the corpus
builds one index per shard and streams the items past it in blocks of bounded size. The corpus is read once however
many items there are, no item passes through the driver, and what is broadcast is a bit field of fixed size.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.visual_form import skeleton
from loomgrain.session import shared_folder
from loomgrain.tables import spread

WORD = re.compile(r"[^\W_]+")
SAMPLE = 8
FIELD_BITS = 22  # words of the items, as a bit field of 512 KiB; a clash costs time, not correctness


def comparable(text: str) -> str:
    """The look-alike form, composed again so that accented letters are letters, in lower case."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", skeleton(text)).lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(comparable(text)) if text else []


class RankBits:
    """A bit sequence with rank in constant time: 64-bit blocks and running counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        block, shift = upto >> 6, (upto & 63).astype(np.uint64)
        mask = (np.uint64(1) << shift) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks over a sequence of small integers, one bit level at a time (levels as a matrix)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, RankBits, int]] = []
        seq = symbols
        for shift in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = (seq >> shift) & 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, RankBits(bits.astype(np.uint8)), zeros))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(upto), upto.copy()
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            s1, e1 = bits.ones(start), bits.ones(end)
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(np.int64)
            before = bits.ones(at)
            value |= one << shift
            at = np.where(one == 1, zeros + before, at - before)
        return value


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling; symbol 0 differs from every other 0."""
    n = len(symbols)
    rank = np.where(symbols == 0, np.arange(n, dtype=np.int64), symbols + n)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[:0]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Backward search and location over one shard. Symbol 0 stands for words that are never searched."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_order(symbols)
        n = len(symbols)
        bwt = symbols[(order - 1) % n]
        self.tree = WaveletTree(bwt, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        # a walk back never has to cross symbol 0 or the start: such rows are sampled, and every SAMPLE-th
        kept = (bwt == 0) | (order % SAMPLE == 0)
        self.kept, self.positions = RankBits(kept.astype(np.uint8)), order[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of the suffixes that begin with each phrase (one phrase per row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for symbol in phrases.T[::-1]:
            s = symbol[alive]
            low[alive] = self.first[s] + self.tree.rank(s, low[alive])
            high[alive] = self.first[s] + self.tree.rank(s, high[alive])
            dead = alive[high[alive] <= low[alive]]
            low[dead] = high[dead] = 0
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            hit = self.kept.get(here).astype(bool)
            done = open_[hit]
            out[done] = self.positions[self.kept.ones(at[done])] + steps[done]
            open_ = open_[~hit]
            here = at[open_]
            s = self.tree.access(here)
            at[open_] = self.first[s] + self.tree.rank(s, here)
            steps[open_] += 1
        return out


class _Hashes(dict):
    """64-bit hashes of words, each computed once; emptied when large, so the memory of a worker is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return h


_hash_of = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([_hash_of[w] for w in words(text)], np.int64)


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, words)`` of ``items(item_id, text)``; words as hashes, in order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b.item_id, "words": [word_hashes(t) for t in b.text]})

    return items.mapInPandas(cut, "item_id long, words array<long>")


def word_field(cut: DataFrame) -> np.ndarray:
    """A bit field of the words of ``cut(item_id, words)``: 2^16 longs at most come to the driver, whatever the items."""
    slot = F.col("w").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    bits = cut.select(F.explode("words").alias("w")).groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("bits"))
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    for r in bits.collect():
        field[r["at"]] = r["bits"]
    return field


def _in_field(hashes: np.ndarray, field: np.ndarray) -> np.ndarray:
    slot = hashes & ((1 << FIELD_BITS) - 1)
    return (field[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


_one_block: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}


def item_blocks(folder: str, block_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(item, row, word)`` of each word in blocks of about ``block_words``, from the shared folder. A sole block is kept by the worker."""
    import pyarrow.fs
    import pyarrow.parquet

    if (folder, block_words) in _one_block:
        yield from _one_block[folder, block_words]
        return
    if folder.startswith("file:") or "://" not in folder:
        system, path = pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    else:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
    blocks, held, size, sole, row = 0, [], 0, None, 0
    for info in sorted(system.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
        if not info.path.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as f:
            for batch in pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=256):
                lists = batch.column("words")
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                owner = np.repeat(batch.column("item_id").to_numpy(), lengths)
                held.append((owner, np.repeat(np.arange(row, row + len(lengths)), lengths), lists.flatten().to_numpy()))
                row += len(lengths)
                size += len(owner)
                if size >= block_words:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    blocks, held, size = blocks + 1, [], 0
    if held:
        sole = tuple(np.concatenate(x) for x in zip(*held))
    if not blocks:
        _one_block.clear()
        _one_block[folder, block_words] = [sole] if sole else []
    if sole:
        yield sole


def _shard_hits(docs: list[int], starts: list[int], chunks: list[np.ndarray], known: list[np.ndarray], folder: str, min_words: int, block_words: int) -> pd.DataFrame:
    """Spans of one shard: an index over its words, all item windows searched block by block."""
    offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in chunks])])
    inside = np.zeros(offsets[-1], bool)
    flat = np.zeros(offsets[-1], np.int64)
    for at, chunk, ok in zip(offsets, chunks, known):
        flat[at : at + len(chunk)], inside[at : at + len(chunk)] = chunk, ok
    vocabulary, named = np.unique(flat[inside], return_inverse=True)
    symbols = np.zeros(offsets[-1], np.int64)
    symbols[inside] = named + 1
    parts = [pd.DataFrame({"doc_id": [], "item_id": [], "first_word": [], "last_word": []}, dtype=np.int64)]
    index = None
    for owner, row, item in item_blocks(folder, block_words):
        if not len(vocabulary) or len(item) < min_words:
            continue
        place = np.minimum(np.searchsorted(vocabulary, item), len(vocabulary) - 1)
        strange = np.concatenate([[0], np.cumsum(vocabulary[place] != item)])
        begin = np.arange(len(item) - min_words + 1)
        begin = begin[(strange[begin + min_words] == strange[begin]) & (row[begin] == row[begin + min_words - 1])]
        if not len(begin):
            continue
        index = index or FMIndex(symbols, len(vocabulary) + 1)
        low, high = index.search(place[begin[:, None] + np.arange(min_words)] + 1)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        rows = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        position = index.locate(rows)
        chunk = np.searchsorted(offsets, position, side="right") - 1
        first = position - offsets[chunk] + np.array(starts, np.int64)[chunk]
        parts.append(_merge(pd.DataFrame({"doc_id": np.array(docs, np.int64)[chunk], "item_id": np.repeat(owner[begin[found]], counts), "first_word": first, "last_word": first + min_words - 1})))
    return _merge(pd.concat(parts, ignore_index=True))


def _merge(hits: pd.DataFrame) -> pd.DataFrame:
    """Windows of one document and item that touch or overlap become one span."""
    hits = hits.sort_values(["doc_id", "item_id", "first_word"], ignore_index=True)
    same = (hits.doc_id == hits.doc_id.shift()) & (hits.item_id == hits.item_id.shift())
    span = (~(same & (hits.first_word <= hits.last_word.shift() + 1))).cumsum()
    return hits.groupby(span).agg(doc_id=("doc_id", "first"), item_id=("item_id", "first"), first_word=("first_word", "min"), last_word=("last_word", "max"))


def leaked_spans(
    corpus: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    min_words: int = 13,
    shard_words: int = 400_000,
    block_words: int = 2_000_000,
) -> DataFrame:
    """Spans of each corpus text that hold at least ``min_words`` consecutive words of an item.

    Columns: ``doc_id``, ``item_id``, ``first_word``, ``last_word`` (word numbers, both ends included).
    A task holds one shard of the corpus and one block of about ``block_words`` words of the items at a time; the corpus
    never moves. A text longer than a shard is cut into pieces that share ``min_words - 1`` words. Null keys and texts
    match nothing; items shorter than ``min_words`` words have no window; a repeated row repeats its spans.
    """
    spark = corpus.sparkSession
    source = corpus.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    folder = shared_folder(spark, "leak-items")
    item_words(wanted).where(F.size("words") >= min_words).write.parquet(folder)
    field = spark.sparkContext.broadcast(word_field(spark.read.parquet(folder)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, starts, chunks, known, held = [], [], [], [], 0
        stride = shard_words - min_words + 1
        for batch in batches:
            for doc, body in zip(batch.doc_id, batch.text):
                seq = word_hashes(body)
                ok = _in_field(seq, field.value)
                strange = np.concatenate([[0], np.cumsum(~ok)])
                if len(seq) < min_words or not (strange[min_words:] == strange[:-min_words]).any():
                    continue  # no run of words that items have is long enough
                for start in range(0, len(seq) - min_words + 1, stride):
                    docs.append(doc)
                    starts.append(start)
                    chunks.append(seq[start : start + shard_words])
                    known.append(ok[start : start + shard_words])
                    held += len(chunks[-1]) + 1
                if held >= shard_words:
                    yield _shard_hits(docs, starts, chunks, known, folder, min_words, block_words)
                    docs, starts, chunks, known, held = [], [], [], [], 0
        if chunks:
            yield _shard_hits(docs, starts, chunks, known, folder, min_words, block_words)

    return spread(source, "doc_id").mapInPandas(scan, "doc_id long, item_id long, first_word long, last_word long")


def leaked_items(corpus: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` of :func:`leaked_spans`."""
    return leaked_spans(corpus, items, **options).select("doc_id", "item_id").distinct()
