"""Packing documents into fixed-length token sequences by hierarchical best fit."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pieces that one local packing task takes, and groups merged into one on the way up.
LOCAL_PIECES, FAN_IN = 20_000, 8
#: Unfinished bins that a group hands on for another round, the emptiest first; the other bins are done.
CARRIED = 512
#: Word encodings that a Python worker remembers before it starts anew, and those of words with punctuation among them.
REMEMBERED, MARKED = 1_000_000, 400_000
#: Runs of ASCII punctuation, but for the apostrophe, with a letter, digit or white space on either side
#: (U+001C to U+001F, white space elsewhere, are punctuation to the tokenizer).
_MARKS = re.compile(r"(?<![^\w\s])(?<![_\x1c-\x1f])([!-&(-/:-@\[-`{-~]++)(?![^\w\s])(?![\x1c-\x1f])")


class WordEncoder:
    """Token ids as little-endian uint32 bytes. A run without blanks and line ends is encoded on its own, which
    the tokenizer allows: its normaliser and pre-tokeniser never look across white space. So that words repeat more
    often, Latin-1 texts are lower-cased as the normaliser does, and Latin-1 runs that are new are cut round punctuation
    where the pre-tokeniser cuts anyway, so that their parts may be known."""

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.marked: list[str] = []
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([end_id], "<u4").tobytes()

    @staticmethod
    def words(text: str | None) -> list[str]:
        text = text or ""
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass  # elsewhere lower-casing before the normaliser's composition can differ
        return text.replace("\n", " ").split(" ")

    def _learn(self, words: list[str]) -> None:
        """Remember words and their parts."""
        # beyond Latin-1 a letter can turn into a letter and a mark that belongs to the punctuation after it
        plain = [w for w in words if w.isascii() or max(w) < "\u0100"]
        # words hold no line end, which bounds them here as the blanks or line ends do in their text
        cut = _MARKS.sub(r" \1 ", "\n".join(plain)).split("\n") if plain else []
        parts = {w: c.split(" ") for w, c in zip(plain, cut, strict=True) if len(c) > len(w)}
        new = [w for w in set(words).difference(parts).union(*parts.values()) if w not in self.known]
        # words of letters alone are one pre-token each, so many can share a text
        letters = [w for w in new if w.isalpha() and max(w) < "\u0100"]
        for i in range(0, len(letters), 256):
            some = letters[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts, data = (np.flatnonzero(self.last[ids]) + 1).tolist(), ids.tobytes()
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, [0, *cuts], cuts, strict=False))
        new = [w for w in new if w not in self.known]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            made = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((w, np.array(m.ids, "<u4").tobytes()) for w, m in zip(some, made, strict=True))
        get = self.known.__getitem__
        self.known.update([(w, b"".join(map(get, p))) for w, p in parts.items()])
        self.marked += parts

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, end id included; a group of texts of about a million characters at a time."""
        start = 0
        while start < len(texts):
            size, stop = 0, start
            while stop < len(texts) and (size < 1_000_000 or stop == start):
                size += len(texts[stop] or "")
                stop += 1
            split = [self.words(t) for t in texts[start:stop]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
                self.marked.clear()
            if len(self.marked) > MARKED:  # their parts stay
                for word in self.marked:
                    del self.known[word]
                self.marked.clear()
            self._learn([w for w in set().union(*split) if w not in self.known])
            get = self.known.__getitem__
            for words in split:
                yield b"".join(map(get, words)) + self.end
            start = stop


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}  # one for each Python worker

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int, tokenizer: str, end_id: int) -> DataFrame:
    """The token pieces of every document: all of ``length`` tokens but the last of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((tokenizer, end_id), None) or WordEncoder(tokenizer, end_id)
        _ENCODERS[tokenizer, end_id] = encoder
        for batch in batches:
            at, rows = [], []
            texts = [x.as_py() for x in batch.column(1)]
            for i, ids in enumerate(encoder.encode(texts)):
                for k, byte in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[byte : byte + 4 * length]
                    at.append(i)
                    rows.append((k, byte // 4, len(part) // 4, zlib.crc32(part)))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0].astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in cols[1:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the indexes of ``sizes`` in each bin. A bin is found by its free space in one look-up."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    with_free: dict[int, list[int]] = {}
    frees: list[int] = []  # sorted free spaces of which there is a bin
    for i in order:
        size = sizes[i]
        at = bisect.bisect_left(frees, size)
        if at == len(frees):
            bins.append([])
            number, free = len(bins) - 1, capacity
        else:
            free = frees[at]
            number = with_free[free].pop()
            if not with_free[free]:
                frees.pop(at)
        bins[number].append(i)
        free -= size
        if free:
            if free not in with_free or not with_free[free]:
                bisect.insort(frees, free)
            with_free.setdefault(free, []).append(number)
    return bins


BIN = "grp long, done boolean, bin long, fill long, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def _packed(capacity: int, slack: int, turn: int, last: bool):
    """One best-fit round in one group: its bins become items, nearly full ones are done."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(([dict(x) for x in items] for items in frame["items"]), key=lambda r: [tuple(str(v) for v in x.values()) for x in r])
        sizes = [sum(int(x["length"]) for x in r) for r in rows]
        out = []
        for made in best_fit(sizes, capacity):
            fill = sum(sizes[i] for i in made)
            out.append([fill, [x for i in made for x in rows[i]]])
        out.sort(key=lambda x: x[0])  # stable: the order stays that of the bins
        open_bins = sum(x[0] < capacity - slack for x in out)
        group = int(key[0])
        return pd.DataFrame({
            "grp": group // FAN_IN, "done": [last or i >= min(open_bins, CARRIED) for i in range(len(out))],
            "bin": [(turn << 56) + (group << 24) + i for i in range(len(out))], "fill": [x[0] for x in out], "items": [x[1] for x in out],
        })

    return run


def pack(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 0, slack: int = 8) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of every document in one sequence.

    Documents are tokenised (null and empty text: the end id alone), cut into pieces of ``length`` and packed into
    bins of ``length``. Groups of about LOCAL_PIECES pieces are packed by best fit decreasing; bins with at most
    ``slack`` free are emitted, the CARRIED emptiest others become items of the next round, in which FAN_IN groups
    meet; all other bins are emitted as they are. Of bins at most half full best fit leaves one a group at most, so
    what a group hands on is bounded and no task ever sees more than FAN_IN * CARRIED items above the leaves.
    Order within a group is fixed by the rows alone, so a lost task is redone alike. Repeated rows and doc_ids are
    packed as documents of their own; a null doc_id is carried along; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, length, tokenizer, end_id), "pieces")
    groups = max(1, -(-cut.count() // LOCAL_PIECES))
    whole = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("items")
    number = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("grp")
    bins, done, turn = cut.select(number, whole), None, 0
    while True:
        packed = bins.groupBy("grp").applyInPandas(_packed(length, slack, turn, groups == 1), BIN)
        packed = scratch.keep(packed, f"bins-{turn}")
        full = packed.where("done").select("bin", "items")
        done = full if done is None else done.unionByName(full)
        if groups == 1:
            break
        bins, groups, turn = packed.where("not done").select("grp", "items"), -(-groups // FAN_IN), turn + 1
    placed = done.select("bin", F.col("items").alias("own"), F.posexplode("items").alias("at", "item"))
    before = F.aggregate(F.slice("own", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return placed.select("item.*", F.col("bin").alias("sequence_id"), before.alias("offset"))
