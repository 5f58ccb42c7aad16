"""Packing examples under several limits at once: tokens, segments and loss-bearing tokens of a sequence."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import Scratch, bound_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokens of the examples that are placed together, and examples at most.
WINDOW_TOKENS, WINDOW_EXAMPLES = 1_000_000, 1_500
#: Encodings that a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: A blank or line end after anything but a word character or ASCII punctuation: white space may run on there.
_UNSURE = re.compile(r"[^\w!-/:-@\[-`{-~][ \n]")
_SURE = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?: (?!\n)|(?=\n))")
#: The same for ASCII texts: two of white space.
_ASCII_UNSURE = tuple(a + b for a in " \n\t\r\v\f" for b in " \n")


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary for the faster merging by rank, if the file is byte-level BPE whose ids follow its merges."""
    with open(path, encoding="utf-8") as text:
        made = json.load(text)
    model, cutter = made["model"], made.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or made.get("normalizer") or model.get("dropout") or model.get("byte_fallback"):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    single = [t for t in model["vocab"] if len(t) == 1]
    if len(single) != 256 or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on, in their order
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    names = [*single, *(a + b for a, b in merges)]
    ranks = {bytes(byte[c] for c in name): model["vocab"][name] for name in names}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _plain(piece: str) -> bool:
    """Printable and of the first 384 code points, of which all libraries know the same letters."""
    return piece != "" and piece.isprintable() and max(piece) < "\u0180"


class BlankEncoder:
    """Token ids as little-endian uint32 bytes. The pre-tokeniser always cuts before a blank or line end that follows
    a letter, digit or punctuation, and looks only ahead, so what lies between two such places is encoded on its own
    and remembered: a piece that starts with a line end as it stands, any other with the blank before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.merges = ranked(path)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str]) -> None:
        if self.merges:
            end = self.merges.encode_ordinary("\n")
            for mark, own in (("", [p for p in pieces if p[:1] == "\n" and _plain(p[1:])]), (" ", [p for p in pieces if _plain(p)])):
                before = b"" if mark else np.array(end, "<u4").tobytes()
                for i in range(0, len(own), 8192):
                    some = own[i : i + 8192]
                    # a line end is a pre-token of its own here, so many pieces can share a text
                    joined = "\n".join(mark + p if mark else p[1:] for p in some)
                    ids = self.merges.encode_to_numpy(joined, disallowed_special=()).astype("<u4")
                    cuts, data = np.flatnonzero(ids == end[0]).tolist(), ids.tobytes()
                    self.known.update((p, before + data[4 * a : 4 * b]) for p, a, b in zip(some, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True))
        rest = [p for p in pieces if p not in self.known]
        made = self.tokenizer.encode_batch_fast([p if p[:1] == "\n" else " " + p for p in rest], add_special_tokens=False)
        self.known.update((p, np.array(m.ids, "<u4").tobytes()) for p, m in zip(rest, made, strict=True))

    @staticmethod
    def split(text: str) -> list[str]:
        unsure = any(c in text for c in _ASCII_UNSURE) if text.isascii() else _UNSURE.search(text)
        return _SURE.split(text) if unsure else text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else [""] for t in texts]
        first = self.tokenizer.encode_batch_fast([words[0] for words in split], add_special_tokens=False)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [list(map(self.known.get, words[1:])) for words in split]
        lacking = [i for i, parts in enumerate(found) if None in parts]
        self._learn(list({w for i in lacking for w, part in zip(split[i][1:], found[i], strict=True) if part is None}))
        for i in lacking:
            found[i] = map(self.known.__getitem__, split[i][1:])
        return [np.array(m.ids, "<u4").tobytes() + b"".join(parts) for m, parts in zip(first, found, strict=True)]


_ENCODERS: dict[str, BlankEncoder] = {}  # one for each Python worker


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit must be at least 1")


@dataclass
class Piece:
    """Tokens ``start`` to ``stop`` of an example; those from ``answer`` on bear loss."""

    owner: int
    start: int
    stop: int
    answer: int

    @property
    def tokens(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return max(0, self.stop - max(self.start, self.answer))

    def head(self, tokens: int, loss: int) -> int:
        """How many first tokens stay within ``tokens`` and ``loss``."""
        free = max(0, self.answer - self.start)
        return min(self.tokens, tokens, free + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        at = self.start + n
        return Piece(self.owner, self.start, at, self.answer), Piece(self.owner, at, self.stop, self.answer)


def no_padding(tokens: int, limits: Limits) -> bool:
    """Whether a sequence of so many tokens needs none: it is full or a power of two."""
    return tokens == limits.tokens or tokens & (tokens - 1) == 0


@dataclass
class Placer:
    """Vector bin packing of a stream of pieces into sequences.

    Examples that fit a sequence stay whole where they can. A sequence starts with the largest one and takes, again
    and again, the one with the largest dot product of its demands (tokens, loss, one segment, as shares of the
    limits) with the room left. When nothing fits any more, the room is topped up with the head of an example that
    must be cut anyway (it is over the limits, or was cut before), else, unless ``keep_whole``, of the largest left.
    """

    limits: Limits
    keep_whole: bool = False
    whole: list[Piece] = field(default_factory=list)
    over: list[Piece] = field(default_factory=list)
    need: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))

    def add(self, pieces: list[Piece]) -> None:
        top, fresh = self.limits, []
        for p in pieces:
            # what is left of a cut example is first to be cut again, however short
            own = self.over if p.start or p.tokens > top.tokens or p.loss > top.loss else fresh
            own.append(p)
        self.whole += fresh
        demands = np.array([(p.tokens, p.loss, 1) for p in fresh], float).reshape(-1, 3)
        self.need = np.concatenate([self.need, demands / [top.tokens, top.loss, top.segments]])

    def _take(self, at: int) -> Piece:
        """Piece ``at``; the last one moves to its place."""
        piece, end = self.whole[at], self.whole.pop()
        if at < len(self.whole):
            self.whole[at], self.need[at] = end, self.need[-1]
        self.need = self.need[:-1]
        return piece

    def _head(self, tokens: int, loss: int) -> Piece | None:
        """As much of one example as the room takes."""
        for own in (self.over, [] if self.keep_whole else self.whole):
            if own is self.over:
                at = next((i for i in range(len(own) - 1, -1, -1) if own[i].head(tokens, loss)), None)
            else:
                at = max(range(len(own)), key=lambda i: own[i].head(tokens, loss), default=None)
            n = own[at].head(tokens, loss) if at is not None else 0
            if n:
                head, rest = (self.over.pop(at) if own is self.over else self._take(at)).cut(n)
                if rest.tokens:
                    self.add([rest])
                return head
        return None

    def sequences(self, last: bool) -> Iterator[list[Piece]]:
        """Sequences of the pieces so far; without ``last``, pieces that don't fill a sequence wait for more."""
        top = self.limits
        while self.whole or self.over:
            chosen, room = [], np.ones(3)
            while self.whole and len(chosen) < max(1, top.segments - 1):
                worth = self.need @ room if chosen else self.need.max(axis=1)
                fits = (self.need <= room + 1e-9).all(axis=1)
                if not fits.any():
                    break
                at = int(np.argmax(np.where(fits, worth, -1)))
                room = np.maximum(room - self.need[at], 0)
                chosen.append(self._take(at))
            while True:
                tokens, loss = sum(p.tokens for p in chosen), sum(p.loss for p in chosen)
                full = len(chosen) == top.segments or (tokens and no_padding(tokens, top))
                head = None if full else self._head(top.tokens - tokens, top.loss - loss)
                if head is None:
                    break
                chosen.append(head)
            if full or self.whole or self.over:
                yield chosen  # full, or what is left can't add to it
            elif last:
                yield from [chosen] if self.keep_whole else self._even(chosen)
            else:
                self.add(chosen)
                return

    def _even(self, chosen: list[Piece]) -> Iterator[list[Piece]]:
        """The last sequence of all, cut into ones of powers of two."""
        while chosen:
            tokens, part = sum(p.tokens for p in chosen), []
            room = tokens if no_padding(tokens, self.limits) else 1 << (tokens.bit_length() - 1)
            while room:
                head, rest = chosen[0].cut(min(room, chosen[0].tokens))
                part.append(head)
                room -= head.tokens
                chosen = [rest, *chosen[1:]] if rest.tokens else chosen[1:]
            yield part


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in OUT.split(", ")]


@dataclass
class _Task:
    """One task's examples: the ids of those not yet placed, and its sequences numbered from ``first``."""

    placer: Placer
    first: int
    ids: dict[int, tuple[int | None, bytes]] = field(default_factory=dict)
    fresh: list[Piece] = field(default_factory=list)
    read: int = 0
    made: int = 0

    def add(self, doc: int | None, prompt: bytes, text: bytes) -> int:
        own = prompt + text
        self.ids[self.read] = doc, own
        self.fresh.append(Piece(self.read, 0, len(own) // 4, len(prompt) // 4))
        self.read += 1
        return len(own) // 4

    def place(self, last: bool) -> Iterator[pa.RecordBatch]:
        self.placer.add(self.fresh)
        self.fresh, rows = [], []
        for pieces in self.placer.sequences(last):
            at = 0
            for p in pieces:
                doc, own = self.ids[p.owner]
                crc = zlib.crc32(own[4 * p.start : 4 * p.stop])
                rows.append((doc, p.start, p.tokens, crc, len(own) // 4, p.loss, self.first + self.made, at))
                at += p.tokens
            self.made += 1
        open_ids = {p.owner for p in (*self.placer.whole, *self.placer.over)}
        self.ids = {k: v for k, v in self.ids.items() if k in open_ids}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)


def pack(examples: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, end_id: int = 0, keep_whole: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset: every token in one sequence.

    ``examples`` has doc_id, text and, for instruction data, prompt: the example is the prompt's ids, the text's ids
    and ``end_id``; tokens of the prompt bear no loss, all others do (without that column, all of them). No sequence
    has more tokens, pieces or loss-bearing tokens than ``limits``. With ``keep_whole`` an example within the limits
    is never cut; otherwise the room that is left in a sequence is filled with the head of an example, so padding
    is left only where the limits on pieces or loss are reached first, and a task's last sequence is cut into powers
    of two.

    Each task packs its own rows as they come, a window of bounded size at a time, so nothing is shuffled and no key
    can be hot; what a window leaves goes on to the next. Which examples meet therefore follows the partitions of the
    input, and the result is written before it is returned. Null and empty texts and prompts have no ids (the example
    is the end id); texts of any length are cut; repeated rows and ids are examples of their own; a null doc_id is
    carried along; ties go to the first; an empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(examples.sparkSession, "vector-packing")
    bound_batches(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, BlankEncoder(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        task, tokens = _Task(Placer(limits, keep_whole), TaskContext.get().partitionId() << 32), 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at in range(0, len(docs), 256):  # a few at a time: ids take more room than texts
                texts, prompts = (encoder.encode(batch.column(k).slice(at, 256).to_pylist()) for k in (1, 2))
                for doc, text, prompt in zip(docs[at : at + 256], texts, prompts):
                    tokens += task.add(doc, prompt, text + end)
                    if tokens >= WINDOW_TOKENS or len(task.fresh) >= WINDOW_EXAMPLES:
                        yield from task.place(False)
                        tokens = 0
        yield from task.place(True)

    prompt = F.col("prompt") if "prompt" in examples.columns else F.lit(None)
    own = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.cast("string").alias("prompt"))
    return scratch.keep(own.mapInArrow(run, OUT), "pieces")
