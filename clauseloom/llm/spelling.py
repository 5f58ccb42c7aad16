"""Spelling variants: words one edit apart, found in tries over letter-group counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import ASCII_LOWER, Scratch, bound_batches

#: Letters of a word, as bytes of Latin-1: A to Z in both cases and U+00C0 to U+00FF.
LETTERS = frozenset([*range(65, 91), *range(97, 123), *range(192, 256)])
_SPACED = bytes(ASCII_LOWER[c] if c in LETTERS else 32 for c in range(256))
#: Distinct words counted before a task hands its counts on.
COUNTED = 500_000
#: Levels of the trie: the count of each group of letters, frequent letters first; the last group is all other letters.
GROUPS = (*"eatniorshdlucgmwfybpvk", "jqxz", "")
_GROUP = np.full(256, len(GROUPS) - 1, np.uint8)
for _number, _letters in enumerate(GROUPS[:-1]):
    _GROUP[list(_letters.encode())] = _number
#: A level counts up to this; longer words meet at the top and are told apart by verification.
MOST = 250
#: Words of a trie that one task builds, words that look through it in one task, words of a leaf, and nodes of the
#: upper trie at most (beyond, its tries get larger in proportion).
TRIE, LOOKING, LEAF, UPPER = 20_000, 100_000, 24, 1 << 17
#: Pairs compared at a time, and letters of a word up to which many are compared at once.
AT_ONCE, WIDE = 1 << 19, 32


def words(docs: DataFrame, least: int = 5, often: int = 3, slips: int | None = None) -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur ``often`` times or more in all texts together.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With ``slips``, misspellings are
    planted: where the crc32 of "<doc_id>:<word>" is h and ``slips`` divides it, the letter number h modulo the length
    is left out. Counts are made in each task before the shuffle, over whole texts. Null texts have no words; a
    null doc_id counts as an empty one; repeated rows count again; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "words")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out():
            kept = [(w, n) for w, n in total.items() if len(w) >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                runs = text.as_py().encode("latin-1", "replace").translate(_SPACED).split()
                if slips is None:
                    total.update(runs)
                else:
                    start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                    for word, n in Counter(runs).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return scratch.keep(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often), "counts")


def vectors(some: list[bytes]) -> np.ndarray:
    """The letter-group counts of words, a row each."""
    if not some:
        return np.empty((0, len(GROUPS)), np.uint8)
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    group = _GROUP[np.frombuffer(b"".join(some), np.uint8)]
    at = np.repeat(np.arange(len(some)), sizes) * len(GROUPS) + group
    counts = np.bincount(at, minlength=len(some) * len(GROUPS)).reshape(len(some), len(GROUPS))
    return np.minimum(counts, MOST).astype(np.uint8)


@dataclass
class Spelled:
    """Words as rows of bytes, from the left and from the right; those over WIDE letters are kept as they are."""

    words: list[bytes]
    sizes: np.ndarray = field(default=None)
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)

    def __post_init__(self):
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        shown = [w if len(w) <= WIDE else b"" for w in self.words]
        self.left, self.right = (
            np.frombuffer(b"".join(pad(w) for w in shown), np.uint8).reshape(-1, WIDE) for pad in (lambda w: w.ljust(WIDE, b"\0"), lambda w: w.rjust(WIDE, b"\0"))
        )


def one_edit(a: Spelled, b: Spelled, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words ``x`` of ``a`` and ``y`` of ``b`` differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(x), bool)
    sizes, others = a.sizes[x], b.sizes[y]
    narrow = np.maximum(sizes, others) <= WIDE
    same = np.flatnonzero(narrow & (sizes == others))
    out[same] = np.count_nonzero(a.left[x[same]] != b.left[y[same]], axis=1) == 1
    apart = np.flatnonzero(narrow & (np.abs(sizes - others) == 1))
    before = np.argmax(a.left[x[apart]] != b.left[y[apart]], axis=1)  # there is a difference, since lengths differ
    after = np.argmax((a.right[x[apart]] != b.right[y[apart]])[:, ::-1], axis=1)
    out[apart] = before + after >= np.minimum(sizes, others)[apart]
    for i in np.flatnonzero(~narrow & (np.abs(sizes - others) <= 1)):
        out[i] = _one_edit(a.words[x[i]], b.words[y[i]])
    return out


def _one_edit(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    differ = np.frombuffer(a, np.uint8) != np.frombuffer(b[: len(a)], np.uint8)
    if len(a) == len(b):
        return int(differ.sum()) == 1
    at = int(np.argmax(differ)) if differ.any() else len(a)
    return a[at:] == b[at + 1 :]


@dataclass
class Trie:
    """Words sorted by their letter-group counts: the words below a node are a range, its children the runs of one
    count at the next level. A range of at most LEAF words is a leaf."""

    words: list[bytes]
    counts: np.ndarray
    order: np.ndarray = field(default=None)

    def __post_init__(self):
        self.order = np.lexsort(self.counts.T[::-1]) if len(self.words) else np.empty(0, np.int64)
        self.counts = self.counts[self.order]

    def near(self, looking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``looking``, word) for counts that differ by a surplus and a deficit of at most one each: a descent,
        depth first, with all rows at once that still have budget at a node."""
        every = np.arange(len(looking))
        stack = [(0, len(self.words), 0, every, np.zeros(len(looking), np.int8), np.zeros(len(looking), np.int8))]
        while stack:
            start, stop, level, some, surplus, deficit = stack.pop()
            if start == stop or not len(some):
                continue
            if level == len(GROUPS) or stop - start <= LEAF:
                step = max(1, AT_ONCE // (stop - start))
                for i in range(0, len(some), step):
                    own = some[i : i + step]
                    gap = looking[own, None, level:].astype(np.int16) - self.counts[None, start:stop, level:]
                    fits = surplus[i : i + step, None] + np.maximum(gap, 0).sum(axis=2) <= 1
                    fits &= deficit[i : i + step, None] + np.maximum(-gap, 0).sum(axis=2) <= 1
                    x, y = np.nonzero(fits)
                    yield own[x], self.order[start + y]
                continue
            column = self.counts[start:stop, level]
            cuts = start + np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], stop], strict=True):
                gap = looking[some, level].astype(np.int16) - int(self.counts[a, level])
                more, less = surplus + np.maximum(gap, 0), deficit + np.maximum(-gap, 0)
                keep = (more <= 1) & (less <= 1)
                if keep.any():
                    stack.append((a, b, level + 1, some[keep], more[keep].astype(np.int8), less[keep].astype(np.int8)))


def reachable(counts: bytes, inner: frozenset[bytes], there: frozenset[bytes]) -> list[bytes]:
    """The lower tries (by prefix of counts) in which words near ``counts`` can be: a descent of the upper trie whose
    nodes are ``inner``, with the same budget."""
    found, stack = [], [(b"", 0, 0)]
    while stack:
        prefix, surplus, deficit = stack.pop()
        if prefix not in inner:
            if prefix in there:
                found.append(prefix)
            continue
        own = counts[len(prefix)]
        stack.append((prefix + bytes([own]), surplus, deficit))
        if surplus == 0 and own > 0:
            stack.append((prefix + bytes([own - 1]), 1, deficit))
        if deficit == 0 and own < MOST:
            stack.append((prefix + bytes([own + 1]), surplus, 1))
    return found


def _home(counts: bytes, inner: frozenset[bytes]) -> bytes:
    at = 0
    while counts[:at] in inner:
        at += 1
    return counts[:at]


def _compared(key: tuple, home: pd.DataFrame, looking: pd.DataFrame) -> pd.DataFrame:
    """For the words near each other of a lower trie and of those that look through it: partial counts and best form."""
    own = [w.encode("latin-1") for w in home["word"]]
    mine = [w.encode("latin-1") for w in looking["word"]]
    n, m = home["n"].to_numpy(np.int64), looking["n"].to_numpy(np.int64)
    inside = looking["inside"].to_numpy(bool) if len(looking) else np.empty(0, bool)
    trie, rows, parts = Trie(own, vectors(own)), vectors(mine), []
    spelled, theirs = Spelled(own), Spelled(mine)

    def verified(x: np.ndarray, y: np.ndarray) -> None:
        ok = one_edit(theirs, spelled, x, y)
        x, y = x[ok], y[ok]
        # words of the trie itself look for the others of it, so each of such a pair finds the other
        both = ~inside[x]
        parts.append(pd.DataFrame({"word": looking["word"].to_numpy()[x], "near": home["word"].to_numpy()[y], "m": n[y]}))
        parts.append(pd.DataFrame({"word": home["word"].to_numpy()[y[both]], "near": looking["word"].to_numpy()[x[both]], "m": m[x[both]]}))

    xs, ys, size = [], [], 0
    for x, y in trie.near(rows):
        xs.append(x)
        ys.append(y)
        size += len(x)
        if size > AT_ONCE:
            verified(np.concatenate(xs), np.concatenate(ys))
            xs, ys, size = [], [], 0
    if size:
        verified(np.concatenate(xs), np.concatenate(ys))
    found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"word": [], "near": [], "m": []})
    if not len(found):
        return pd.DataFrame({"word": pd.Series([], dtype=object), "n_near": pd.Series([], dtype="int64"), "m": pd.Series([], dtype="int64"), "near": pd.Series([], dtype=object)})
    found = found.sort_values(["word", "m", "near"], ascending=[True, False, True])
    grouped = found.groupby("word", sort=False)
    best = grouped.head(1).set_index("word")
    return pd.DataFrame({"n_near": grouped.size()}).join(best).reset_index()[["word", "n_near", "m", "near"]]


def variants(counts: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for ``counts`` (word, n), whose words are of letters up to U+00FF.

    Two words are near if one inserted, deleted or replaced letter makes one the other. A word's form is its near
    word of largest n, ties to the smallest in code-point order, if that n is at least twice the word's; root
    follows forms to the last (n doubles with each, so there is no circle), and is the word itself if it has none.

    Words are arranged in a trie by their counts of successive letter groups. Its upper part is made of the
    prefixes that more than TRIE words share; each lower trie is built in a task of its own. A word descends the
    upper part with a budget of one surplus and one deficit, which names the lower tries that can hold near words,
    and is sent there; pairs of different tries meet in one of the two only. Tries of equal counts and tries many look
    through are spread over tasks. Leaf words are verified; each task returns counts and best forms, never
    pairs. A null word or n takes no part; words given twice count together; words that aren't Latin-1 are refused
    by the encoder; words of any length are compared; an empty table gives an empty result.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "variants")
    own = counts.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    table = scratch.keep(own.mapInArrow(_with_counts, "word string, n long, counts binary"), "words")
    total = table.count()
    size = max(TRIE, total * len(GROUPS) // UPPER)
    levels = table.select(F.explode(F.expr(f"transform(sequence(0, {len(GROUPS) - 1}), k -> substring(counts, 1, k))")).alias("prefix"))
    # at most len(GROUPS) * total / size prefixes are shared by so many; words of equal counts can't be divided further
    inner = frozenset(bytes(r["prefix"]) for r in levels.groupBy("prefix").count().where(F.col("count") > size).collect())
    sent = spark.sparkContext.broadcast(inner)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = [_home(c, sent.value) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.binary())], ["word", "n", "counts", "home"])

    placed = scratch.keep(table.mapInArrow(homes, "word string, n long, counts binary, home binary"), "placed")
    # children of inner nodes: a bounded number each
    held = {bytes(r["home"]): r["count"] for r in placed.groupBy("home").count().collect()}
    split = {h: -(-n // (2 * size)) for h, n in held.items() if n > 2 * size}
    there = spark.sparkContext.broadcast((inner, frozenset(held), split))

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, tries, parts = there.value
        for batch in batches:
            at, trie, part, inside = [], [], [], []
            for row, (counts, home) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for target in reachable(counts, upper, tries):
                    if target >= home:
                        for k in range(parts.get(target, 1)):
                            at.append(row)
                            trie.append(target)
                            part.append(k)
                            inside.append(target == home)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(trie, pa.binary()), pa.array(part, pa.int32()), pa.array(inside, pa.bool_())],
                ["word", "n", "trie", "part", "inside"])

    looking = scratch.keep(placed.mapInArrow(looks, "word string, n long, trie binary, part int, inside boolean"), "looking")
    many = {(bytes(r["trie"]), r["part"]): -(-r["count"] // LOOKING) for r in looking.groupBy("trie", "part").count().where(F.col("count") > LOOKING).collect()}
    names = spark.createDataFrame([(h, k, many.get((h, k), 1)) for h in held for k in range(split.get(h, 1))], "trie binary, part int, turns int")
    looking = looking.join(names, ["trie", "part"]).withColumn("turn", F.pmod(F.xxhash64("word"), F.col("turns")).cast("int")).drop("turns")
    parted = spark.createDataFrame([(h, split.get(h, 1)) for h in held], "home binary, parts int")
    home = placed.join(parted, "home").select(F.col("home").alias("trie"), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "word", "n")
    home = home.join(names, ["trie", "part"]).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).drop("turns")
    found = home.groupBy("trie", "part", "turn").cogroup(looking.groupBy("trie", "part", "turn")).applyInPandas(_compared, "word string, n_near long, m long, near string")
    best = F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best")
    near = scratch.keep(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "near")
    is_form = -F.col("best.less") >= 2 * F.col("n")
    result = table.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"))
    result = scratch.keep(result, "forms")
    return result.join(_roots(scratch, result), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: every round, each takes the root of its root so far."""
    roots, turn = scratch.keep(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        moved = scratch.keep(moved, f"roots-{turn}")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in made], pa.binary())], ["word", "n", "counts"])
