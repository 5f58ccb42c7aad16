"""Toxicity by nearest labelled examples: exact TF-IDF cosine over inverted lists, whose dense parts are matrix products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import near_dedup
from clauseloom.llm.shared import Scratch, bound_batches, ship

#: Labelled examples of each class, as expected numbers, drawn by a hash of the doc_id.
EXAMPLES = {1: 4000, 0: 8000}
#: Part of its TF-IDF weight that a term without association with toxic examples keeps; one that is beyond chance for
#: the number of terms tried (log-likelihood ratio) and always toxic has this and 1.
FAINT = 0.05
#: Neighbours that vote, and examples in a block of an inverted list.
NEIGHBOURS, BLOCK = 25, 64
#: Postings that the driver takes at once while it puts the index together, but for a term with more.
SLICE = 2_000_000
#: Groups of alike examples, the terms that are told by them, and the part of a group that holds a term whose list there is a row of a matrix.
GROUPS, TELLING, DENSE = 4, 1000, 0.05
#: Texts compared at once, postings that are summed at once, and words that are remembered.
TEXTS, SUMMED, WORDS = 64, 250_000, 200_000


class _Letters(dict):
    """str.translate table: letters stay, all else becomes a space."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = kept = code if c.isalnum() and not c.isdecimal() else 32
        return kept


_LETTERS = _Letters()


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, in order."""
    return (text or "").lower().translate(_LETTERS).split()



def terms_of(text: str | None) -> dict[str, int]:
    """Counts of the words of a whole text, lower-cased runs of letters, and of their beginnings of four to six letters."""
    out: dict[str, int] = {}
    for word, n in Counter(words_of(text)).items():
        for term in {word, word[:4], word[:5], word[:6]}:
            out[term] = out.get(term, 0) + n
    return out


COPY_KEYS = ("k0", "k1", "k2")


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds three pairs of hash minima over the shingles, of which near copies share one almost surely; texts without
    words have keys of their own."""
    for batch in batches:
        keys = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            names = near_dedup.shingles(text.as_py())
            keys.append(near_dedup.minima(names)[:6].view(np.int64) if len(names) else np.full(3, doc))
        columns = np.array(keys, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in columns]], ["doc_id", "toxic", "text", *COPY_KEYS])


class _Known(dict):
    """The row of a word in a table of the known terms it stands for; row 0 is that of words that stand for none."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number, self.rows, self.table = number, 1, np.full((1024, 4), -1, np.int32)

    def __missing__(self, word: str) -> int:
        held = [self.number[t] for t in {word, word[:4], word[:5], word[:6]} if t in self.number]
        row = 0
        if held:
            if self.rows == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            row = self.rows
            self.table[row, : len(held)] = held
            self.rows += 1
        self[word] = row
        return row


class Terms:
    """Finds the known terms of whole texts; what a word stands for is remembered, up to ``WORDS`` of them.

    The terms travel as one Arrow array; a dictionary of them is made where texts are read."""

    def __init__(self, terms: pa.Array):
        self.terms, self.number, self.known = terms, None, None

    def __reduce__(self):
        return Terms, (self.terms,)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text in their order, and how often each occurs."""
        if self.number is None:
            self.number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        if self.known is None or len(self.known) > WORDS:
            self.known = _Known(self.number)
        rows = np.array(list(map(self.known.__getitem__, words_of(text))), np.int64)
        held = self.known.table[rows].ravel()
        return np.unique(held[held >= 0], return_counts=True)


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.column(1)):
            own = terms_of(text.as_py())
            found.extend(own)
            at.extend([i] * len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["toxic", "term"])


def _damped(tf: np.ndarray) -> np.ndarray:
    return 1 + np.log(tf.astype(float))


def _least_type(most: int) -> np.dtype:
    return np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32)


def vector(text: str | None, terms: Terms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, weight) of a whole text over the known terms, of unit length; nothing if none occurs."""
    at, tf = terms.counts(text)
    x = _damped(tf) * idf[at]
    return at, x / np.sqrt(x @ x) if len(at) else x


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the ranges' lengths."""
    n = stops - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class BlockMaxIndex:
    """Inverted lists over examples in blocks; a block's largest weight bounds what it can add to a score.

    All lists lie in one array, term by term; an entry is the run of one term's postings in one block.
    """

    n_terms: int
    rows: list[tuple[np.ndarray, np.ndarray]]
    block: int = BLOCK

    def __post_init__(self):
        self.n_rows = len(self.rows)
        terms = np.concatenate([np.empty(0, np.int64), *[a for a, _ in self.rows]])
        order = np.argsort(terms, kind="stable")
        self.counts = np.bincount(terms, minlength=self.n_terms).astype(np.int32)
        self.ids = np.repeat(np.arange(self.n_rows, dtype=np.int32), [len(a) for a, _ in self.rows])[order]
        self.weights = np.concatenate([np.empty(0), *[x for _, x in self.rows]])[order]
        self.starts = None

    @classmethod
    def of_postings(cls, counts: np.ndarray, ids: np.ndarray, tf: np.ndarray, idf: np.ndarray, norms: np.ndarray) -> BlockMaxIndex:
        """The index of postings in order of term and example; ``counts`` has the length of each term's list. Weights
        are worked out where they are first used: until then a posting is the number of its example and a count."""
        index = cls.__new__(cls)
        index.__setstate__((len(counts), BLOCK, len(norms), counts, ids, (tf, idf, norms)))
        return index

    def __getstate__(self):
        """Postings alone, without what they give again."""
        return self.n_terms, self.block, self.n_rows, self.counts, self.ids, self.weights

    def __setstate__(self, state):
        self.n_terms, self.block, self.n_rows, self.counts, self.ids, self.weights = state
        self.rows, self.starts = [], None

    def _index(self):
        """Entries and their bounds, made where they are first used."""
        terms = np.repeat(np.arange(self.n_terms, dtype=np.int32), self.counts)
        if isinstance(self.weights, tuple):
            tf, idf, norms = self.weights
            self.weights = _damped(tf) * idf[terms] / norms[self.ids]
        blocks = self.ids // self.block
        starts = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])][: len(terms)])
        self.starts, self.blocks = np.r_[starts, len(terms)], blocks[starts]
        self.best = np.maximum.reduceat(self.weights, starts) if len(starts) else self.weights
        self.firsts = np.searchsorted(terms[starts], np.arange(self.n_terms + 1))

    def weights_at(self, at: np.ndarray, terms: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The weights of the postings ``at``, worked out a slice at a time; ``terms`` has the term of every posting."""
        for first in range(0, len(at), SLICE // 4):
            part = at[first : first + SLICE // 4]
            if isinstance(self.weights, tuple):
                tf, idf, norms = self.weights
                out[first : first + len(part)] = _damped(tf[part]) * idf[terms[part]] / norms[self.ids[part]]
            else:
                out[first : first + len(part)] = self.weights[part]
        return out

    def _sums(self, entries: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of the examples in the entries of open blocks; the postings of all others are passed over."""
        at, n = _ranges(self.starts[entries], self.starts[entries + 1])
        return np.bincount(self.ids[at], np.repeat(q, n) * self.weights[at], minlength=self.n_rows)

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact k nearest examples by cosine above 0: most similar first, ties to the smaller number.

        The blocks of the largest bounds are scored first, then twice as many each time; the k-th best score so far
        closes all blocks whose bound is less.
        """
        if self.starts is None:
            self._index()
        entries, n = _ranges(self.firsts[at], self.firsts[at + 1])
        q, blocks = np.repeat(x, n), self.blocks[entries]
        bound = np.bincount(blocks, q * self.best[entries], minlength=-(-self.n_rows // self.block))
        ids, scores, least, closed = np.empty(0, np.int64), np.empty(0), 0.0, bound <= 0
        some = max(8, 2 * k // self.block)
        while True:
            left = np.where(closed | (bound < least - 1e-12), -1.0, bound)
            chosen = np.zeros(len(bound), bool)
            chosen[np.argsort(-left, kind="stable")[:some]] = True
            chosen &= left > 0
            if not chosen.any():
                break
            closed |= chosen
            own = chosen[blocks]
            sums = self._sums(entries[own], q[own])
            found = np.flatnonzero(sums)
            found = found[found != skip]
            ids, scores = np.r_[ids, found], np.r_[scores, sums[found]]
            best = np.lexsort((ids, -np.round(scores, 12)))[:k]
            ids, scores = ids[best], scores[best]
            least = scores[-1] if len(ids) == k else 0.0
            some *= 2
        return ids, scores


def grouped(index: BlockMaxIndex) -> np.ndarray:
    """A group of alike examples for each example (texts of one language share most frequent terms), by spherical k-means
    over the most frequent terms. Groups change the work alone, no result."""
    starts = np.r_[0, np.cumsum(index.counts, dtype=np.int64)]
    told = np.argsort(-index.counts, kind="stable")[:TELLING]
    at, n = _ranges(starts[told], starts[told + 1])
    x = np.zeros((index.n_rows, len(told)), np.float32)
    x[index.ids[at], np.repeat(np.arange(len(told)), n)] = 1
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    x = unit(x)
    chosen, near = [0], x @ x[0] if len(x) else np.empty(0)
    for _ in range(min(GROUPS, len(x)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres, group = x[chosen] if len(x) else x, np.zeros(len(x), np.int64)
    for _ in range(10 if len(x) else 0):
        group = (x @ centres.T).argmax(axis=1)
        centres = unit(np.stack([x[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(len(centres))]))
    return group.astype(np.uint8)


class Products:
    """Cosines of many texts with all examples.

    Examples are put in order of their groups. A term that enough examples of a group hold has a row in that group's
    matrix; texts with many of those terms are multiplied with it in single precision. All other postings are summed
    one by one. The sum's error is bounded by the number of a text's terms, so every example that may be among the
    nearest is known, and those alone are compared again in double precision.
    """

    def __init__(self, index: BlockMaxIndex, group: np.ndarray):
        n_terms, self.n = index.n_terms, index.n_rows
        self.order = np.argsort(group, kind="stable")
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        sizes = np.bincount(group, minlength=1)
        self.n_groups, self.edges = len(sizes), np.r_[0, np.cumsum(sizes)]
        # arrays as long as all postings: few of them at a time
        terms = np.repeat(np.arange(n_terms, dtype=np.int32), index.counts)
        # the examples' vectors, for the comparison in double precision; frequent terms come first, so that few cells are met most
        self.rank = np.empty(n_terms, np.int32)
        self.rank[np.argsort(-index.counts, kind="stable")] = np.arange(n_terms)
        by_row = np.argsort(index.ids, kind="stable")
        self.row_weights = index.weights_at(by_row, terms, np.empty(len(terms)))
        self.row_terms = self.rank[terms[by_row]]
        self.row_starts = np.r_[0, np.cumsum(np.bincount(index.ids, minlength=self.n))]
        del by_row
        entry = terms * np.int64(self.n_groups)
        entry += group[index.ids]
        held = np.bincount(entry, minlength=n_terms * self.n_groups)
        by_entry = np.argsort(entry, kind="stable")
        del entry
        self.weights = index.weights_at(by_entry, terms, np.empty(len(terms), np.float32))
        del terms
        self.posted = self.place.astype(np.int32)[index.ids[by_entry]]
        del by_entry
        self.starts = np.r_[0, np.cumsum(held)]
        held = held.reshape(n_terms, self.n_groups)
        self.rows, self.matrices = [], []
        for g, size in enumerate(sizes):
            dense = np.flatnonzero(held[:, g] >= max(8, DENSE * size))
            row = np.full(n_terms, -1, np.int32)
            row[dense] = np.arange(len(dense))
            matrix = np.zeros((len(dense), size), np.float32)
            at, n = _ranges(self.starts[dense * self.n_groups + g], self.starts[dense * self.n_groups + g + 1])
            matrix[np.repeat(np.arange(len(dense)), n), self.posted[at] - self.edges[g]] = self.weights[at]
            self.rows.append(row)
            self.matrices.append(matrix)
        self.query = np.zeros(n_terms)

    def _sums(self, texts: np.ndarray, terms: np.ndarray, x: np.ndarray, n_texts: int) -> np.ndarray:
        """Cosines with all examples in their order, in single precision."""
        out, left = np.zeros((n_texts, self.n)), []
        for g, (row, matrix) in enumerate(zip(self.rows, self.matrices, strict=True)):
            at = row[terms]
            # the matrix is worth it from so many of its terms on
            many = np.bincount(texts[at >= 0], minlength=n_texts) >= max(1, len(matrix) / 25)
            own = (at >= 0) & many[texts]
            some = np.flatnonzero(many)
            if len(some):
                number = np.cumsum(many) - 1
                q = np.zeros((len(some), len(matrix)), np.float32)
                q[number[texts[own]], at[own]] = x[own]
                out[some, self.edges[g] : self.edges[g + 1]] = q @ matrix
            entry = terms[~own] * self.n_groups + g
            left.append((texts[~own], self.starts[entry], self.starts[entry + 1], x[~own]))
        of, starts, stops, x = (np.concatenate(c) for c in zip(*left, strict=True))
        some = np.flatnonzero(stops > starts)
        some = some[np.argsort(of[some], kind="stable")]
        of, starts, stops, x = of[some], starts[some], stops[some], x[some]
        met = np.r_[0, np.cumsum(np.bincount(of, stops - starts, minlength=n_texts))]
        upto = np.searchsorted(of, np.arange(n_texts + 1))
        first = 0
        while first < n_texts:
            last = max(first + 1, int(np.searchsorted(met, met[first] + SUMMED, side="right")) - 1)
            part = slice(upto[first], upto[last])
            at, n = _ranges(starts[part], stops[part])
            cell = np.repeat((of[part] - first) * self.n, n) + self.posted[at]
            out[first:last] += np.bincount(cell, np.repeat(x[part], n) * self.weights[at], minlength=(last - first) * self.n).reshape(-1, self.n)
            first = last
        return out

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The exact k nearest examples of each query by cosine above 0: most similar first, ties to the smaller number;
        ``skip`` names an example that a query does not meet."""
        lengths = np.array([len(at) for at, _ in queries], np.int64)
        texts = np.repeat(np.arange(len(queries)), lengths)
        terms, x = (np.concatenate([q[c] for q in queries]) for c in (0, 1))
        sums = self._sums(texts, terms.astype(np.int64), x, len(queries))
        if skip is not None:
            sums[np.arange(len(queries)), self.place[skip]] = 0
        least = np.partition(sums, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.zeros(len(queries))
        # nothing is below 0, so that each rounding of a weight, a product or a sum is off by 2^-24 of the cosine at most
        least = least * (1 - 2 * (lengths + 8) * 2.0**-23) - 1e-11
        may = (sums >= least[:, None]) & (sums > 0)
        out = []
        for i, (at, q) in enumerate(queries):
            ids = np.sort(self.order[may[i]])
            own = self.rank[at]
            self.query[own] = q
            rows = [slice(*ends) for ends in zip(self.row_starts[ids].tolist(), self.row_starts[ids + 1].tolist(), strict=True)]
            cosine = np.array([self.query[self.row_terms[row]] @ self.row_weights[row] for row in rows])
            self.query[own] = 0
            best = np.lexsort((ids, -np.round(cosine, 12)))[:k]
            out.append((ids[best], cosine[best]))
        return out


@dataclass
class Model:
    finder: Terms
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    slope: float = 0.0
    shift: float = 0.0
    base: float = 0.0
    group: np.ndarray | None = None
    products: Products | None = None

    def __getstate__(self):
        """Without what is made again where texts are scored."""
        return self.__dict__ | {"products": None}

    @property
    def terms(self) -> list[str]:
        return self.finder.terms.to_pylist()

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic votes for each query, weighted by nearness and by how many documents an example stands for."""
        if self.products is None:
            self.products = Products(self.index, np.zeros(self.index.n_rows, np.uint8) if self.group is None else self.group)
        for ids, cosine in self.products.nearest(queries, NEIGHBOURS, skip) if queries else ():
            w = self.weight[ids] / (1.05 - np.minimum(cosine, 1.0))
            # one vote of the base rate keeps few or far neighbours from extreme scores
            yield float((w @ self.toxic[ids] + self.base) / (w.sum() + 1)), ids, cosine

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        vectors = [vector(text, self.finder, self.idf) for text in texts]
        found = self.votes([v for v in vectors if len(v[0])])
        out = []
        for at, _ in vectors:
            share, ids, cosine = next(found) if len(at) else (self.base, np.empty(0, int), np.empty(0))
            out.append((self.calibrated(share), self.ids[ids[:3]].tolist(), cosine[:3].tolist()))
        return out

    def calibrated(self, share: float) -> float:
        x = np.log((share + 1e-3) / (1 - share + 1e-3))
        return float(1 / (1 + np.exp(-(self.slope * x + self.shift))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit on one variable, by Newton steps with a weak penalty."""
    both = np.stack([x, np.ones(len(x))], axis=1)
    b = np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ b, -30, 30)))
        slope = both.T @ (w * (y - p)) - 1e-2 * (b - prior)
        step = np.linalg.solve((both * (w * p * (1 - p))[:, None]).T @ both + 1e-2 * np.eye(2), slope)
        b = b + np.clip(step, -2, 2)
    return float(b[0]), float(b[1])


def _index_of(postings: DataFrame, counts: np.ndarray, most: int, idf: np.ndarray, norms: np.ndarray) -> BlockMaxIndex:
    """The index of postings (at, id, tf), taken term range by term range; no more than a slice of them is held twice.
    ``most`` is the largest tf."""
    ends = np.cumsum(counts, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    ids, tf = np.empty(n, _least_type(len(norms))), np.empty(n, _least_type(most))
    first = place = 0
    while first < len(counts):
        stop = max(first + 1, int(np.searchsorted(ends, place + SLICE, side="right")))
        at, own, times = (c.to_numpy() for c in postings.where(f"at >= {first} and at < {stop}").toArrow().columns)
        order, upto = np.lexsort((own, at)), int(ends[stop - 1])
        ids[place:upto], tf[place:upto] = own[order], times[order]
        first, place = stop, upto
    return BlockMaxIndex.of_postings(counts, ids, tf, idf, norms)


def train(docs: DataFrame, labels: DataFrame, examples: dict[int, int] | None = None) -> Model | None:
    """Index labelled documents. ``labels`` has doc_id and toxic; an id labelled twice counts as toxic if any says so.

    About ``examples[c]`` documents of class c are drawn; of that sample alone the terms and the postings, slice by
    slice, reach the driver. All terms of all drawn examples are indexed, their document counts cover every row of ``docs``. None if no labelled row is found.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    want = examples or EXAMPLES
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, min(1.0, want[1] / max(1, sizes.get(1, 0)))).otherwise(min(1.0, want[0] / max(1, sizes.get(0, 0))))
    drawn = known.where(draw < share)  # bounded by ``examples``
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
    # one of several near copies: words they happen to share are no evidence
    sample = sample.mapInArrow(_copy_keys, "doc_id long, toxic int, text string, k0 long, k1 long, k2 long")
    for key in COPY_KEYS:
        sample = sample.dropDuplicates(["toxic", key])
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(sample.drop(*COPY_KEYS), "examples")
    of_class = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of_class.get(1, 0), of_class.get(0, 0)
    if not n1 + n0:
        return None
    seen = sample.select("toxic", "text").mapInArrow(_example_terms, "toxic int, term string")
    seen = seen.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    seen = scratch.keep(seen, "terms").toArrow().sort_by("term")
    terms, a, n = pa.concat_arrays(seen.column(0).chunks or [pa.array([], pa.string())]), *(seen.column(k).to_numpy().astype(float) for k in (1, 2))
    del seen
    scratch.drop("terms")
    least = 2 * np.log(max(1, len(terms))) + 2  # the ratio of a chance term exceeds x with a chance of about exp(-x / 2)
    rate, ratio = n1 / (n1 + n0), np.zeros(len(terms))
    for got, expected in ((a, n * rate), (n - a, n * (1 - rate)), (n1 - a, (n1 + n0 - n) * rate), (n0 - n + a, (n1 + n0 - n) * (1 - rate))):
        some = (got > 0) & (expected > 0)
        ratio[some] += 2 * got[some] * np.log(got[some] / expected[some])
    telling = np.minimum(ratio / least, 1) * np.maximum(a / n - rate, 0) / max(1 - rate, 1e-9)

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, finder = np.zeros(len(terms), np.int64), 0, Terms(terms)
        for batch in batches:
            for text in batch.column(0):
                total[finder.counts(text.as_py())[0]] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, total[some]])], ["k", "n"])

    total = docs.select("text").mapInArrow(document_counts, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)  # the last one, of number -1, counts all rows
    df[total.column(0).to_numpy()] = total.column(1).to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (FAINT + telling)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Terms(terms)
        for batch in batches:
            at, tf, norms, most = [], [], [], []
            for text in batch.column(2):
                for kept, column in zip((at, tf), finder.counts(text.as_py()), strict=True):
                    kept.append(column.astype(np.int32))
                x = _damped(tf[-1]) * idf[at[-1]]
                norms.append(np.sqrt(x @ x))
                most.append(max(tf[-1], default=0))
            lists = [pa.array(v, pa.list_(pa.int32())) for v in (at, tf)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *lists, pa.array(norms, pa.float64()), pa.array(most, pa.int32())],
                ["doc_id", "toxic", "at", "tf", "norm", "most"])

    held = sample.mapInArrow(vectors, "doc_id long, toxic int, at array<int>, tf array<int>, norm double, most int")
    held = scratch.keep(held.withColumn("row", F.monotonically_increasing_id()), "vectors")
    scratch.drop("examples")
    rows = held.select("doc_id", "toxic", "row", "norm", "most").toArrow().sort_by([(c, "ascending") for c in ("doc_id", "toxic", "row")])
    toxic, norms, most = (rows.column(k).to_numpy() for k in (1, 3, 4))
    full = most > 0
    numbers = rows.filter(pa.array(full)).select(["row"]).add_column(0, "id", pa.array(np.arange(full.sum()), pa.int32()))
    numbered = held.join(F.broadcast(docs.sparkSession.createDataFrame(numbers)), "row")
    stands = np.where(toxic == 1, sizes.get(1, 0) / max(1, n1), sizes.get(0, 0) / max(1, n0))
    stands = stands / stands.mean()
    # texts without words: their own share of toxic ones, and one at the rate of all
    base = float((stands * toxic)[~full].sum() + stands @ toxic / stands.sum()) / float(stands[~full].sum() + 1)
    postings = numbered.select("id", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("p.at", "id", "p.tf")
    # the examples that hold a term, n, are the length of its list
    index = _index_of(postings, n.astype(np.int32), int(max(most, default=0)), idf, norms[full])
    model = Model(Terms(terms), idf, index, rows.column(0).to_numpy()[full], toxic[full].astype(float), stands[full], base=base, group=grouped(index))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            share = []
            for first, last in pairwise([*range(0, len(batch), TEXTS), len(batch)]):
                queries, part = [], batch.slice(first, last - first)
                for at, tf in zip(part.column(1), part.column(2), strict=True):
                    at = at.values.to_numpy()
                    x = _damped(tf.values.to_numpy()) * judge.idf[at]
                    queries.append((at, x / np.sqrt(x @ x)))
                share += [v[0] for v in judge.votes(queries, part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64())], ["id", "share"])

    # each example judged by the others
    judged = numbered.select("id", "at", "tf").mapInArrow(votes, "id int, share double").toArrow().sort_by("id")
    shares = judged.column(1).to_pylist()
    sent.destroy()
    x = np.log((np.array([*shares, base]) + 1e-3) / (1 - np.array([*shares, base]) + 1e-3))
    rest = stands[~full]
    y = np.r_[model.toxic, (rest * toxic[~full]).sum() / max(rest.sum(), 1e-9)]
    model.slope, model.shift = _logistic(x, y, np.r_[model.weight, rest.sum()])
    return model


SCORED = "score double, predicted int, neighbours array<long>, cosines array<double>"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` but text, with score, predicted and, as evidence, the three nearest examples.

    A text without any of the model's terms (null and empty ones too) gets the calibrated rate of such examples;
    without a model every score is 0. Columns of ``docs`` with the names added are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    made = ["score", "predicted", "neighbours", "cosines"]
    columns = [c for c in docs.columns if c != "text" and c not in made]
    own = docs.select("text", F.struct(*columns, F.lit(0).alias("_")).alias("carried"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            out = []
            for first in range(0, len(batch), TEXTS):
                texts = batch.column(0).slice(first, TEXTS).to_pylist()
                out += judge.score(texts) if judge else [(0.0, [], [])] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x[0] for x in out], pa.float64()), pa.array([int(x[0] >= 0.5) for x in out], pa.int32()),
                 pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["carried", *made])

    result = own.mapInArrow(run, f"carried {own.schema['carried'].dataType.simpleString()}, {SCORED}")
    return result.select(*[f"carried.`{c}`" for c in columns], *made)
