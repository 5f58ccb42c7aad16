"""Source tracing: find where on a page a field's source text stands.

Fields and blocks are packed into chunk rows, a chunk of blocks being one
bucket of positions on a few pages. A field with a page meets the chunks of
that page, a field without one those of its whole contract, so a row of the
join is a tile: some fields and some blocks whose texts are all compared. The
shared bigrams of a tile are one product of two 0/1 matrices, and a tile gives
no more than the three best blocks of each field. Tiles are bounded, so a hot
page or contract is spread over many tasks; its work grows with the product of
its fields and blocks, which all have to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.boxes import union_box
from clauseloom.functions.text import match_norm
from clauseloom.operators.layout import tie
from clauseloom.session import bound_batches, ship

K = "contract_id"

# Matching thresholds.
SINGLE_PASS = 0.85
MERGED_PASS = 0.70
ANCHORS = 3
MAX_SPAN = 4
MIN_LENGTH = 6
MAX_JUMP = 2

#: Positions of a page and pages whose blocks make up a chunk, and most fields of one.
BUCKET, PAGES, FIELDS = 256, 8, 512
#: Cells of the matrices of a tile that are held at once.
CELLS = 4_000_000


def _blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised text and their bucket."""
    return blocks.selectExpr(
        K, "page_no", "sort_order", f"{tie(blocks)} AS block_id", "bbox", f"{match_norm('text')} AS norm",
        f"greatest(0L, floor(sort_order / {BUCKET})) AS bucket",
    )


def _probes(fields: DataFrame) -> DataFrame:
    """Fields that still need a box and have enough source text."""
    open_fields = fields.filter("bbox IS NULL AND source_text <> '' AND value IS NOT NULL")
    probes = open_fields.selectExpr(K, "field_key", "page_no AS field_page", f"{match_norm('source_text')} AS source")
    return probes.filter(f"length(source) >= {MIN_LENGTH}")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one contract and the same few pages as one row each; no run leaves its batch."""
    for batch in batches:
        key, pages = batch.column(0), batch.column(1)
        (number, known), n = _numbers(pages), len(batch)
        same = pc.fill_null(pc.equal(key.slice(1), key.slice(0, max(0, n - 1))), False).to_numpy(zero_copy_only=False)
        same &= (number[1:] == number[:-1]) & (known[1:] == known[:-1]) & (np.arange(1, n) % FIELDS != 0)
        starts = np.flatnonzero(np.r_[True, ~same][:n])
        rows = pa.StructArray.from_arrays(batch.columns[2:], batch.schema.names[2:])
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [key.take(first), pages.take(first), pa.ListArray.from_arrays(pa.array(np.r_[starts, n], pa.int32()), rows)], [K, "f_pages", "fields"])


def _field_chunks(probes: DataFrame) -> DataFrame:
    """Neighbouring fields of a contract, and of the same few pages where these are known, as one row."""
    rows = probes.selectExpr(K, f"CAST(floor(field_page / {PAGES}) AS BIGINT) AS f_pages", "field_key", "field_page", "source").sortWithinPartitions(K, "f_pages")
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    one = ", ".join(f"{c}: {kind[c]}" for c in rows.columns[2:])
    return rows.mapInArrow(_pack, f"{K} {kind[K]}, f_pages bigint, fields array<struct<{one}>>")


def _block_chunks(prepared: DataFrame) -> DataFrame:
    """The blocks of a bucket on a few pages in order, as one row.

    Windows of neighbours go on into later buckets: their first blocks are added, marked ``tail``.
    """
    reach = MAX_JUMP * (MAX_SPAN - 1)
    rows = prepared.selectExpr(
        f"{K} AS r_key", f"floor(page_no / {PAGES}) AS b_pages", "bucket AS own",
        f"explode(sequence(least(bucket, greatest(0L, floor((sort_order - {reach}) / {BUCKET}))), bucket)) AS bucket",
        "page_no", "sort_order", "block_id", "norm", "bbox",
    )
    # in one piece by its key: the next step packs it, so texts are shuffled as they are
    return rows.repartition("r_key", "b_pages", "bucket").groupBy("r_key", "b_pages", "bucket").agg(F.expr(
        "array_sort(collect_list(struct(page_no, sort_order, block_id, norm, bbox, own <> bucket AS tail))) AS blocks"
    ))


def _grams(texts: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both characters and code of every pair of neighbouring characters of the joined texts; ``at`` numbers the characters."""
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = at[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
    return row[:-1], row[1:], codes[:-1] * (int(at[-1]) + 1) + codes[1:]


class _Tile:
    """Bigrams of the fields and blocks of one tile, as places in a list of all that occur there."""

    def __init__(self, sources: list[str], texts: list[str]):
        self.n_fields, self.n_blocks = len(sources), len(texts)
        chars = np.frombuffer("".join(sources + texts).encode("utf-32-le"), np.uint32)
        met = np.zeros(int(chars.max(initial=0)) + 2, bool)
        met[chars] = True
        at = np.cumsum(met)
        (f1, f2, f), (b1, b2, b) = _grams(sources, at), _grams(texts, at)
        whole = f1 == f2
        self.f_row, f = f1[whole], f[whole]
        codes = np.concatenate([f, b])
        size = (int(at[-1]) + 1) ** 2
        if size <= max(1 << 16, 4 * len(codes)):
            place = np.zeros(size, np.int32)
            place[codes] = 1
            met = np.flatnonzero(place)
            place[met] = np.arange(len(met))
            places = place[codes]
        else:
            met, places = np.unique(codes, return_inverse=True)
        self.f_gram, b = places[: len(f)], places[len(f) :]
        inside = b1 == b2
        self.b_row, self.b_gram = b1[inside], b[inside]
        # pairs across two blocks, and how many blocks on the second one is
        self.c_row, self.c_gap, self.c_gram = b1[~inside], (b2 - b1)[~inside], b[~inside]
        width = max(1, CELLS // (self.n_fields + self.n_blocks))
        self.slices = [(i, min(i + width, len(met))) for i in range(0, len(met), width)]
        self.held = None

    @staticmethod
    def _matrix(row: np.ndarray, gram: np.ndarray, n: int, part: tuple[int, int]) -> np.ndarray:
        out = np.zeros((n, part[1] - part[0]), np.float32)
        own = (gram >= part[0]) & (gram < part[1])
        out[row[own], gram[own] - part[0]] = 1
        return out

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
        """0/1 matrices of fields and blocks, for a slice of the bigrams after the other."""
        for part in self.slices:
            if self.held is None or len(self.slices) > 1:
                self.held = self._matrix(self.f_row, self.f_gram, self.n_fields, part), self._matrix(self.b_row, self.b_gram, self.n_blocks, part)
            yield *self.held, part

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams that fields and blocks share, those of the fields and those of the blocks."""
        n, ns, nb = np.zeros((self.n_fields, self.n_blocks)), np.zeros(self.n_fields), np.zeros(self.n_blocks)
        for f, b, _ in self.parts():
            n += f @ b.T
            ns += f.sum(axis=1)
            nb += b.sum(axis=1)
        return n, ns, nb

    def windows(self, f_at: np.ndarray, b_at: np.ndarray) -> dict[int, np.ndarray]:
        """Bigrams that each field of the pairs shares with the joined text of two and more blocks from the pair's block on."""
        out = {span: np.zeros(len(f_at)) for span in range(2, MAX_SPAN + 1)}
        for f, window, part in self.parts():
            for span in range(2, min(MAX_SPAN, self.n_blocks) + 1):
                window = np.maximum(window[:-1], window[1:])
                own = (self.c_gap == span - 1) & (self.c_gram >= part[0]) & (self.c_gram < part[1])
                window[self.c_row[own], self.c_gram[own] - part[0]] = 1
                fits = np.flatnonzero(b_at < len(window))
                out[span][fits] += np.einsum("ij,ij->i", f[f_at[fits]], window[b_at[fits]])
        return out


def _best_pairs(n: np.ndarray, ns: np.ndarray, nb: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Field, block, n and score of the three best blocks of each field that share anything; ties go to the earlier block."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = n / ns[:, None] * 0.7 + n / (ns[:, None] + nb - n) * 0.3
    score[~open_ | (n == 0)] = 0
    found, every = [], np.arange(len(ns))
    for _ in range(min(ANCHORS, n.shape[1])):
        best = score.argmax(axis=1)
        some = np.flatnonzero(score[every, best] > 0)
        found.append((some, best[some], n[some, best[some]], score[some, best[some]]))
        score[every, best] = 0
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, 0 for null, and which are not null."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


@dataclass
class _Found:
    """Columns of a batch's pairs, tile by tile."""

    tile: list = field(default_factory=list)
    f: list = field(default_factory=list)
    b: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    span: list = field(default_factory=list)
    share: list = field(default_factory=list)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles to pairs: the three best blocks of each field there, each with the first window from it on that passes."""
    for batch in batches:
        lists = [c.slice(0, len(c)) for c in batch.columns[1:3]]
        (f_ends, b_ends), (fields, blocks) = ([np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))].astype(int) for c in lists], [c.flatten() for c in lists])
        sources, texts = fields.field("source").to_pylist(), blocks.field("norm").to_pylist()
        (f_page, paged), (b_page, b_known) = _numbers(fields.field("field_page")), _numbers(blocks.field("page_no"))
        order, ordered = _numbers(blocks.field("sort_order"))
        box = blocks.field("bbox")
        boxed, tail = box.is_valid().to_numpy(zero_copy_only=False), blocks.field("tail").to_numpy(zero_copy_only=False)
        # a block whose next one is its neighbour
        joined = np.zeros(len(b_page), bool)
        joined[:-1] = (b_page[1:] == b_page[:-1]) & (order[1:] - order[:-1] <= MAX_JUMP) & (ordered & b_known)[1:] & (ordered & b_known)[:-1]
        found = _Found()
        for i in range(len(batch)):
            f, b = slice(f_ends[i], f_ends[i + 1]), slice(b_ends[i], b_ends[i + 1])
            tile = _Tile(sources[f], texts[b])
            n, ns, nb = tile.shared()
            open_ = ((f_page[f][:, None] == b_page[b]) & b_known[b] | ~paged[f][:, None]) & ~tail[b]
            f_at, b_at, n_at, score = _best_pairs(n, ns, nb, open_)
            span, share = np.zeros(len(f_at), np.int32), np.zeros(len(f_at))
            tried = np.flatnonzero(paged[f][f_at])
            if len(tried):
                got, near, some_box = tile.windows(f_at[tried], b_at[tried]), joined[b], boxed[b]
                b_tried, runs, boxes = b_at[tried], np.ones(len(near), bool), some_box
                for width in range(2, min(MAX_SPAN, len(near)) + 1):
                    runs = runs[:-1] & near[width - 2 : len(near) - 1]
                    boxes = boxes[:-1] | some_box[width - 1 :]
                    inside = b_tried < len(runs)
                    at = np.where(inside, b_tried, 0)
                    part = got[width] / ns[f_at[tried]]
                    hit = tried[inside & runs[at] & boxes[at] & (part >= MERGED_PASS) & (span[tried] == 0)]
                    span[hit], share[hit] = width, got[width][np.searchsorted(tried, hit)] / ns[f_at[hit]]
            found.tile.append(np.full(len(f_at), i))
            found.f.append(f_at + f.start)
            found.b.append(b_at + b.start)
            found.counts.append(np.stack([n_at, ns[f_at], nb[b_at], score]))
            found.span.append(span)
            found.share.append(share)
        if not found.tile:
            continue
        f_at, b_at, span = np.concatenate(found.f), np.concatenate(found.b), np.concatenate(found.span)
        n, ns, nb, score = np.concatenate(found.counts, axis=1)
        none = span == 0
        ends = np.cumsum(span)
        in_window = np.repeat(b_at - (ends - span), span) + np.arange(span.sum())
        boxes = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), box.take(pa.array(in_window, pa.int64())))
        f_take, b_take = pa.array(f_at), pa.array(b_at)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.concatenate(found.tile))), fields.field("field_key").take(f_take), fields.field("field_page").take(f_take),
             *[blocks.field(c).take(b_take) for c in ("page_no", "sort_order", "block_id")], box.take(b_take),
             *[pa.array(c.astype(np.int32)) for c in (n, ns, nb)], pa.array(score), pa.array(span, mask=none),
             pa.array(np.concatenate(found.share), mask=none), boxes],
            [K, "field_key", "field_page", "page_no", "sort_order", "block_id", "bbox", "n", "ns", "nb", "score", "span", "share", "boxes"])


class GramIndex:
    """Fields and blocks compared by their bigrams, tile by tile.

    score = 0.7 * share of the source's bigrams in the block + 0.3 * Jaccard, from n bigrams shared of ns in the source
    and nb in the block.
    """

    def __init__(self, probes: DataFrame, prepared: DataFrame):
        self.probes, self.prepared = probes, prepared

    def best(self) -> DataFrame:
        """Pairs among which are the three best blocks of every field: the three best of each tile.

        ``span`` blocks from the pair's on are the shortest window that passes (for a field with a page), of score ``share``.
        """
        ship(self.probes.sparkSession)
        bound_batches(self.probes.sparkSession)
        meet = F.expr(f"{K} = r_key AND (f_pages IS NULL OR f_pages = b_pages)")
        tiles = _field_chunks(self.probes).join(_block_chunks(self.prepared), meet).select(K, "fields", "blocks")
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        box = kind(self.prepared, "bbox")
        made = [f"{c} {kind(self.probes, c)}" for c in (K, "field_key", "field_page")]
        made += [f"{c} {kind(self.prepared, c)}" for c in ("page_no", "sort_order", "block_id")]
        counts = f"bbox {box}, n int, ns int, nb int, score double, span int, share double, boxes array<{box}>"
        return tiles.mapInArrow(_compare, ", ".join([*made, counts]))

    def passing(self, least: float) -> DataFrame:
        """Those of them that score ``least`` or more."""
        return self.best().filter(F.col("score") >= least)


def _ranked(pairs: DataFrame) -> DataFrame:
    """The three best pairs of a field by score; ties go to the earlier block."""
    return pairs.repartition(K, "field_key").selectExpr(
        "*",
        f"row_number() OVER (PARTITION BY {K}, field_key ORDER BY score DESC, page_no, sort_order, block_id) AS rank",
    ).filter(f"rank <= {ANCHORS}")


def block_scores(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """The three best blocks per field with their score and rank. Ties go to the earlier block."""
    return _ranked(GramIndex(_probes(fields), _blocks(blocks)).best()).drop("span", "share", "boxes")


def locate_sources(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Page, first block's position, box, score and block count (``span``) of every field that can be traced.

    A field is done when its best block passes alone and has a box; without a
    page no other match is tried. Otherwise, with a known page, windows of two
    to four neighbouring blocks are tried from its best blocks on: anchors in
    rank order, shorter windows first. Neighbours are at most two positions
    apart, so an anchor needs the blocks of its next six positions only.
    """
    ranked = _ranked(GramIndex(_probes(fields), _blocks(blocks)).best())
    passed = f"rank = 1 AND score >= {SINGLE_PASS} AND bbox IS NOT NULL"
    at = "page_no AS page_no, sort_order AS sort_order"
    single = f"any_value(struct({at}, array(bbox) AS boxes, score AS score, 1 AS span)) FILTER (WHERE {passed})"
    window = f"min_by(struct({at}, boxes AS boxes, share AS score, span AS span), rank) FILTER (WHERE span IS NOT NULL)"
    return ranked.groupBy(K, "field_key").agg(F.expr(f"coalesce({single}, {window}) AS m")).filter("m IS NOT NULL").selectExpr(
        K, "field_key", "m.page_no", "m.sort_order", f"{union_box('m.boxes')} AS bbox", "m.score", "m.span"
    )


def attach_boxes(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fields with the traced box, and the page where that was unknown."""
    found = locate_sources(fields, blocks).selectExpr(K, "field_key", "page_no AS f_page", "bbox AS f_box")
    swap = {"bbox": "coalesce(bbox, f_box) AS bbox", "page_no": "coalesce(page_no, f_page) AS page_no"}
    return fields.join(found, [K, "field_key"], "left").selectExpr(*[swap.get(c, c) for c in fields.columns])
