"""URL rules in a memory-mapped array of sorted digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from clauseloom.llm.shared import ASCII_LOWER, ship

#: Rules that one index may hold; every executor keeps a copy of it on disk (some 60 bytes a rule).
MOST_RULES = 20_000_000
VERDICTS = ("allow", "block")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or end. Null and urls without ``://``: both empty."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass"), slash + path


class RuleIndex:
    """Sorted 64-bit digests of the rules, with their full texts to tell collisions apart.

    File: rules and path lengths (2 int64), distinct path lengths (int64), digests (uint64), text offsets (int64),
    verdicts (int64), texts. The arrays are mapped, not read, so many workers share one copy in the page cache.
    """

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=2)
        n, lengths = int(head[0]), int(head[1])
        self.path_lengths = np.memmap(path, np.int64, "r", 16, shape=lengths).tolist() if lengths else []
        at = 16 + 8 * lengths
        self.digests = np.memmap(path, np.uint64, "r", at, shape=n) if n else np.empty(0, np.uint64)
        self.offsets = np.memmap(path, np.int64, "r", at + 8 * n, shape=n + 1)
        self.verdicts = np.memmap(path, np.int64, "r", at + 16 * n + 8, shape=n) if n else np.empty(0, np.int64)
        self.start, self.file = at + 24 * n + 8, np.memmap(path, np.uint8, "r")

    @staticmethod
    def write(path: str, rules: dict[str, str]) -> None:
        """``rules``: from host + path (``example.net/en/``) to its verdict."""
        texts = {r.encode(): VERDICTS.index(v) for r, v in rules.items()}
        keyed = sorted((xxhash.xxh64_intdigest(t), t, v) for t, v in texts.items())
        lengths = sorted({len(r.partition("/")[1] + r.partition("/")[2]) for r in rules})
        with open(path, "wb") as out:
            out.write(np.array([len(keyed), len(lengths), *lengths], np.int64).tobytes())
            out.write(np.array([k for k, _, _ in keyed], np.uint64).tobytes())
            out.write(np.cumsum([0, *(len(t) for _, t, _ in keyed)]).astype(np.int64).tobytes())
            out.write(np.array([v for _, _, v in keyed], np.int64).tobytes())
            out.write(b"".join(t for _, t, _ in keyed))

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """Every rule that would fit, longest first; of equal length the longer host first."""
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        found = [(len(h) + k, len(h), h + path[:k]) for h in hosts for k in self.path_lengths if k <= len(path)]
        return (rule for _, _, rule in sorted(found, reverse=True))

    def find(self, keys: list[str]) -> np.ndarray:
        """Number of the rule equal to each key, -1 for none."""
        data = [k.encode("utf-8", "surrogatepass") for k in keys]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data))
        at = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(at < len(self.digests))
        hit = hit[self.digests[at[hit]] == digests[hit]]
        for i in hit.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:  # past collisions, to the same text
                a, b = self.start + int(self.offsets[k]), self.start + int(self.offsets[k + 1])
                if self.file[a:b].tobytes() == data[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """(host, path, rule, its verdict) for each url; rule and verdict are None where none fits."""
        split = [split_url(u) for u in urls]
        keys = [list(self.candidates(*s)) for s in split]
        numbers = self.find([k for own in keys for k in own])
        out, start = [], 0
        for (host, path), own in zip(split, keys, strict=True):
            fits = np.flatnonzero(numbers[start : start + len(own)] >= 0)
            rule = own[fits[0]] if len(fits) else None
            out.append((host, path, rule, VERDICTS[int(self.verdicts[numbers[start + fits[0]]])] if len(fits) else None))
            start += len(own)
        return out


def build(spark: SparkSession, rules: DataFrame) -> str:
    """Build the index of ``rules`` (rule, verdict) and send its file to all executors; the name it has there.

    Null rules are left out; a rule with both verdicts blocks. More than MOST_RULES rules are refused.
    """
    rows = rules.where("rule is not null").select("rule", "verdict").distinct().limit(2 * MOST_RULES + 1).toArrow()
    held: dict[str, str] = {}
    for rule, verdict in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        if verdict not in VERDICTS:
            raise ValueError(f"verdict of {rule!r} is {verdict!r}, not one of {VERDICTS}")
        held[rule] = max(verdict, held.get(rule, verdict))
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: split them by host over several indexes")
    name = f"url-rules-{uuid.uuid4().hex}"
    path = Path(tempfile.mkdtemp(prefix="clauseloom-")) / name
    RuleIndex.write(str(path), held)
    spark.sparkContext.addFile(str(path))
    return name


_OPEN: dict[str, RuleIndex] = {}  # one for each Python worker


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The columns of ``pages`` but html, with host, path, rule and verdict (columns of those names are replaced).

    A rule is a host and a path prefix in one text (``example.net/en/``). It fits its host and all subdomains if the
    url's path starts with its path; the longest fitting rule wins, of equal length the one with the longer host.
    Urls that no rule fits get ``default`` and a null rule. Null and empty urls, and urls without ``://``, have an
    empty host and path. Rows are judged one by one, so repeated rows and empty tables need no care.
    """
    spark = pages.sparkSession
    ship(spark)
    name = build(spark, rules)
    columns = [c for c in pages.columns if c not in ("html", "host", "path", "rule", "verdict")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN[name] = RuleIndex(SparkFiles.get(name))
        for batch in batches:
            rows = _OPEN[name].judge(batch.column(columns.index("url")).to_pylist())
            made = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            made.append(pa.array([r[3] or default for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*columns, "host", "path", "rule", "verdict"])

    return pages.select(*columns).mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string")
