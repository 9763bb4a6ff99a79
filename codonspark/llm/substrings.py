"""Exact removal of repeated passages by relative Lempel-Ziv parsing (operator 5).

A window is ``width`` consecutive words. A word goes if a window covers it whose word sequence also starts in a
document with a smaller id.

1. Reference blocks. Each window's key is the least hash among its ``gram``-word runs. Consecutive windows of one key
   form a block: a few dozen words whose limits depend on the words alone, so a passage that occurs twice is cut into the
   same blocks but for its ends. Every block of every document is indexed: each distinct one has a row with its first
   holder, the document with the smallest id, and its place there.
2. Greedy factors. A document is parsed from left to right. A block that an earlier document holds opens a factor
   (reference document, place there, length), or extends the open one when it goes on in the same reference.
3. Factor boundaries. Where a key has several contents (the ends of a passage, or an edit), a factor may begin or
   end inside a block: there single windows are looked up, those of one representative document per block, and extend the
   factors or make new ones. A factor is one window long at least, so each is a duplicate span.

The first holder comes from a minimum that combines before the shuffle, and blocks that very many documents hold are
joined by broadcast (a thousand rows at most), so a passage in a third of all documents is no hot key. Texts are shuffled
once, to meet their factors; those with boundaries once more. Sequences match if two 64-bit hashes of them agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fresh_name, join_hot, materialize, mix64, read_table, release, split_words

WIDTH = 50
GRAM = 24

_BASES = (0x9E3779B97F4A7C55, 0xD6E8FEB86659FD95)


class Rolling:
    """Polynomial hashes modulo 2**64 of runs of words. Powers are kept for the longest text so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, np.uint64(b))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        out = np.zeros(n, np.uint64)
        np.cumsum(hashes * self.up[: n - 1], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Parser:
    """Words of a text to blocks and window hashes."""

    def __init__(self, width: int, gram: int) -> None:
        self.width, self.gram = width, min(gram, width)
        self.words = WordHashes(11)
        self.rolling = [Rolling(b) for b in _BASES]

    def _sums(self, words: list[str]) -> list[np.ndarray]:
        h = self.words(words)
        return [self.rolling[0].sums(h), self.rolling[1].sums(mix64(h))]

    def _hashes(self, sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Both 64-bit hashes of the runs; a run's length counts too."""
        size = (end - start).astype(np.uint64)
        return [mix64(roll.runs(s, start, end) + size).view(np.int64) for roll, s in zip(self.rolling, sums, strict=True)]

    def blocks(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """key, both hashes, first and last window of each block; None below one window."""
        n, w = len(words), self.width
        if n < w:
            return None
        sums = self._sums(words)
        at = np.arange(n - self.gram + 1)
        key = sliding_min(mix64(self.rolling[0].runs(sums[0], at, at + self.gram)), w - self.gram + 1)
        low = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        high = np.r_[low[1:], len(key)] - 1
        return key[low].view(np.int64), *self._hashes(sums, low, high + w), low, high

    def windows(self, words: list[str], starts: np.ndarray) -> list[np.ndarray]:
        """Both hashes of the windows at ``starts``."""
        return self._hashes(self._sums(words), starts, starts + self.width)


def _row_key() -> F.Column:
    """Tells rows apart that share an id; identical rows share all that is decided about them."""
    return F.xxhash64("doc_id", "text")


_BLOCK = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _blocks(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(width, gram)
        for b in batches:
            docs, rows = b.column("doc_id").to_numpy(), b.column("row").to_numpy()
            found, size = [], []
            for text in b.column("text"):
                one = parser.blocks(split_words(text.as_py()))
                size.append(len(one[0]) if one else 0)
                if one:
                    found.append(one)
            if found:
                key, h1, h2, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = (np.repeat(docs, size), np.repeat(rows, size), key, h1, h2, low.astype(np.int32), high.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_BLOCK)

    return run


_WINDOW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int32())])


def _windows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(width, gram)
        for b in batches:
            for doc, row, text, spans in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text"), b.column("spans").to_pylist(), strict=True):
                at = np.unique(np.concatenate([np.arange(s["low"], s["high"] + 1) for s in spans]))
                h1, h2 = parser.windows(split_words(text.as_py()), at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), row)), pa.array(h1), pa.array(h2), pa.array(at.astype(np.int32))], schema=_WINDOW)

    return run


def _first_holders(rows: DataFrame, *more: str) -> DataFrame:
    """A row per sequence: first holder ``ref`` and place ``ref_low`` there, last holder, number of rows ``n``."""
    first = F.min(F.struct("doc_id", "low")).alias("first")
    out = rows.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("last"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in more))
    return out.select("h1", "h2", F.col("first.doc_id").alias("ref"), F.col("first.low").alias("ref_low"), "last", "n", *more)


def _total(table: DataFrame) -> int:
    return table.agg(F.count("*")).first()[0]


def duplicate_pieces(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(row, low, high, ref, ref_low): windows low..high of that row start at ref_low of document ref, an earlier one."""
    piece = ["row", "low", "high", "ref", "ref_low"]
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", _row_key().alias("row"))
    kind = "doc_id long, row long, key long, h1 long, h2 long, low int, high int"
    index = materialize(texts.mapInArrow(_blocks(width, gram), kind), "blocks")
    first = materialize(_first_holders(index, "key"), "first-blocks")
    held = first.where("last > ref").select("h1", "h2", "ref", "ref_low", "n")
    whole = materialize(join_hot(index, held, ["h1", "h2"], _total(index)).where("doc_id > ref").select(piece), "whole-blocks")
    # keys with several contents; each content speaks through the document that holds it first
    edge = first.groupBy("key").agg(F.count("*").alias("m"), F.min("ref").alias("a"), F.max("ref").alias("b")).where("m > 1 and a < b").select("key", "m")
    speak = materialize(join_hot(first, materialize(edge, "edges"), ["key"], _total(first), "m").select("h1", "h2", "ref", "n"), "speakers")
    spans = join_hot(index, speak, ["h1", "h2"], _total(index)).where("doc_id = ref")
    spans = materialize(spans.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "boundaries")  # of one document each
    release(index, first, speak)
    at = texts.join(spans, "row").mapInArrow(_windows(width, gram), "doc_id long, row long, h1 long, h2 long, low int")
    at = materialize(at, "boundary-windows")
    release(spans)
    met = materialize(_first_holders(at).where("last > ref").select("h1", "h2", "ref", "ref_low", "n"), "met-windows")
    single = join_hot(at, met, ["h1", "h2"], _total(at)).where("doc_id > ref").withColumn("high", F.col("low"))
    out = materialize(whole.unionByName(single.select(piece)), "pieces")
    release(at, met, whole)
    return out


def factors_of(pieces: list[dict] | None) -> list[list[int]]:
    """Greedy factors [low, high, ref, ref_low] of one text, from left to right: a piece that goes on where the open factor
    stands, in the text and in its reference, extends it. Pieces inside a factor add nothing."""
    out: list[list[int]] = []
    for p in sorted(pieces or (), key=lambda p: (p["low"], -p["high"], p["ref"], p["ref_low"])):
        low, high, ref, ref_low = p["low"], p["high"], p["ref"], p["ref_low"]
        if out:
            last = out[-1]
            if high <= last[1]:
                continue
            if low <= last[1] + 1 and ref == last[2] and ref_low - low == last[3] - last[0]:
                last[1] = high
                continue
        out.append([low, high, ref, ref_low])
    return out


def keep_mask(n: int, factors: list[list[int]], width: int) -> np.ndarray:
    """Words of a text of n words that no factor covers. A factor of windows low..high has high - low + width words."""
    edge = np.zeros(n + 1, np.int64)
    for low, high, *_ in factors:
        edge[low] += 1
        edge[min(n, high + width)] -= 1
    return np.cumsum(edge[:n]) == 0


def _with_pieces(docs: DataFrame, width: int, gram: int) -> tuple[DataFrame, str]:
    """``docs`` and one more column, of the name returned: the row's pieces, or null."""
    row, name = fresh_name("row", docs.columns), fresh_name("pieces", docs.columns)
    pieces = duplicate_pieces(docs, width, gram).groupBy("row").agg(F.collect_set(F.struct("low", "high", "ref", "ref_low")).alias(name))
    return docs.withColumn(row, _row_key()).join(pieces.withColumnRenamed("row", row), row, "left").drop(row), name


def factors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The parse: (doc_id, start, length, ref_doc_id, ref_start), a row per factor of each document.

    ``length`` words from ``start`` (from 0) stand at ``ref_start`` of an earlier document too. Factors may overlap; literal
    stretches between them have no row. Nulls and repeats are treated as in ``digest``; repeated rows are parsed each.
    """
    kind = "doc_id long, start long, length long, ref_doc_id long, ref_start long"
    found, name = _with_pieces(docs.select("doc_id", "text"), width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(doc, low, high - low + width, ref, at) for doc, own in zip(b.column("doc_id").to_pylist(), b.column(name).to_pylist(), strict=True) for low, high, ref, at in factors_of(own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in kind.split(", ")])

    return found.select("doc_id", name).where(F.col(name).isNotNull()).mapInArrow(run, kind)


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``.

    Null and empty texts have no words. Rows that share an id are one document: no window of one is earlier than one of
    another. A null id is never earlier than any, and nothing of it is removed. Other columns are ignored.
    """
    found, name = _with_pieces(docs.select("doc_id", "text"), width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, pieces in zip(b.column("text"), b.column(name).to_pylist(), strict=True):
                words = split_words(text.as_py())
                kept = [w for w, k in zip(words, keep_mask(len(words), factors_of(pieces), width), strict=True) if k] if pieces else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            a, c, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (kept words joined by one space) and ``n_chars`` set anew.

    Texts without a repeated passage stay as they are, null texts stay null; a text that is all repeats becomes empty.
    Rows that share an id, repeated ones too, are one document and lose nothing to each other; rows without an id lose
    nothing. All other columns pass through; an empty table gives an empty one.
    """
    columns = docs.columns
    found, name = _with_pieces(docs, width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, pieces in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                if pieces:
                    words = split_words(text)
                    text = " ".join([w for w, k in zip(words, keep_mask(len(words), factors_of(pieces), width), strict=True) if k])
                texts.append(text)
            own = {c: b.column(c) for c in columns}
            own["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([own[c] for c in columns], names=columns)

    out = found.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))


#: The contract in plain SQL: every window of every document against the least document that holds it.
OP5_SQL = r"""
with words as (select row_number() over () as rid, doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
windows as (select rid, doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as s from (select rid, doc_id, w, unnest(range(0, len(w) - 49)) as i from words where len(w) >= 50)),
holders as (select s, min(doc_id) as least from windows group by s),
repeats as (select rid, i from windows join holders using (s) where least < doc_id),
gone as (select distinct rid, unnest(range(i, i + 50)) as pos from repeats),
kept as (select rid, count(*) as n, string_agg(word, ' ' order by pos) as kept from (select rid, unnest(w) as word, unnest(range(0, len(w))) as pos from words) anti join gone using (rid, pos) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words left join kept using (rid)
"""
