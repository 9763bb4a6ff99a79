"""Best-fit packing with large-item matching (operator 9).

Tokenising is one pass; what it keeps is a row of numbers per piece. The plan needs only how many pieces have each
length, a table of ``capacity`` counts however large the corpus is:

* pieces above a third of the capacity are large: at most two meet in a bin, the longest with the longest partner
  that still fits, greedily from the longest down;
* smaller pieces, longest first, go to the smallest gap that takes them, bins of equal gap being handled as one group.

The plan is a short list of (bin pattern, number of bins). Pieces of one length are interchangeable, so each takes a
place by its rank among its length: ranks come from counts per input partition, without sorting the corpus.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

CAPACITY = 2048
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes -> id if merging by lowest id equals merging in the listed order, else None."""
    model = spec["model"]
    if model.get("type", "BPE") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ids = model["vocab"]
    made = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if made != sorted(set(made)) or made[:1] == [-1]:
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letter[c] for c in t): i for t, i in ids.items() if t not in added}


class Tokens:
    """Ids of whole texts, as little-endian uint32 bytes, by a ``tokenizers`` JSON file.

    The byte-level pre-tokenizer always cuts before a single space, so ids are looked up per space-separated chunk
    and remembered (``limit`` chunks at most, then anew). New chunks go through the faster ``tiktoken`` where the
    file's merges are in the order of their ids, which makes both agree. Texts with white space on both sides of a
    space, or with an added token's string, are encoded whole by ``tokenizers``.
    """

    #: Chunks of more characters are encoded each time anew.
    LONG = 64

    _whole = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")
    _pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, limit: int = 400_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        self._added = [t.content for t in self._of.get_added_tokens_decoder().values()]
        self._limit, self._known, self._fast = limit, {}, None
        with open(path, encoding="utf-8") as f:
            ranks = _byte_ranks(json.load(f))
        if ranks:
            import tiktoken

            own = tiktoken.Encoding("byte-level", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
            self._fast, self._piece = own.encode_ordinary, own._encode_single_piece
            self._marks = {m: self._chunk(m) for m in ".,"}

    def _encode(self, text: str) -> bytes:
        return array("I", self._of.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, text: str) -> bytes:
        return array("I", self._fast(text)).tobytes() if self._fast else self._encode(text)

    def _after_space(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it. Letters alone are one pre-token, and so is a mark after them."""
        if self._fast:
            if chunk.isalpha():
                return array("I", self._piece((" " + chunk).encode())).tobytes()
            word, mark = chunk[:-1], self._marks.get(chunk[-1:])
            if mark and word.isalpha():
                ids = self._known.get(word)
                if ids is None and len(word) > self.LONG:
                    return array("I", self._piece((" " + word).encode())).tobytes() + mark
                if ids is None:
                    ids = self._known[word] = array("I", self._piece((" " + word).encode())).tobytes()
                return ids + mark
        return self._chunk(" " + chunk)

    def one(self, text: str) -> bytes:
        if self._whole.search(text) or any(a in text for a in self._added):
            return self._encode(text)
        known = self._known
        if len(known) > self._limit:
            known.clear()
        first, *rest = text.split(" ")
        out = [self._chunk(first)]
        add = out.append
        for c in rest:
            ids = known.get(c)
            if ids is None:
                ids = self._after_space(c)
                if len(c) <= self.LONG:  # so that what is remembered is bounded in bytes
                    known[c] = ids
            add(ids)
        return b"".join(out)


_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()),
])


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = None, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this partition
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            tokens = tokens or Tokens(path)
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            out: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                data = tokens.one(text) + end
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                for i, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if i == 0 else capacity
                    out.append((doc, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of a length within a partition."""
    return docs.select("doc_id", "text").mapInArrow(
        _tokenise(tokenizer or default_tokenizer(), capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long",
    )


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in the bin in order) that use exactly ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    groups: dict[int, list[list]] = {}  # gap -> [number of bins, lengths]

    def put(gap: int, number: int, lengths: list[int]) -> None:
        if number:
            groups.setdefault(gap, []).append([number, lengths])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            put(capacity - n, left[n], [n])
            large.pop()
            continue
        m = large[at]
        number = left[n] // 2 if m == n else min(left[n], left[m])
        if m == n and left[n] == 1:
            # the last of its length: its partner is the next shorter large piece, if any
            if at == 0:
                put(capacity - n, 1, [n])
                large.pop()
                continue
            m, number = large[at - 1], 1
        put(capacity - n - m, number, [n, m])
        for x in (n, m):
            left[x] -= number
        for x in {n, m}:
            if not left[x]:
                large.remove(x)
    gaps = sorted(groups)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                gap, number, lengths = capacity, -(-todo // (capacity // n)), []  # as many new bins as it takes
            else:
                gap = gaps[at]
                number, lengths = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            each = gap // n
            whole = min(number, todo // each)
            rest = min(each, todo - whole * each) if whole < number else 0
            todo -= whole * each + rest
            for k, times in ((each, whole), (rest, 1 if rest else 0), (0, number - whole - (1 if rest else 0))):
                if times:
                    g = gap - k * n
                    if g not in groups:
                        bisect.insort(gaps, g)
                    put(g, times, lengths + [n] * k)
    return [(number, lengths) for some in groups.values() for number, lengths in some]


def _places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where each run of ranks begins, and its first bin, copies per bin and offset of the first copy."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for number, lengths in plan:
        at = 0
        for n in dict.fromkeys(lengths):
            copies = lengths.count(n)
            runs.setdefault(n, []).append((taken.get(n, 0), first_bin, copies, at))
            taken[n] = taken.get(n, 0) + number * copies
            at += copies * n
        first_bin += number
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece with the end id alone. Repeated rows are packed each by itself, a null
    doc_id stays null, other columns are ignored, an empty table gives no rows. Which of several pieces of equal
    length takes which place is arbitrary; all else is fixed by the lengths.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    count = materialize(found.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in count.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = spark.sparkContext.broadcast(_places(plan_bins(total, capacity)))
    # rank of a piece among its length: pieces in earlier partitions plus those before it in its own
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
            for i, at in enumerate(cut):
                own = order[at : cut[i + 1] if i + 1 < len(cut) else len(order)]
                n = int(length[own[0]])
                begin, first, copies, start = places.value[n]
                run = np.searchsorted(begin, rank[own], "right") - 1
                nth = rank[own] - begin[run]
                bins[own] = first[run] + nth // copies[run]
                offset[own] = start[run] + nth % copies[run] * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(bins), pa.array(offset)], names=[x.split()[0] for x in _OUT.split(", ")])

    return ranked.mapInArrow(place, _OUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
