"""Language identification by segmentation-marginalised unigrams (operator 8).

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces of the product of their probabilities (forward algorithm); a text's is the product
over its words. Training: at most ``docs_per_lang`` documents of each language (the smallest hashes of their ids, whole
texts), counted to words by Spark, then a few rounds of expectation-maximisation over the segmentations of those words.
Scoring is one pass; words are scored once and remembered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, materialize, read_table

DOCS_PER_LANG = 1000
ROUNDS = 2
#: Words up to this length can't underflow a double; longer ones are summed by logarithms, each time anew.
SHORT_WORD = 24
MAX_LANGS = 400
UNKNOWN = 1e-9
_LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The vocabulary's lower-cased pieces of letters, in its order; with START where a word begins."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in found if p.replace(START, "", 1).isalpha()]


def runs_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and of numbers that are no digits, such as one half or Roman eight."""
    return _LETTERS.findall((text or "").lower())


def letters_in(run: str) -> list[str]:
    """The runs of letters in a run."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for run in runs_of(text) for w in letters_in(run)]


class Segmenter:
    """Piece probabilities of ``n`` languages; tables are lists of n floats by piece."""

    def __init__(self, pieces: list[str], table: np.ndarray) -> None:
        self.rows = {p: tuple(row) for p, row in zip(pieces, table.tolist(), strict=True)}
        self.longest = max(map(len, pieces), default=1)
        self.n = table.shape[1]
        self._none = (UNKNOWN,) * self.n

    def lattice(self, word: str) -> list[list[tuple[int, tuple[float, ...], str]]]:
        """For each end in START + word: (start, probabilities, piece) of the pieces that end there.

        A single character that no piece is has a small probability in every language.
        """
        text, rows, longest = START + word, self.rows, self.longest
        ends = []
        for end in range(1, len(text) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                row = rows.get(text[start:end])
                if row:
                    here.append((start, row, text[start:end]))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self._none, ""))
            ends.append(here)
        return ends

    def forward(self, ends: list) -> list[list[float]]:
        n = range(self.n)
        alpha = [[1.0] * self.n]
        for here in ends:
            now = [0.0] * self.n
            for start, row, _ in here:
                before = alpha[start]
                for j in n:
                    now[j] += before[j] * row[j]
            alpha.append(now)
        return alpha

    def _expected_by_logs(self, ends: list, lang: int) -> list[tuple[str, float]]:
        alpha, beta = [0.0], [-math.inf] * len(ends) + [0.0]
        with np.errstate(divide="ignore"):
            logs = [[float(np.log(row[lang])) for _, row, _ in here] for here in ends]
        for here, own in zip(ends, logs, strict=True):
            alpha.append(float(np.logaddexp.reduce([alpha[start] + p for (start, _, _), p in zip(here, own, strict=True)])))
        for end in range(len(ends), 0, -1):
            for (start, _, _), p in zip(ends[end - 1], logs[end - 1], strict=True):
                beta[start] = float(np.logaddexp(beta[start], p + beta[end]))
        return [
            (piece, math.exp(alpha[start] + p + beta[end] - alpha[-1]))
            for end, (here, own) in enumerate(zip(ends, logs, strict=True), 1) for (start, _, piece), p in zip(here, own, strict=True) if piece
        ]

    def expected(self, word: str, lang: int) -> list[tuple[str, float]]:
        """Expected number of uses of each piece in the word's segmentations, for one language."""
        ends = self.lattice(word)
        if len(word) > SHORT_WORD:
            return self._expected_by_logs(ends, lang)
        alpha = [a[lang] for a in self.forward(ends)]
        beta = [0.0] * len(alpha)
        beta[-1] = 1.0
        out = []
        if alpha[-1] <= 0:
            return out
        for end in range(len(ends), 0, -1):
            for start, row, piece in ends[end - 1]:
                beta[start] += row[lang] * beta[end]
        for end, here in enumerate(ends, 1):
            for start, row, piece in here:
                if piece:
                    out.append((piece, alpha[start] * row[lang] * beta[end] / alpha[-1]))
        return out


class WordScores:
    """Rows of log probabilities by language, one per distinct word met, up to ``limit`` words (then started anew).

    The forward algorithm runs over many new words at once, one end position after another.
    """

    def __init__(self, pieces: list[str], table: np.ndarray, limit: int = 400_000) -> None:
        self._place: dict[str, int] = {}
        for p in pieces:
            for i in range(1, len(p)):
                self._place.setdefault(p[:i], -1)  # a beginning of pieces
        self._place |= {p: i for i, p in enumerate(pieces)}
        self._table = np.vstack([table, np.full((1, table.shape[1]), UNKNOWN)])
        self._logs, self._long = np.log(self._table), set()
        self._limit, self._known, self._rows = limit, {}, np.zeros((1024, table.shape[1]))

    def forward(self, words: list[str]) -> np.ndarray:
        place, unknown = self._place, len(self._table) - 1
        of, begin, stop, piece = [], [], [], []
        for w, word in enumerate(words):
            text = START + word
            size = len(text)
            for i in range(size):
                single = False
                for j in range(i + 1, size + 1):
                    p = place.get(text[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        of.append(w)
                        begin.append(i)
                        stop.append(j)
                        piece.append(p)
                        single |= j == i + 1
                if not single:
                    of.append(w)
                    begin.append(i)
                    stop.append(i + 1)
                    piece.append(unknown)
        of, begin, stop, piece = (np.array(x, np.int32) for x in (of, begin, stop, piece))
        order = np.argsort(stop, kind="stable")
        of, begin, stop, piece = (x[order] for x in (of, begin, stop, piece))
        longest = int(stop[-1])
        alpha = np.zeros((longest + 1, len(words), self._table.shape[1]))
        alpha[0] = 1.0
        cut = np.searchsorted(stop, np.arange(1, longest + 2))
        for end in range(1, longest + 1):
            own = slice(cut[end - 1], cut[end])
            w = of[own]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[end, w[first]] = np.add.reduceat(alpha[begin[own], w] * self._table[piece[own]], first, axis=0)
        last = alpha[np.array([len(w) + 1 for w in words]), np.arange(len(words))]
        return np.log(last)

    def by_logs(self, word: str) -> np.ndarray:
        """The row of a word of any length: the same sum by logarithms, which don't underflow."""
        place, unknown, logs, text = self._place, len(self._table) - 1, self._logs, START + word
        alpha = np.zeros((len(text) + 1, self._table.shape[1]))
        begins: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for i in range(len(text)):
            single = False
            for j in range(i + 1, len(text) + 1):
                p = place.get(text[i:j])
                if p is None:
                    break
                if p >= 0:
                    begins[j].append((i, p))
                    single |= j == i + 1
            if not single:
                begins[i + 1].append((i, unknown))
        for end in range(1, len(text) + 1):
            at, piece = zip(*begins[end], strict=True)
            alpha[end] = np.logaddexp.reduce(alpha[list(at)] + logs[list(piece)], axis=0)
        return alpha[-1]

    def learn(self, runs: set[str]) -> None:
        """Make rows for the runs that have none. Those with other characters than letters are the sums of their words; long words are
        not remembered."""
        if len(self._known) > self._limit:
            self._known.clear()
        new = [r for r in runs if r not in self._known]
        odd = {r: letters_in(r) for r in new if not r.isalpha()}
        words = {*(r for r in new if r not in odd), *(w for parts in odd.values() for w in parts if w not in self._known)}
        self._long = {r for r in new if len(r) > SHORT_WORD}
        new = sorted((w for w in words if len(w) <= SHORT_WORD), key=len)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self._keep(part, self.forward(part))
        some = [r for r in odd if r not in self._long]
        if some:
            self._keep(some, np.array([self.row(odd[r]) for r in some]))

    def _keep(self, runs: list[str], rows: np.ndarray) -> None:
        n = len(self._known)
        while n + len(runs) > len(self._rows):
            self._rows = np.vstack([self._rows, np.zeros_like(self._rows)])
        self._rows[n : n + len(runs)] = rows
        self._known.update(zip(runs, range(n, n + len(runs)), strict=True))

    def row(self, words: list[str]) -> np.ndarray:
        zero = np.zeros(self._rows.shape[1])
        return sum((self._rows[self._known[w]] if w in self._known else self.by_logs(w) for w in words), zero)

    def total(self, runs: list[str]) -> np.ndarray:
        """Sum of the rows of runs that ``learn`` has just seen."""
        out = np.zeros(self._rows.shape[1])
        if self._long:
            for r in runs:
                if r in self._long:
                    out += self.row(letters_in(r))
            runs = [r for r in runs if r not in self._long]
        for at in range(0, len(runs), 1 << 16):
            part = runs[at : at + (1 << 16)]
            out += self._rows[np.fromiter(map(self._known.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return out


def _expect(segmenter_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, total = segmenter_of(), {}
        for b in batches:
            for lang, word, n in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for piece, x in seg.expected(word, lang):
                    total[lang, piece] = total.get((lang, piece), 0.0) + n * x
        keys = [*total]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([*total.values()], pa.float64())], names=["lang", "piece", "n"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for b in batches:
        total: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            total.update((lang, w) for w in words_of(text.as_py()))
        keys = [*total]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([*total.values()], pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, path: str | None = None, docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS, max_langs: int = MAX_LANGS) -> dict:
    """{"langs", "pieces", "table" (log-free probabilities, piece by language), "prior"}.

    Learns from rows with a text, a language and an id that isn't held out; of more than ``max_langs`` values in ``lang`` the
    commonest are learned (what is broadcast has a number a piece and language). Without any there is no language.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    langs = sorted(counts)
    pieces = read_pieces(path or default_pieces())
    if not langs:
        return {"langs": [], "pieces": pieces, "table": np.zeros((len(pieces), 0)), "prior": np.zeros(0)}
    # a hash threshold per language thins before anything is ranked, so no language's rows meet in one task
    dial = spark.createDataFrame([(x, min(1.0, 1.3 * docs_per_lang / counts[x])) for x in langs], "lang string, share double")
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    few = rows.join(F.broadcast(dial), "lang").where(share < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(f"r <= {docs_per_lang}").select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(materialize(ids, "language-ids")), ["doc_id", "lang"]).select("lang", "text")
    words = sample.mapInArrow(_split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    words = materialize(words.select(number[F.col("lang")].cast("int").alias("lang"), "word", "n").repartition(24), "language-words")
    # the vocabulary's order is its merge order: earlier pieces are the more common ones
    base = 1.0 / (np.arange(len(pieces)) + 50.0)
    base /= base.sum()
    table = np.repeat(base[:, None], len(langs), axis=1)
    place = {p: i for i, p in enumerate(pieces)}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, table))
        got = words.mapInArrow(_expect(lambda sent=sent: Segmenter(*sent.value)), "lang int, piece string, n double")
        frame = got.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # languages x pieces at most
        count = np.zeros_like(table)
        count[[place[p] for p in frame["piece"]], frame["lang"].to_numpy(int)] = frame["n"].to_numpy()
        count += base[:, None] * 200
        table = count / count.sum(axis=0)
    prior = np.array([counts[x] for x in langs], float)
    return {"langs": langs, "pieces": pieces, "table": table, "prior": np.log(prior / prior.sum())}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability.

    ``und`` with score 0 for a null text, one without letters, or without any learned language. Ties go to the first
    language by name. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        langs = own["langs"]
        scores = WordScores(own["pieces"], own["table"])
        for b in batches:
            pred, score = [], []
            for low in range(0, b.num_rows, 64):
                some = [runs_of(t.as_py()) if langs else [] for t in b.column("text").slice(low, 64)]
                scores.learn({w for words in some for w in words})
                for words in some:
                    if not any(map(str.isalpha, words)) and not any(map(letters_in, words)):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    z = own["prior"] + scores.total(words)
                    best = int(z.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(z - z[best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``."""
    return predict(docs, train(docs, path)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
