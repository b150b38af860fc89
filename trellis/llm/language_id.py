"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled passages. A text is parsed from left to right into phrases,
each the longest match with the automaton's passages; with c phrases, log2(N) bits each for a reference of N
characters, the language that takes the fewest bits wins. Texts are lower-cased letters with one space for anything
else; they are parsed in blocks of 512 characters, which are walked side by side by numpy. Every text is read whole.

Learning uses a bounded sample: for each language the `passages` distinct labelled texts of least hash, and of each
`length` characters from a place that its hash picks. Reference memory is languages x passages x length; beyond
`most_languages` distinct labels the fit is refused. Rows with a null or empty language, a null id or without a letter
are not learned from, nor are held-out rows (crc32 of the id as text is a multiple of `folds`).

A text that is null or without a letter is `und`, score 0; so is every text if nothing can be learned. The score is the
margin 1 - fewest / second fewest bits (1 if there is one language). Ties go to the language first in order. Rows are
judged one by one, so ids may be null or repeated; extra columns are ignored, or kept by `identified`.

`recognised` also asks whether the winner fits at all: as many further labelled passages of each language, which the
automata do not hold, show how many bits a character its texts take, and a text of `LEAST` letters or more that takes
over `LOOSE` times the most of these is in no learned language. A language with too few labelled texts has no limit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import words as W

FOLDS, PASSAGES, LENGTH, MOST_LANGUAGES = 5, 64, 400, 200
BLOCK = 512
#: characters from which a text's bits a character are evidence, and how far beyond its language's own they may lie
LEAST, LOOSE = 64, 1.5
#: parts that the choice of passages is first made in
SALTS = 16
#: letters with a class of their own; further ones share SHARED classes by their code point
OWN, SHARED = 120, 32
UNKNOWN = "und"


def held_out(doc_id: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, passages: int = PASSAGES, length: int = LENGTH, most_languages: int = MOST_LANGUAGES) -> dict[str, list[str]]:
    """Passages by language."""
    return {name: found[:passages] for name, found in labelled_passages(documents, doc_id, text, lang, folds, passages, length, most_languages).items()}


def labelled_passages(documents: DataFrame, doc_id: str, text: str, lang: str, folds: int, passages: int, length: int, most_languages: int) -> dict[str, list[str]]:
    """By language, passages of the `passages` distinct texts of least hash, in its order."""
    t, h = F.col("t"), F.col("h")
    labelled = documents.where(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(doc_id).isNotNull() & ~held_out(doc_id, folds) & F.col(text).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    # first within parts of a language, so that what meets in one task is bounded however many tasks there were
    chosen = labelled.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= passages).drop("rank")
    names = labelled.select("lang").distinct().limit(most_languages + 1).count()
    if names > most_languages:
        raise ValueError(f"more than {most_languages} languages are labelled")
    at = F.lit(1) + F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length(t) - length + 1)).cast("int")
    found = labelled.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).select("lang", "h", F.substring(t, at, F.lit(length)).alias("passage")).dropDuplicates(["lang", "h"])  # languages * passages rows
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect()):
        out.setdefault(r.lang, []).append(r.passage)
    return out


class Alphabet:
    """Classes of characters: 0 anything but a letter, then letters of the passages, then shared ones."""

    def __init__(self, passages: dict[str, list[str]]) -> None:
        seen = Counter(c for ps in passages.values() for p in ps for c in p.lower() if c.isalpha())
        own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OWN]]
        code = np.arange(0x110000)
        letters = np.fromiter((chr(c).isalpha() for c in code), bool, len(code))
        self.of = np.where(letters, len(own) + 1 + code % SHARED, 0).astype(np.uint8)
        self.of[[ord(c) for c in own]] = np.arange(1, len(own) + 1)
        self.size = len(own) + 1 + SHARED

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all texts, one behind the other, and how many each has; runs of 0 and a 0 at the start are cut."""
        lows = [t.lower() for t in texts]
        upto = np.cumsum([0] + [len(t) for t in lows])
        raw = self.of[np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), "<u4")]
        before = np.zeros(len(raw), np.uint8)
        before[1:] = raw[:-1]
        begins = upto[:-1][upto[:-1] < len(raw)]
        before[begins] = 0
        keep = (raw != 0) | (before != 0)
        count = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=count[1:])
        return raw[keep], np.diff(count[upto])


def automaton(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of parts (none crosses from one part to the next) as a flat table: row 0 has
    none, row 1 is the start, 0 stands for no transition."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, longest = [0, 0], [0, 0]
    for part in parts:
        last = 1
        for c in part.tolist():
            q = nexts[last].get(c)
            if q is not None and longest[q] == longest[last] + 1:
                last = q
                continue
            if q is not None:
                clone = len(nexts)
                nexts.append(dict(nexts[q])), link.append(link[q]), longest.append(longest[last] + 1)
                link[q], p = clone, last
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                last = clone
                continue
            new, p = len(nexts), last
            nexts.append({}), link.append(1), longest.append(longest[last] + 1)
            while p and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p:
                q = nexts[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q])), link.append(link[q]), longest.append(longest[p] + 1)
                    link[q] = link[new] = clone
                    while p and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = new
    table = np.zeros((len(nexts), size), np.int32)
    for i, row in enumerate(nexts):
        if row:
            table[i, list(row)] = list(row.values())
    return table.ravel()


class Parser:
    def __init__(self, passages: dict[str, list[str]]) -> None:
        self.languages = sorted(passages)
        self.alphabet = Alphabet(passages)
        self.tables, self.bits = [], []
        for name in self.languages:
            parts = [self.alphabet.classes([p])[0] for p in passages[name]]
            self.tables.append(automaton(parts, self.alphabet.size))
            self.bits.append(math.log2(2 + sum(map(len, parts))))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        classes, sizes = self.alphabet.classes(texts)
        ends = np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = (ends - sizes)[of] + nth * BLOCK
        width = np.minimum(BLOCK, ends[of] - first)
        order = np.argsort(-width, kind="stable")
        of, first, width = of[order], first[order], width[order]
        live = np.searchsorted(-width, -np.arange(BLOCK), "left")  # blocks that have a character at each step
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        size = np.int32(self.alphabet.size)
        padded = np.concatenate([classes, np.zeros(BLOCK, np.uint8)])
        for k, table in enumerate(self.tables):
            start = table[size : 2 * size]
            state, found = np.zeros(len(of), np.int32), np.zeros(len(of), np.int32)
            for step in range(int(width[0]) if len(width) else 0):
                m = int(live[step])
                c = padded[first[:m] + step]
                got = table[state[:m] * size + c]
                fresh = got == 0
                found[:m] += fresh
                state[:m] = np.where(fresh, start[c], got)
            out[:, k] = np.bincount(of, found, len(texts)).astype(np.int64)
        return out

    def limits(self, further: dict[str, list[str]]) -> np.ndarray:
        """The most bits a character that a text of each language may take."""
        out = np.full(len(self.languages), np.inf)
        for k, name in enumerate(self.languages):
            if name in further:
                _, _, bits, sizes = self.judged(further[name])
                out[k] = LOOSE * bits[sizes >= LEAST].max() if (sizes >= LEAST).any() else np.inf
        return out

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the place of the winner among the languages, the score, bits a character, characters."""
        cost, sizes = self.phrases(texts) * np.array(self.bits), self.alphabet.classes(texts)[1]
        score = np.ones(len(texts))
        if len(self.languages) > 1:
            least = np.partition(cost, 1, axis=1)[:, :2]
            score = np.clip(1 - least[:, 0] / np.maximum(least[:, 1], 1e-9), 0, 1)
        return cost.argmin(1), score, cost.min(1) / np.maximum(sizes, 1), sizes

    def predict(self, texts: list[str | None], limits: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """Languages and scores; with limits, a text beyond that of its language is in none."""
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, score, bits, sizes = self.judged([t or "" for t in texts])
        if limits is not None:
            lettered &= (sizes < LEAST) | (bits <= limits[best])
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


_parsers: dict[int, Parser] = {}


def _parser(passages: dict[str, list[str]], key: int) -> Parser:
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(passages)
    return _parsers[key]


def _predicted(texts: pa.Array, parser: Parser, limits: np.ndarray | None = None) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for i, j, _, _ in W.chunks(texts):
        a, b = parser.predict(texts.slice(i, j - i).to_pylist(), limits)
        names += a
        scores += b.tolist()
    return names, scores


def identified(documents: DataFrame, passages: dict[str, list[str]], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with two more columns, whose names must be free."""
    if {pred, score} & {*documents.columns}:
        raise ValueError(f"{pred!r} or {score!r} is taken")
    shared = documents.sparkSession.sparkContext.broadcast(passages)
    at, key = documents.columns.index(text), hash(str(sorted(passages.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predicted(batch.column(at).cast(pa.string()), _parser(shared.value, key))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return documents.mapInArrow(run, StructType(documents.schema.fields[:]).add(pred, StringType()).add(score, DoubleType()))


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    passages = learn(documents, doc_id, text, lang, folds, **bounds)
    own = documents.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, folds).alias("held_out"), F.col(text).cast("string").alias("text"))
    return identified(own, passages).select("doc_id", "held_out", "lang_pred", "score")


def recognised(documents: DataFrame, least_score: float = 0.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, passages: int = PASSAGES, length: int = LENGTH, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """The documents in a learned language with at least that score, with their columns."""
    found = labelled_passages(documents, doc_id, text, lang, folds, 2 * passages, length, most_languages)
    own, further = ({name: ps[at] for name, ps in found.items()} for at in (slice(passages), slice(passages, None)))
    shared = documents.sparkSession.sparkContext.broadcast((own, further))
    at, key = documents.columns.index(text), hash(str(sorted(own.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, further = shared.value
        parser = _parser(own, key)
        limits = parser.limits(further) if own else None
        W.release()
        for batch in batches:
            names, scores = _predicted(batch.column(at).cast(pa.string()), parser, limits)
            yield batch.filter(pa.array([n != UNKNOWN and x >= least_score for n, x in zip(names, scores, strict=True)], pa.bool_()))
        W.release()

    return documents.mapInArrow(run, documents.schema)
