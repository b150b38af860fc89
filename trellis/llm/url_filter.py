"""URL filters: domain and path rules, then a character language-model ratio.

Rules decide first, in built-in expressions: a rule fits its host and all subdomains if the path starts with the rule's;
the longest (host and path together, then host) wins. For the rest, two variable-order Markov models of characters with
Witten-Bell interpolation, one of accepted and one of rejected URLs, give log-likelihoods of host and path; their
difference by character is held against a threshold calibrated on a fifth of both sides, dealt by hash, that the models
have not seen.

Both models count all distinct URLs of their side. Characters are dealt to `CLASSES` classes and contexts of up to `ORDER`
of them are hashed to `CONTEXTS` rows, so a model has a fixed size, whatever the number of URLs; contexts that share a row
are counted together, and every row is a distribution. What is the same for both models, such as a character within its
class, is left out of the difference.

Where no URL is labelled, a URL is an example of the rejected side if its host has a word of `seeds`, which generalises from
those words to strings like them. `rejected`, a column of booleans, gives labels of one's own; null is no example.

A null url, or one without `://`, has an empty host and path and the difference 0; where no rule fits, it is allowed. Ids
may be null or repeated and are passed through; extra columns are ignored. With no example on either side the difference is
0 for all and URLs pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import words as W
from trellis.storage import Scratch

ORDER, CONTEXTS, CLASSES, FOLDS = 5, 1 << 15, 64, 5
#: share of held-out accepted URLs that may be lost, and of rejected ones that may pass
TAIL = 0.005
#: words of hosts nobody crawls for prose
SEEDS = ("casino", "poker", "pills", "pharma", "viagra", "porn", "xxx", "spam", "adult", "betting", "loans", "replica", "torrent", "warez")
_EDGE, _END = CLASSES - 1, CLASSES - 2


def _classes() -> np.ndarray:
    """Letters of either case, digits and the marks of URLs have classes of their own; other bytes share a dozen."""
    out = 50 + np.arange(256) % 12
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789-._~/%+=&:@,;!"):
        out[ord(c)] = out[ord(c.upper())] = i
    return out.astype(np.uint8)


_CLASS = _classes()


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def decided(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict), null where none fits; later tests are of shorter rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


class Markov:
    """p(class | classes before), interpolated over contexts of 0 to `order` classes, down to equal ones."""

    def __init__(self, counts: np.ndarray) -> None:
        """counts: how often each class came after each row of contexts."""
        self.counts = counts.astype(np.float32)
        self.totals, self.types = self.counts.sum(1), (self.counts > 0).sum(1).astype(np.float32)

    def log_p(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """rows: the context rows of each place, one column for each order."""
        p = np.full(len(classes), 1 / CLASSES)
        for k in range(rows.shape[1]):
            at = rows[:, k]
            total, types = self.totals[at], self.types[at]
            p = np.where(total > 0, (self.counts[at, classes] + types * p) / np.maximum(total + types, 1), p)
        return np.log(p)


def _runs(texts: list[str], size: int = 1 << 18) -> Iterator[list[str]]:
    """Texts in order, so many at once as have about that many characters together."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t) + 1
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def places(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context rows and class of every character of every text and of its end, and bounds of texts."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.full(int(bounds[-1]), _END, np.uint8)
    inside = np.ones(len(raw), bool)
    inside[bounds[1:] - 1] = False
    raw[inside] = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
    nth = np.arange(len(raw)) - np.repeat(bounds[:-1], sizes)
    rows, h = np.empty((len(raw), order + 1), np.int32), np.zeros(len(raw), np.uint64)
    for k in range(order + 1):
        if k:
            before = np.full(len(raw), _EDGE, np.uint8)
            before[k:] = raw[:-k] if k < len(raw) else raw[:0]
            h = h * np.uint64(CLASSES + 1) + np.where(nth >= k, before, _EDGE).astype(np.uint64) + np.uint64(1)
        rows[:, k] = (W.mix(h + np.uint64(k << 56)) % np.uint64(CONTEXTS)).astype(np.int32)
    return rows, raw.astype(np.int64), bounds


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    usable: bool
    threshold: float = 0.0

    def differences(self, texts: list[str]) -> np.ndarray:
        """By character and end, 0 for empty texts."""
        if not self.usable:
            return np.zeros(len(texts))
        out = [np.zeros(0)]
        for some in _runs(texts):
            rows, classes, bounds = places(some)
            each = self.accepted.log_p(rows, classes) - self.rejected.log_p(rows, classes)
            out.append(np.where(np.diff(bounds) > 1, np.add.reduceat(each, bounds[:-1]) / np.diff(bounds), 0.0))
        return np.concatenate(out)


def _counted(examples: DataFrame) -> dict[bool, np.ndarray]:
    """Counts of both sides from examples(text, bad); at most CONTEXTS * CLASSES numbers each are sent here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = np.array(batch.column(1).to_pylist(), bool)
            texts = np.array(batch.column(0).to_pylist(), object)
            for side in (False, True):
                for some in _runs(texts[bad == side].tolist()):
                    rows, classes, _ = places(some)
                    cell, n = np.unique(rows.astype(np.int64) * CLASSES + classes[:, None], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), side)), pa.array(cell), pa.array(n.astype(np.int64))], names=["bad", "cell", "n"])

    got = examples.mapInArrow(run, "bad boolean, cell long, n long").groupBy("bad", "cell").agg(F.sum("n").alias("n")).toArrow()
    bad, cell, n = (got.column(c).to_numpy() for c in ("bad", "cell", "n"))
    out = {}
    for side in (False, True):
        flat = np.zeros(CONTEXTS * CLASSES, np.float32)
        mine = bad.astype(bool) == side
        flat[cell[mine]] = n[mine]
        out[side] = flat.reshape(CONTEXTS, CLASSES)
    return out


def fit(examples: DataFrame) -> Ratio:
    """From examples(text, bad), each counted once. A text that is on both sides is on the rejected one."""
    once = examples.where("text <> '' AND bad IS NOT NULL").groupBy("text").agg(F.max("bad").alias("bad"))
    once = Scratch(examples.sparkSession, "url-filter").table(once.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0), "examples")
    n = {(r.bad, r.held): r.n for r in once.groupBy("bad", "held").agg(F.count("*").alias("n")).collect()}
    split = all(n.get((bad, held), 0) for bad in (False, True) for held in (False, True))
    counts = _counted((once.where("NOT held") if split else once).select("text", "bad"))
    usable = all(n.get((bad, False), 0) + n.get((bad, True), 0) for bad in (False, True))
    ratio = Ratio(Markov(counts[False]), Markov(counts[True]), usable)
    if usable:
        shared = once.sparkSession.sparkContext.broadcast(ratio)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(shared.value.differences(batch.column(0).to_pylist()))], names=["bad", "d"])

        of = (once.where("held") if split else once).select("text", "bad").mapInArrow(run, "bad boolean, d double")
        ends = of.agg(F.percentile_approx(F.when(~F.col("bad"), F.col("d")), TAIL, 100_000).alias("low"), F.percentile_approx(F.when(F.col("bad"), F.col("d")), 1 - TAIL, 100_000).alias("high")).first()
        # between the two if they lie apart, else where TAIL of the accepted would be lost
        ratio.threshold = (ends.low + ends.high) / 2 if ends.high < ends.low else ends.low
    return ratio


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rejected: Column | None = None, seeds: tuple[str, ...] = SEEDS, ratio: Ratio | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, difference (of the models)."""
    host, path = host_and_path(F.col(url))
    bad = host.rlike("|".join(seeds)) if rejected is None else rejected.cast("boolean")
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), bad.alias("bad"))
    ratio = ratio or fit(rows.select(F.concat("host", "path").alias("text"), "bad"))
    shared = pages.sparkSession.sparkContext.broadcast(ratio)
    kind = pages.schema[page_id].dataType.simpleString()
    rule, verdict = decided(F.col("host"), F.col("path"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            made = ratio.differences(texts)
            passes = [not t or not ratio.usable or d >= ratio.threshold for t, d in zip(texts, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made), pa.array(passes, pa.bool_())], names=["page_id", "host", "path", "difference", "passes"])

    out = rows.drop("bad").mapInArrow(run, f"page_id {kind}, host string, path string, difference double, passes boolean")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("passes"), "allow").otherwise("block")).alias("verdict"), "difference")
