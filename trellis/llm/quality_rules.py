"""Quality rules: a threshold table compiled into one projection, in built-in expressions only.

Counts are taken of whole texts: words `[^\\x20\\x09-\\x0D]+`, code points in words, symbols, exclamation marks, stop
words, lines with a word, lines equal to an earlier one, and words in windows of five words found twice or more. The
base rules fail a text of fewer than 10 words or with more than 20 % repeated words; a rule of the table compares
`amount` to `per` times its bounds, for texts of `least_words` words and more. A text is kept if it fails neither.

Null is the empty text: no words, so the base fails. Ids are not looked at, so null ids, ties and repeated rows are
judged row by row. Columns of the input stay; the verdict is one struct column, whose name must not be taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STOP_WORDS = tuple(
    "the of and to in is it that this for on with as was be by at are from or an not have but which you he she they we "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le les et des en un du une que est pour qui dans par plus pas sur ne se ce il sont au avec son ou "
    "el los las y del que en una por con para su al lo como más pero sus le ya o este sí porque entre cuando".split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines")


@dataclass(frozen=True)
class Rule:
    name: str
    amount: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: bounds are loose on purpose: a rule is there for texts that no reader would call prose
TABLE = (
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("exclamation_ratio", "n_exclamations", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", low=2, least_words=100),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.4),
)


def _covered(placed: Column, k: int) -> Column:
    twice = F.filter(placed, lambda x, i: F.coalesce(F.get(placed, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(placed, i + 1)["w"] == x["w"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["at"]))
    return F.aggregate(
        at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + x + k - F.greatest(a["upto"], x)).alias("n"), (x + k).alias("upto")),
        lambda a: a["n"],
    )


def verdicts(documents: DataFrame, text: str = "text", table: tuple[Rule, ...] = TABLE, into: str = "quality_report", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The documents with a struct of counts, base_failed, failed (names of rules) and kept.

    The arrays of words and windows are columns of their own inside, so that each is made once for a text.
    """
    if into in documents.columns:
        raise ValueError(f"column {into!r} is taken")
    own, k = documents.columns, 5
    made = lambda x: f"{into} {x}"  # noqa: E731  names that no column of the input has: they start with a free one
    t, w, ln, h, m, p = (F.col(f"`{made(x)}`") for x in ("text", "words", "lines", "hashes", "counts", "placed"))
    one = documents.withColumn(made("text"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    two = one.withColumns({
        made("words"): F.filter(F.split(F.translate(t, SPACES, " " * len(SPACES)), " ", -1), lambda x: x != ""),
        made("lines"): F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""),
    })
    n = F.size(w)
    four = two.withColumns({
        made("hashes"): F.when(n > k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))),
        made("counts"): F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_exclamations"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        ),
    })
    # equal windows have equal hashes: only where hashes repeat are the windows themselves compared
    window = lambda i: F.struct(F.array_join(F.slice(w, i, k), " ").alias("w"), i.alias("at"))
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(F.sequence(F.lit(1), n - k + 1), window)))
    five = four.withColumn(made("placed"), placed)
    six = five.withColumn(made("counts"), F.struct(*(m[c].alias(c) for c in COUNTS), F.coalesce(_covered(p, k), F.lit(0).cast("long")).alias("n_repeat_words")))
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    failed = F.filter(F.array(*(F.when(_fails(r, m), F.lit(r.name)) for r in table)), lambda x: x.isNotNull()) if table else F.array().cast("array<string>")
    seven = six.select(*(F.col(f"`{c}`") for c in own), m.alias(made("counts")), base.alias(made("base")), failed.alias(made("failed")))
    # a filter on the verdict must not be pushed below: there, each word array would be built anew for each mention
    fence = F.monotonically_increasing_id() >= 0
    b, f = F.col(f"`{made('base')}`"), F.col(f"`{made('failed')}`")
    return seven.select(*(F.col(f"`{c}`") for c in own), F.struct(*(m[c].alias(c) for c in (*COUNTS, "n_repeat_words")), b.alias("base_failed"), f.alias("failed"), (~b & (F.size(f) == 0) & fence).alias("kept")).alias(into))


def _fails(r: Rule, m: Column) -> Column:
    of = m[r.per] if r.per else F.lit(1)
    bad = F.lit(False)
    if r.low is not None:
        bad = bad | (m[r.amount] < F.lit(float(r.low)) * of)
    if r.high is not None:
        bad = bad | (m[r.amount] > F.lit(float(r.high)) * of)
    return bad & (m["n_words"] >= r.least_words)


def passing(documents: DataFrame, text: str = "text", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """The documents that are kept, with their columns."""
    into = "quality_report"
    while into in documents.columns:
        into += "_"
    return verdicts(documents, text, table, into).where(F.col(into)["kept"]).drop(into)


def sql() -> str:
    """The same in DuckDB's SQL, over `documents`."""
    def bad(r: Rule) -> str:
        of = r.per or "1"
        parts = ([f"{r.amount} < {float(r.low)} * {of}"] if r.low is not None else []) + ([f"{r.amount} > {float(r.high)} * {of}"] if r.high is not None else [])
        return f"(n_words >= {r.least_words} AND ({' OR '.join(parts)}))"

    space, words = r"[\x20\x09-\x0D]", ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) x(j) GROUP BY r),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(replace(t, '!', '')) AS n_exclamations, len(list_filter(ws, lambda x: lower(x) IN ({words}))) AS n_stop_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(map(bad, TABLE))}) AS kept FROM b"""
