import os
import random
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import brute
from trellis.llm import near_dup as N
from trellis.llm import words as W
from trellis.llm.queries import QUERIES
from trellis.storage import BATCH_BYTES, Scratch


def test_query_on_a_whole_table(spark, sf):
    got = QUERIES["op8_oph_near_dedup"](spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.components(rows, 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(brute.shingles(t, 3)), want[i], want[i] == i) for i, t in rows)


def test_chains_copies_and_edges(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, text = [], list(words)
    for i in range(40):  # a chain: neighbours are close, ends are not
        rows.append((i, " ".join(text)))
        for _ in range(3):
            text[rng.randrange(300)] = f"n{i}{rng.random()}"
    rows += [(100 + i, "The Same text  here") for i in range(50)] + [(150, "the same\ttext here\n")]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "ÉTÉ a b"), (207, "été a b"), (208, "z " * 20_000), (209, "z " * 20_001)]
    rows += [(300, "a b c d e f g h i j k"), (300, "quite something else altogether, told at some length")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    for k, percent in ((3, 85), (5, 80)):
        want = brute.components(rows, k, percent)
        got = N.near_duplicates(df, k, percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == want
    kept = N.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({i for i, c in brute.components(rows, 5, 80).items() if i == c})


def test_empty_and_null_ids(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("None", "None", True), ("None", "None", True)]


def test_members_that_miss_the_first_centre_are_linked(spark):
    """Pairs share a bucket with many texts that are like neither; every pair has to be found all the same."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(0, 60, 2):
        own = [f"o{i}x{j}" for j in range(60)]
        rows += [(i, " ".join(common + own)), (i + 1, " ".join(common + own[:-1] + [f"p{rng.random()}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 3, 85, bands=24, rows=6).collect()} == brute.components(rows, 3, 85)


def test_a_family_of_copies_with_edits_of_their_own(spark):
    """Copies at every distance from one text: some linked with it, some only with each other, some with a far relative."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        t = list(base)
        for _ in range(rng.randrange(1, 16)):
            t[rng.randrange(120)] = f"e{i}x{rng.random()}"
        rows.append((2 * i, " ".join(t)))
        if i % 5 == 0:  # a relative that has most of these edits
            t[rng.randrange(120)] = f"r{i}"
            rows.append((2 * i + 1, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent, how in ((3, 85, {}), (5, 80, {}), (2, 60, {"bands": 48, "rows": 3})):  # bands that miss no pair of that likeness
        assert {r.doc_id: r.component_id for r in N.near_duplicates(df, k, percent, **how).collect()} == brute.components(rows, k, percent)


def test_ids_of_other_types_and_clashing_columns(spark):
    rows = [("b", "a b c d e f", 1), ("a", "a b c d e f", 2), ("c", "x y z", 3), ("c", " ", 4), ("d", "other words", 5), ("d", None, 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _gone int")
    assert sorted({(r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}) == [("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "d", True)]
    kept = N.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["_gone"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_densification_keeps_similarity(spark):
    a, b = "one two three four", "one two three four five six"
    got = N.sketches(spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string"), 3, N.BANDS, N.ROWS, "doc_id", "text").collect()
    assert got[0].bands == got[1].bands and all(len(r.bands) == N.BANDS for r in got)


def test_long_texts_go_to_python_in_small_batches(spark):
    """10,000 rows, the default, would be one batch of all these."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, df = spark.conf.get(key, None), spark.range(0, 300, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    got = Scratch(spark, "batches").table(df.mapInArrow(run, "rows long, bytes long")).collect()
    assert sum(r.rows for r in got) == 300 and max(r.bytes for r in got) < 2 * BATCH_BYTES
    assert spark.conf.get(key, None) == before


def test_only_texts_that_may_go_are_shuffled(spark):
    """Of ids that are not in the bitmap, texts are kept without an exchange; ids in it by chance are kept after one."""
    rows = [(i, f"own words of {i} are here and nowhere else {i}", i) for i in range(300)] + [(i, "the same few words for all of these", i) for i in range(300, 310)] + [(None, "null", 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    gone = spark.createDataFrame([(i,) for i in range(301, 310)], "id long")
    near, may, added = N.marked(df, gone, "doc_id", "left")
    assert {r.doc_id for r in near.where(may).collect()} >= set(range(301, 310)) and near.where(may).count() < 20
    kept = N.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(r) for r in rows if r[0] is None or r[0] <= 300)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftAnti") == 1


def test_free_memory_goes_back():
    held = [bytes(1000) for _ in range(100_000)]
    most = int(Path("/proc/self/statm").read_text().split()[1])
    del held
    W.release()
    assert (most - int(Path("/proc/self/statm").read_text().split()[1])) * os.sysconf("SC_PAGE_SIZE") > 50_000_000
