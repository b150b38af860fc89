import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from tests.llm import brute
from trellis.llm import language_id, quality_rules


def test_run_against_brute_force(spark, sf, documents):
    """Quality and language have tests of their own; what they keep goes through the other stages the long way."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    ok = {r.doc_id for r in quality_rules.verdicts(documents).where("quality_report.kept").select("doc_id").collect()}
    passed = documents.where(documents.doc_id.isin(*ok))
    rows = [tuple(r) for r in language_id.recognised(passed).select("doc_id", "text").collect()]
    group = brute.components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if group[i] == i]
    bad = {r[0] for r in brute.contaminated(rows, items) if r[5]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i not in bad}
    got = P.run(spark, sf).collect()
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == want and 0 < len(bad) and len(rows) < len(group)


def test_stages_keep_columns_and_bear_empty_tables(spark, sf, documents):
    empty = documents.limit(0)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == documents.columns
    assert P.STAGES[-1][1](spark, empty, sf).count() == 0


def test_entry_registers_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
