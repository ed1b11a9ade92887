"""The pipeline's rows against a brute-force version of each stage, and its stages' contracts."""

from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sievegrid.llm.quality_rules import quality_rules
from sievegrid.llm.queries import RANKS
from sievegrid.llm.secrets import find_secrets
from sievegrid.llm.tokens import Encoder
from sievegrid.session import stage, table
from tests.llm.test_llm import brute_components, brute_targets, words


def test_stages_one_after_another(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    good = stage(corpus_pipeline.keep_good(spark, docs, sf), "t")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == columns

    single = stage(corpus_pipeline.drop_near_copies(spark, good, sf), "t")
    groups = brute_components([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {c for _, c in groups.values()} and single.columns == columns

    masked = stage(corpus_pipeline.mask_secrets(spark, single, sf), "t")
    assert find_secrets(masked).where(F.size("base") > 0).count() == 0 and masked.count() == single.count() and masked.columns == columns

    mixed = stage(corpus_pipeline.mix(spark, masked, sf), "t")
    assert mixed.columns == columns
    sizes, took, times = Counter(), Counter(), Counter()
    texts = {r.doc_id: r for r in masked.collect()}
    for r in texts.values():
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        assert tuple(r) == tuple(texts[r.doc_id])
        took[r.source] += len(words(r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    want = brute_targets(sizes)
    longest = max(len(words(r.text)) for r in texts.values())
    assert all(abs(took[s] - want[s]) <= longest + 0.05 * want[s] for s in want)

    packed = corpus_pipeline.pack_lengths(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    encoder, tokens = Encoder(Path(RANKS).read_bytes()), {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.copy, r.piece)):
        tokens.setdefault((r.doc_id, r.copy), []).extend(np.frombuffer(r.tokens, "<u2").tolist())
    assert set(tokens) == {(d, k) for d, n in times.items() for k in range(1, n + 1)}
    assert all(ids == encoder.ids(texts[d].text) for (d, _), ids in tokens.items())


def test_run_is_the_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "secret scan", "mixing", "packing"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_documents_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "a b " * 80, "en", None, 5), (2, "a b " * 80, "en", None, 5), (None, "c d e f g h " * 3 + " ".join(f"w{i}" for i in range(90)), "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, ""), "odd")
    assert docs.count() >= 1


def test_rows_are_judged_by_themselves(spark):
    fine = " ".join(f"w{i}" for i in range(90))
    rows = [(None, "junk", "en", "x", 1), (None, fine, "en", "x", 1), (None, fine, "en", "x", 1), (7, fine + " end", "en", "x", 1), (7, "junk again", "en", "x", 1), (5, fine, "en", "x", 1), (7, "v " + " ".join(f"v{i}" for i in range(90)), "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.keep_good(spark, docs, "")  # not written: the next stage leaves what it reads
    assert Counter(map(tuple, good.collect())) == Counter(r for r in rows if len(r[1]) > 20)
    single = corpus_pipeline.drop_near_copies(spark, good, "")
    assert sorted((r.doc_id, r.text[:2]) for r in single.collect()) == [(5, "w0"), (7, "v ")]


def test_empty_documents_pass_through(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        empty = stage(f(spark, empty, ""), "odd")
    assert empty.count() == 0
