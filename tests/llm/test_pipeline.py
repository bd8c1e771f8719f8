from __future__ import annotations

import re
import sys
from pathlib import Path

DATA = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    columns, counts = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, DATA), "t")
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.where("n_chars != length(text)").count() == 0
    assert counts == sorted(counts, reverse=True)
    ids = {r.doc_id for r in docs.collect()}
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 12]) for w in bench for i in range(len(w) - 11)}
    for r in docs.collect():
        words = re.findall(r"\S+", r.text.lower())
        assert len(words) >= 1 and not any(tuple(words[i : i + 12]) in grams for i in range(len(words) - 11))
    out = p.run(spark, DATA).collect()
    assert out and {r.doc_id for r in out} <= ids and all(r.copies >= 1 for r in out)


def test_registry_names():
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
