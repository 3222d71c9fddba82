import random
import re
import string

import corpus_pipeline

from .conftest import DATA
from .test_pii import brute as brute_pii
from .test_simhash import brute_components, brute_fp


def test_stages_against_brute_force(spark, documents):
    """Each stage is judged on what the one before it kept."""
    columns = documents.columns
    rng = random.Random(5)
    noise = [(10**6 + i, "".join(rng.choices(string.ascii_letters + string.digits, k=400)), "en", "src1", 400) for i in range(5)]
    docs = documents.union(spark.createDataFrame(noise, documents.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, DATA)
        after = docs.collect()
        ids = [r["doc_id"] for r in after]
        if name == "language_id":
            assert set(ids) == {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"]) and r["doc_id"] < 10**6}
        elif name == "near_dedup":
            groups = brute_components([(r["doc_id"], brute_fp(r["text"])) for r in before])
            assert sorted(ids) == sorted({c for _, c in groups})
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(ids) == {r["doc_id"] for r in before if not any(t in r["text"] for t in items)}
        elif name == "pii":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert set(ids) == set(texts)
            for r in after:
                assert brute_pii(r["text"]) == ""
                if brute_pii(texts[r["doc_id"]]):
                    assert r["text"] != texts[r["doc_id"]] and "<" in r["text"]
        else:
            assert sorted(ids) == sorted(r["doc_id"] for r in before)
        if name != "bpe":
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, DATA).count() == len(ids)


def test_stages_take_clashing_columns(spark, clashing, nothing):
    for docs in (clashing, nothing):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, DATA)
            if name != "bpe":
                assert kept.columns == docs.columns
        kept.collect()
