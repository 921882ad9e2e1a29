"""The pipeline's stages on a small corpus with planted cases, and what each may change."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    docs, labels = [], []
    for i in range(400):
        text, junk, toxic = prose(rng.randrange(60, 120)), i % 10 == 3, i % 10 == 7
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = text.replace(" ", " zgrob ", 1).replace(" ", " zgrobian ", 5)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    passage = prose(70)
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, docs[2][1] + " more", "en", "s", 1), (1002, prose(30) + " " + passage + " " + prose(30), "en", "s", 1), (1003, prose(40) + " " + passage, "en", "s", 1), (1004, "", "en", "s", 0), (1005, None, None, None, None)]
    home = tmp_path_factory.mktemp("corpus")
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"}).to_parquet(f"{home}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(f"{home}/labels.parquet")
    return str(home), passage


def test_stages(spark, corpus):
    home, passage = corpus
    docs = spark.read.parquet(f"{home}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, home)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = kept["quality"]
    assert not any(i % 10 == 3 for i in first if i < 400) and sum(i % 10 != 3 for i in first if i < 400) == 360
    assert sum(i % 10 == 7 for i in kept["toxicity"] if i < 400) <= 4
    clean = {i for i in range(400) if i % 10 not in (3, 7)}
    assert clean <= set(kept["toxicity"])
    assert 1000 not in kept["near_duplicates"] and 1001 not in kept["near_duplicates"] and 1 in kept["near_duplicates"] and clean <= set(kept["near_duplicates"])
    last = kept["repeated_passages"]
    assert passage in last[1002] and passage not in last[1003]
    assert all(last[i] == kept["near_duplicates"][i] for i in clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, home)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).where("not whole").count() == 0
    assert pieces.select("doc_id").distinct().count() == len(last)


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_entry_lists_all_ten():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {name[: name.index("_") + 1] for name in names if name.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
