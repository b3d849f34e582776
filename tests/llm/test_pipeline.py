"""The pipeline over a small folder of documents, stage by stage."""

import random
import re

import pytest
from test_operators import PLAIN, brute_components, brute_lines, passes

import corpus_pipeline
from mensura.llm import packing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = {"en": "the and ing tion with is that".split(), "de": "der und ung keit mit ist das".split()}
    text = lambda la, n=120: " ".join("".join(rng.choice(words[la]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    base = rows[10][1]
    rows += [(100, base, "de", "s", 0), (101, base + " extra word", "de", "s", 0), (102, "123 !!", "en", "s", 0), (103, None, "en", "s", 0)]
    rows += [(104, "mail me at some.one@example.org now " + text("en"), "en", "s", 0)]
    notice = "\n".join(text("en", 8) for _ in range(4))
    rows += [(105 + i, f"{text('en')}\n{notice}\n{text('en')}", "en", "s", 0) for i in range(2)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        new = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert new.columns == docs.columns
        docs = new
        seen.append({r["doc_id"]: r for r in new.collect()})
    assert {102, 103} & set(seen[0]) == set() and len(seen[0]) == 65
    assert seen[1][105]["text"].count("\n") > seen[1][106]["text"].count("\n")
    assert 100 not in seen[2] and 101 not in seen[2] and 10 in seen[2]
    assert "[EMAIL]" in seen[3][104]["text"] and "@" not in seen[3][104]["text"] and seen[3][104]["n_chars"] == len(seen[3][104]["text"])
    # each stage against brute force over its own input
    said = lambda k: {i: r["text"] for i, r in seen[k].items()}
    left = {i: kept for (i, _), (_, gone, kept) in brute_lines([*said(0).items()]).items() if not gone or kept.strip()}
    assert said(1) == left
    assert set(seen[2]) == {i for i, _, c in brute_components([*left.items()]) if i == c} and said(2).items() <= left.items()
    assert set(seen[3]) == set(seen[2])
    for i, text in said(2).items():
        hits = [m for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
        assert (said(3)[i] == text) == (not hits) and not any(m[0] in said(3)[i] for m in hits)
    assert set(seen[4]) == set(seen[3])
    for i, r in seen[4].items():
        assert r["doc_tokens"] == len(packing.token_table(packing.default_model()).encode(seen[3][i]["text"])) // 4 + 1


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == packing.SCHEMA.names and out.count() > 60


def test_queries_are_complete():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
