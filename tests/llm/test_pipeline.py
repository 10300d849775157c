"""The whole pipeline against plain Python over a small corpus."""

import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer
import public_tokenizers as P

import corpus_pipeline
from kadence.llm import pii_bootstrap, positive_unlabelled
from kadence.sources.staging import stage, staging_root
from tests.llm.samples import prose
from tests.llm.test_bottom_k import brute as brute_components
from tests.llm.test_host_rules import brute as brute_measures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id_ string, kept string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(21)
    rows = []
    for i in range(260):
        text = prose(i, draw.randrange(60, 200), 4000)
        if i % 7 == 0:
            text += f" nasty{i % 3}x vile{i % 5}x horrid{i % 2}x scum scum"
        if i % 11 == 1:
            text = rows[draw.randrange(len(rows))][1] if rows else text
        elif i % 11 == 2 and rows:
            words = (rows[draw.randrange(len(rows))][1] or "").split() or ["x"]
            words[draw.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 13 == 0:
            text += f" write to me{i}@mail.example.com or 10.0.0.{i % 255}"
        if i % 17 == 0:
            text = draw.choice(["too short", "a b c " * 60, None, ""])
        rows.append((i, text, "en", draw.choice(["a", "b", None]), len(text or "")))
    rows += [(300 + k, prose(900 + k, 20), "en", "spam", 0) for k in range(60)] + [(400, prose(77, 80), "en", "spam", 0)]
    rows += [rows[5], rows[5]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 0 and i % 17 != 0)) for i in range(0, 260, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, folder), f"test_{name}")
        yield docs


def test_stages_are_those_of_plain_python(spark, corpus):
    folder, rows = corpus
    got = list(stages(spark, folder))
    assert all(d.columns == spark.read.parquet(f"{folder}/documents.parquet").columns for d in got[:-1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = positive_unlabelled.learn_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    left = [r for r in rows if scorer(r[1] or "") < 0.5]
    assert sorted(r.doc_id for r in got[0].collect()) == sorted(r[0] for r in left)
    assert not {r[0] for r in left if r[1] and "scum" in r[1]} or len(left) > 200

    def base_fails(text):
        words, _, _, _, repeated = brute_measures(text)
        return words < 50 or 100 * repeated > 50 * words

    left = [r for r in left if not base_fails(r[1]) and r[3] != "spam"]
    assert sorted(r.doc_id for r in got[1].collect()) == sorted(r[0] for r in left)
    components = brute_components([(r[0], r[1]) for r in left])
    left = {r[0]: r for r in left if components[r[0]][1] == r[0]}
    assert sorted(r.doc_id for r in got[2].collect()) == sorted(left)
    redacted = {i: pii_bootstrap.redact_text(r[1], pii_bootstrap.base_spans(r[1])) for i, r in left.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in got[3].collect()} == {i: (t, len(t)) for i, t in redacted.items()}
    assert any("[EMAIL]" in t and "[IP]" in t for t in redacted.values())
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = got[4].collect()
    lengths = {}
    for r in pieces:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(t).ids) + 1 for i, t in redacted.items()}
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and np.mean(list(ends.values())) > 0


def test_run_gives_the_last_stage(spark, corpus):
    folder, _ = corpus
    root = staging_root(spark).removeprefix("file://") + "/kadence"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    columns = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "ids_crc32"]
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == columns
    assert all(len(r.ids) == 4 * r.length for r in result.collect())
    # Of all that was written only the stages' results stay.
    left = [os.listdir(f"{root}/{new}") for new in set(os.listdir(root)) - before]
    assert sorted(left) == sorted([name] for name, _ in corpus_pipeline.STAGES)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
