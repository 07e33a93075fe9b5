"""run() against a version in plain Python, stage by stage: which documents stay, what their texts become, their tokens."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evispark.llm import pii, quality_fm
from test_operators import brute_simhash, exhaustive_leaks

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def redacted(text, spans):
    """A text with each span replaced by its kind; of spans that overlap, the later one only loses its tail."""
    out, at = "", 0
    for start, end, kind in sorted(spans):
        out += text[at : max(start, at)] + (f"<{kind}>" if start >= at else "")
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark, tmp_path):
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = table("documents")
    # 1: the machine is learned once more, and scores by the pairs themselves instead of the sum of squares
    m, features = quality_fm.train(docs, table("labels")), quality_fm.Features()

    def score(r):
        ids, values = features(r.text, r.n_chars)
        v = values[:, None] * m.factors[ids]
        pairs = v @ v.T
        return 1 / (1 + np.exp(-(m.bias + values @ m.weights[ids] + np.triu(pairs, 1).sum())))

    rows = [r for r in docs.collect() if score(r) >= 0.7]
    kept = [{r.doc_id for r in rows}]
    # 5: one document of each component stays, that with the least doc_id
    found, _ = brute_simhash([(r.doc_id, r.text) for r in rows])
    first = {c for _, _, c in found}
    rows = [r for r in rows if r.doc_id in first]
    kept.append({r.doc_id for r in rows})
    # 9: documents with a window that is similar to an item go
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    leaks = {i for i, _ in exhaustive_leaks([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in leaks]
    kept.append({r.doc_id for r in rows})
    # 6: spans of the operator, cut out in plain Python
    left = spark.createDataFrame(rows, docs.schema)
    spans = {x.doc_id: [(int(a), int(b), k) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)] for x in pii.find(left).collect()}
    texts = {r.doc_id: redacted(r.text or "", spans[r.doc_id]) for r in rows}
    assert len(docs.collect()) > len(kept[0]) > len(kept[1]) >= len(kept[2]) > 0 and any(spans.values())

    out = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, out, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} == kept[min(i, 2)], name
    assert {r.doc_id: r.text or "" for r in out.collect()} == texts
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = t.encode(texts[i], add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string, `row` int, c0 int, t string, fp bigint, spans map<string,int>"


def run_on(spark, folder, rows):
    spark.createDataFrame(rows, ODD).write.parquet(str(folder / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_on_odd_and_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rest = ("clash", 1, 2, "t", 3, {"a": 1})
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars, *rest) for d in docs]
    odd = [None, "", " \n", "a", "\U0001f600 " * 400, "word " * 40_000]
    rows += [(10_000 + i, t, None, None, None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(None, docs[0].text, None, None, None, *rest), (None, None, None, None, None, *rest), rows[1], rows[1]]
    got = run_on(spark, tmp_path / "odd", rows)
    ids = [r.doc_id for r in got]
    # what is kept of the usual documents does not depend on the others, but for the near copies among them
    usual = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in rows} and len(set(ids) & usual) >= 0.9 * len(usual)
    assert all(r.n_tokens >= 0 and len(r.ids_sha256) == len(r.decoded_sha256) == 64 for r in got)
    assert run_on(spark, tmp_path / "none", []) == []
