import zlib

import numpy as np

import corpus_pipeline as C
from loomstone.llm import packing, quality_rules
from tests.llm import test_decontaminate as decon
from tests.llm import test_near_duplicates as near
from tests.llm import test_secrets as sec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def mask(t):
    import re

    spans = [(m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_stages_against_brute_force(spark, sf):
    assert [n for n, _ in C.STAGES] == ["quality rules", "near duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.op8_quality_rules(spark, sf).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = {c for _, c, _ in near.brute(rows)}
    rows = [r for r in rows if r[0] in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    joined = {i: " ".join(decon.tokens(x)) for i, x in items}
    leaked = {d for d, t in rows if any(x in " ".join(decon.tokens(t)) for x in joined.values())}
    rows = [(d, mask(t)) for d, t in rows if d not in leaked]

    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS, name
        docs = docs.cache()
        docs.count()
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    want = set()
    for d, t in rows:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want |= {(d, at // 2048, zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in C.run(spark, sf).collect()} == want
    docs.unpersist()
    assert sec.brute("")[1] == [0, 0, 0]
