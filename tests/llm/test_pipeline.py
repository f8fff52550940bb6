"""The corpus pipeline against brute-force versions of its decisions, and the entry module's guard."""

import hashlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__ as E
import corpus_pipeline as C
from frameprep.llm import byte_bpe, jaccard_join, queries
from frameprep.llm.common import staged, table
from tests.conftest import SF_SMALL
from tests.llm import fixtures as X
from tests.llm.test_operators import LOWER, brute_links


def test_stages_take_effect(spark):
    docs, seen = table(spark, SF_SMALL, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        docs = staged(stage(spark, docs, SF_SMALL), "test")
        rows = docs.collect()
        seen.append(rows)
        if k < 4:
            assert docs.columns == columns
    quality, exact, near, mixed, tokens = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF_SMALL, "labels").collect()}
    kept = {r["doc_id"] for r in quality}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.97
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.3
    best = {}
    for r in quality:
        t = (r["text"] or "").translate(LOWER)
        best[t] = max(best.get(t, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(best.values()) and len(exact) == len(best)
    classes = brute_links([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in near} == {c for _, c, _, _ in classes}
    texts = {r["doc_id"]: r["text"] or "" for r in near}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) == set(texts) and max(times.values()) > 1
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(queries.TOKENIZER)))
    for r in tokens:
        ids = np.array(enc.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["copies"] == times[r["doc_id"]]
    assert len(tokens) == len(texts)


def test_stages_on_awkward_and_empty_rows(spark):
    for rows in (None, []):
        docs = X.frame(spark, rows)
        for k, (_, stage) in enumerate(C.STAGES):
            docs = staged(stage(spark, docs, SF_SMALL), "test")
        assert docs.count() >= (20 if rows is None else 0)
    assert jaccard_join.THRESHOLD == 0.8 and jaccard_join.WORDS == 5


def test_every_operator_is_registered():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.ORACLE) <= set(E.oracle_sql())


def test_the_entry_module_works_without_the_folder(tmp_path):
    here = Path(E.__file__).resolve().parent
    (tmp_path / "frameprep").mkdir()
    for p in here.joinpath("frameprep").rglob("*.py"):
        to = tmp_path / p.relative_to(here)
        if "llm" not in p.parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text(Path(E.__file__).read_text())
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), set(E.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["False", "True"] and int(out.stdout.split()[0]) >= 89
