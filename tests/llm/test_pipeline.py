"""The pipeline's stages and the registered queries."""

import glob
import os

import duckdb
import pytest

from sightline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.common.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0.6 * n < docs.count() <= n
        n = docs.count()
    assert C.STAGES[-1][1](spark, docs, SF).count() == n
    assert C.run(spark, SF).count() == n


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want, got = con.execute(ORACLE[name]).fetchdf(), QUERIES[name](spark, SF).toPandas()
    flat = lambda d: d[sorted(d.columns)].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(sorted(d.columns)).values.tolist()
    assert [[x.removesuffix(".0") for x in r] for r in flat(want)] == [[x.removesuffix(".0") for x in r] for r in flat(got)]


def test_all_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, m string, t string, row string, x string, size string, hash string, copies string, marked string, stands string, words string, bad string, label string"


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, copies under other ids, ties of size, and columns with the operators' own names."""
    import numpy as np

    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    more = ("k", "m", "t", "r", "x", "s", "h", "c", "m", "s", "w", "b", "l")
    texts = [prose(40) for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), *more) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "a", 1, *more), (101, texts[3] + " end", None, "b", None, *more), rows[5], rows[5], (None, texts[7], None, None, None, *([None] * 13)), (None, None, None, None, None, *([None] * 13))]
    rows += [(102, "", "en", "a", 0, *more), (103, " \n\t", "en", "a", 3, *more), (104, None, "en", "b", 0, *more), (105, prose(60_000), "en", "a", 1, *more), (106, "one", "en", None, 1, *more)]
    return texts, spark.createDataFrame(rows, CLASHING)


def test_stages_on_odd_documents(spark):
    import corpus_pipeline as C

    texts, docs = odd_documents(spark)
    stages = dict(C.STAGES)
    kept = stages["toxicity"](spark, docs, SF).collect()
    assert len(kept) == docs.count()  # none of these words is in the labels' texts, so nothing is learnt against them
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    kept = stages["quality"](spark, docs, SF).collect()
    gone = [102, 103, 104, 106]  # fewer than ten words, as the row without any value
    assert ids(kept) == ids([r for r in docs.collect() if r["doc_id"] not in gone and r["text"] is not None])
    kept = stages["near_dedup"](spark, docs, SF).collect()
    # one of the repeated row, of the copies the least id, null last; rows without words all stay
    assert ids(kept) == sorted([(False, i) for i in range(30)] + [(False, i) for i in (102, 103, 104, 105, 106)] + [(True, 0)])
    mixed = stages["mixing"](spark, docs, SF)
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
    assert all(n <= 3 * (3 if k[0] == 5 else 1) for k, n in copies.items()) and copies[102, ""] == 1 and copies[104, None] == 1
    for name in ("toxicity", "quality", "near_dedup", "mixing"):
        assert stages[name](spark, docs, SF).columns == docs.columns
        assert stages[name](spark, docs.limit(0), SF).count() == 0
    coded = {(r["doc_id"], r["n_tokens"]) for r in stages["byte_bpe"](spark, docs, SF).collect()}
    assert {(102, 0), (104, 0), (None, 0)} <= coded and max(n for _, n in coded) > 60_000
    assert stages["byte_bpe"](spark, docs.limit(0), SF).count() == 0


def test_the_rest_works_without_the_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    (tmp_path / "sightline" / "llm").mkdir()
    (tmp_path / "sightline" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sightline" / "llm" / "queries.py").write_text("import no_such_dependency")
    assert subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, check=False).returncode  # what is missing inside is not hidden
