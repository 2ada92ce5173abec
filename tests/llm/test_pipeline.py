"""The pipeline's stages on the smallest tables, and registered queries."""

import os

import duckdb
import pytest

import brute
from millrace.llm import bpe, decontaminate, exact_dedup, jaccard_join, queries, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_their_operators_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "byte_bpe"]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    score = {r.id: r.score for r in toxicity.score(docs, toxicity.production_index(docs, labels)).collect()}
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == COLUMNS and ids(clean) == sorted(i for i, s in score.items() if s < 0.5)
    single = stages["exact_dedup"](spark, docs, sf_dir)
    assert single.columns == COLUMNS and ids(single) == sorted(r.id for r in exact_dedup.decide(docs, exact_dedup.fresh_index(spark)).where("kept").collect())
    apart = stages["jaccard_join"](spark, docs, sf_dir)
    groups = brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])
    assert apart.columns == COLUMNS and ids(apart) == sorted({g[2] for g in groups})
    unseen = stages["decontaminate"](spark, docs, sf_dir)
    marks = brute.decontaminate([(r.doc_id, r.text) for r in docs.limit(60).collect()], [(r.item_id, r.text) for r in items.collect()])
    assert unseen.columns == COLUMNS
    kept = set(ids(unseen))
    assert all((m[0] in kept) != m[5] for m in marks)
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < last.count() < len(score)
    assert bpe.production(docs.where("false")).count() == 0


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls everywhere, empty and long texts, repeated rows, columns named as the operators name theirs."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, digest string, keep_id string, __bad bigint, __gone bigint, score double, n bigint"
    rest = [None] * 3 + list(range(4, 6)) + [None] * 5
    texts = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "A B C D E F"), (None, None), (4, "x " * 20_000), (5, "a b c d e f!"), (None, "alone")]
    rows = [(i, t, *rest) for i, t in texts]
    odd = spark.createDataFrame(rows, kind)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        kept[name] = sorted(((r.doc_id or 0), (r.text or "")[:3]) for r in out.collect())
        assert stage(spark, odd.where("false"), sf_dir).count() == 0
    everything = sorted((i or 0, (t or "")[:3]) for i, t in texts)
    assert kept["toxicity"] == kept["decontaminate"] == everything
    assert kept["exact_dedup"] == [(0, "alo"), (2, ""), (3, "a b"), (4, "x x"), (5, "a b")]
    assert kept["jaccard_join"] == [x for x in everything if x[0] != 5]
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
        result = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert sorted(rows, key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_imports_without_this_subpackage(tmp_path):
    """What the driver does: the folders and the pipeline gone, the rest still imports and has its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, has, sql = said.stdout.split()
    assert int(n) > 100 and has == "False" and int(sql) > 100
