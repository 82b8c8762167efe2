"""The corpus pipeline on a small corpus of planted cases, and the entry points with and without it."""

import importlib
import subprocess
import sys

import numpy as np
import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    folder = str(tmp_path_factory.mktemp("corpus"))
    syllables = {"aa": ["ka", "lo", "mi", "ta", "ra"], "bb": ["grü", "pf", "schö", "strö", "nz"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n)) + "."

    docs, labels = [], []
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        body = [text(lang, 12) for _ in range(5)]
        if i % 6 == 0:
            body[int(rng.integers(5))] += " vilesludge"
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, " ".join(body), lang, "s", 1))
    clean = [d for d in docs if d[0] % 6]
    item, plain = text("aa", 30), next(d for d in clean if d[2] == "aa")[1]  # of ASCII letters alone
    docs += [(1000, plain, "aa", "s", 1), (1001, plain.upper(), "aa", "s", 1), (1002, text("aa", 20) + " " + item + " " + text("aa", 20), "aa", "s", 1), (1003, "123 ... !!", None, "s", 1), (1004, None, "aa", "s", 1), (1005, text("bb", 2000), "bb", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, clean


def test_stages_drop_what_they_should_and_no_more(spark, corpus, tmp_path):
    import corpus_pipeline as P

    folder, docs, clean = corpus
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = now.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        if k < 4:
            assert now.columns == columns
    ids = {d[0] for d in docs}
    assert ids - kept["toxicity"] == {i for i in range(240) if i % 6 == 0}
    assert kept["toxicity"] - kept["language"] == {1003, 1004}
    assert kept["language"] - kept["near_duplicates"] == {1000, 1001}
    assert kept["near_duplicates"] - kept["decontamination"] == {1002}
    assert kept["packing"] == kept["decontamination"]


def test_run_applies_all_stages(spark, corpus):
    import corpus_pipeline as P

    folder, _, clean = corpus
    rows = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in clean} | {1005}
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_take_an_empty_corpus(spark, corpus):
    import corpus_pipeline as P

    folder, *_ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_keep_one_of_repeated_rows(spark, tmp_path):
    from quarry.llm.simhash_wide import keep_one

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (2, "x y z"), (None, None), (3, "")]
    shape = "doc_id long, text string, __place int, place int, row int, node int, id int, n int"  # names used inside
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], shape).repartition(3)  # not a table
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(1, "a b c d e f"), (2, "x y z"), (3, "")]))


def test_entry_lists_all_operators():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_entry_works_without_the_subpackage(tmp_path):
    """Names are read in a process in which the subpackage and the pipeline cannot be found."""
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('quarry.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op1_') for x in q) and len(q) > 90; e.oracle_sql()\n"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_near_duplicates_are_those_of_five_words_and_similarity(spark, tmp_path):
    """Pairs just over and just under 0.8, a chain, blanks and a text's capitals."""
    from corpus_pipeline import drop_near_duplicates

    rng, rows, want = np.random.default_rng(3), [], set()
    for k in range(0, 400, 10):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 104)]  # 100 shingles
        near = base[:-11] + [f"n{k}{i}" for i in range(11)]  # 89 shared of 111: 0.802
        chained = [f"c{k}{i}" for i in range(9)] + near[9:]  # 91 of 109 with near, fewer with base
        far = base[:-12] + [f"f{k}{i}" for i in range(12)]  # 88 shared of 112: 0.786
        rows += [(k, " ".join(base)), (k + 1, " ".join(near)), (k + 2, " ".join(chained)), (k + 3, " ".join(far)), (k + 4, " ".join(base).upper())]
        want |= {k, k + 3}
    rows += [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (None, "one two")]
    want |= {900, 902}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = [r["doc_id"] for r in drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_language_stage_lets_the_network_reject(spark, corpus):
    from pyspark.sql import functions as F

    from corpus_pipeline import drop_unknown_language

    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 240")
    rng = np.random.default_rng(4)
    noise = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(60))
    rows = [(2000, noise("bcdfghjklmnpqrstvwxz"), None, "s", 1), (2001, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "s", 1), (2002, noise("αβγδεζηθικλμν"), None, "s", 1), (2003, "123 !", None, "s", 1)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    assert {r["doc_id"] for r in drop_unknown_language(spark, both, folder).select("doc_id").collect()} == set(range(240))
    untold = both.withColumn("lang", F.lit(None).cast("string"))  # nothing to learn from
    assert {r["doc_id"] for r in drop_unknown_language(spark, untold, folder).select("doc_id").collect()} == {*range(240), 2000, 2001, 2002}
