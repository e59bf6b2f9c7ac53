"""The pipeline: every stage on what the one before kept."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from flowtide.storage import materialise

from .helpers import SF, documents, prose

ROOT = Path(__file__).resolve().parents[2]


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30).replace("\n", " ")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [prose(rng, 200) for _ in range(12)]
    clean[0] = clean[0].replace("\n", " ")
    near = clean[0].split(" ")
    near[50] = "changed"
    lines = "\n".join(" ".join(prose(rng, 9).split()) for _ in range(30))
    texts = clean + [clean[1], " ".join(near), f"{prose(rng, 90)}\n{lines}", f"{prose(rng, 90)}\n{lines}\nlast line",
                     f"{prose(rng, 60)} {item} {prose(rng, 60)}", "too short", "a b c " * 40, None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(range(12)) <= set(kept[name])
    assert set(kept["quality rules"]) == set(range(17))
    lines_kept = kept["line dedup"]
    assert 12 not in lines_kept and lines_kept[14].text == texts[14] and len(lines_kept[15].text) < len(texts[15])
    assert all(r.n_chars == len(r.text) for r in lines_kept.values())
    assert 13 not in kept["n-gram Jaccard join"] and {14, 15, 16} <= set(kept["n-gram Jaccard join"])
    assert set(kept["benchmark decontamination"]) == set(range(12)) | {14, 15}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["benchmark decontamination"])


def test_a_cut_document_stays_with_its_remaining_text(spark):
    rng = random.Random(22)
    footer = "\n".join(" ".join(prose(rng, 6).split()) for _ in range(24))
    own = [" ".join(prose(rng, n).split()) for n in (60, 44, 20, 2)]
    texts = [f"{x}\n\n{footer}" for x in own] + [footer, footer]
    docs = documents(spark, texts)
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert {0, 1, 2, 3} <= set(cut) and 5 not in cut and cut[0].text == texts[0]
    for i in (1, 2, 3):
        assert cut[i].text.startswith(own[i]) and cut[i].n_chars == len(cut[i].text) < len(texts[i])


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_entry_works_without_this_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("flowtide", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "flowtide").mkdir()
    for p in (ROOT / "flowtide").iterdir():
        if p.name != "llm":
            (tmp_path / "flowtide" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
