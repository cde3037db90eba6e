"""The corpus pipeline, each stage against brute force over what the stage before it kept."""

import os

import duckdb
import pytest

import corpus_pipeline as cp
from tabulant.llm import pieces, queries
from tabulant.llm.common import save, stage

from .test_line_dedup import BLANKS, brute_repeats_fast
from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, apply in cp.STAGES:
        out.append(stage(apply(spark, out[-1], SF), "test-pipeline"))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights",
                                         "SentencePiece encoding and decoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_toxicity_drops_what_the_operator_rejects(spark, stages):
    rejected = {r.doc_id for r in queries.op5_toxicity(spark, SF).collect() if r.predicted}
    assert rejected and rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in rejected]


def test_line_dedup(stages):
    before = {r.doc_id: r for r in stages[1].collect()}
    gone = brute_repeats_fast([(i, r.text) for i, r in before.items()], 2, 24)
    want = []
    for i, r in before.items():
        lines = r.text.split("\n")
        kept = [x for p, x in enumerate(lines) if (i, p) not in gone or len(x) < 24]
        changed = len(kept) < len(lines)
        text = "\n".join(kept)
        if not any((i, p) in gone for p in range(len(lines))) or any(x.strip(BLANKS) and (i, p) not in gone for p, x in enumerate(lines)):
            want.append((i, text, r.lang, r.source, len(text) if changed else r.n_chars))
    assert rows(stages[2]) == sorted(want)


def test_near_duplicates(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    groups = brute_components({i: brute_print(r.text) for i, r in before.items()}, 4)
    assert rows(stages[3]) == sorted(tuple(before[i]) for i in set(groups.values()))


def test_mixing(stages, tmp_path):
    stages[3].toPandas().to_parquet(tmp_path / "docs.parquet")
    con = duckdb.connect()
    con.execute(f"create view d0 as select * from '{tmp_path}/docs.parquet'")
    sql = queries.mix_oracle("d0", "doc_id, text, lang, source, n_chars", "coalesce(" + queries.WORDS_SQL.format("text") + ", 0)",
                             queries.MIX_PERCENT, queries.MIX_EPOCHS, queries.MIX_SEED)
    want = con.execute(sql + "select doc_id, text, lang, source, n_chars from mixed").fetchall()
    assert rows(stages[4]) == sorted(want)


def test_encoding(stages):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted((r.doc_id, tuple(sp.encode(r.text))) for r in stages[4].collect())
    got = stages[5].collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_run_is_the_stages_in_turn(spark, stages):
    assert rows(cp.run(spark, SF)) == rows(stages[-1])


def test_nothing_staged_is_left(spark, tmp_path, stages):
    """While it runs the pipeline keeps the last stage alone; once its rows are written, nothing."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    staged = lambda: {f for f in os.listdir(folder) if f.startswith("tabulant-")}
    before = staged()
    cp.write(spark, SF, str(tmp_path / "out"))
    assert staged() == before
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(stages[-1])
    left = cp.run(spark, SF)
    assert [f.rsplit("-", 1)[0] for f in staged() - before] == ["tabulant-pipeline-mixing"] and left.count() == stages[-1].count()


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))

    def make():
        stage(spark.range(5), "lost")
        raise KeyError("on purpose")

    with pytest.raises(KeyError):
        save(spark, make, str(tmp_path / "none"))
    assert set(os.listdir(folder)) == before


def test_stages_take_messy_and_empty_tables(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for some in (docs, docs.limit(0)):
        for name, apply in cp.STAGES:
            out = apply(spark, some, SF)
            n = out.count()
            assert n == 0 or some.count(), name
    kept = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sum(r.doc_id == 7 for r in kept) == 0 and sum(r.doc_id == 6 for r in kept) == 1
    assert sum(r.doc_id is None for r in kept) == 2
