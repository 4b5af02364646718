"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from vintagekit.llm import (
    audio, langid, licenses, mixing, packing, quality, recurrent, simhash, suffix, toxicity,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lm(df):
    return recurrent.language_model_scores(df, F.lit(True))


def language(df):
    return langid.predict(df, langid.fit(df))


def toxic(df):
    labelled = df.withColumn("toxic", F.when(F.col("doc_id") == 4, 1).otherwise(0))
    return toxicity.score(df, toxicity.fit(labelled))


PER_ROW = {
    "lm": lm, "simhash": simhash.near_duplicates, "language": language, "mix": mixing.mix,
    "quality": quality.quality_digest, "licenses": licenses.license_digest, "toxic": toxic,
    "cut": lambda df: suffix.without_repeats(df),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_rows_survive(odd, empty, name):
    rows = PER_ROW[name](odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert PER_ROW[name](empty).collect() == []


def test_packing(odd, empty):
    rows = packing.pack(odd, PATH).collect()
    ends = [r for r in rows if r["doc_tokens"] == 1]
    assert len(ends) == 3 and sum(r["length"] for r in rows if r["start"] == 0) > 0
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert packing.pack(empty, PATH).collect() == []


def test_defined_results(odd):
    by = {(r["doc_id"], r["n_words"]): r for r in quality.quality_digest(odd).collect()}
    assert by[1, 0]["base_failed"] and not by[3, 0]["kept"]
    assert by[7, 20000]["n_repeat_words"] == 20000
    found = [r for r in language(odd).collect() if r["doc_id"] in (1, 2, 3, 5)]
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect() if r["doc_id"]}
    assert prints[1]["fingerprint"] == "0" * 16 and prints[3]["component_id"] == 1
    assert prints[9]["component_id"] == 4
    lm_rows = {r["doc_id"]: r for r in lm(odd).collect()}
    assert lm_rows[1]["n_tokens"] == 1 and lm_rows[7]["n_tokens"] == 20001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in lm_rows.values())


def test_audio(spark):
    df = spark.createDataFrame(
        [(1, None), (2, []), (3, [0.1] * 64), (3, [0.1] * 64), (4, [None, 0.3] * 8),
         (None, [float(i) / 64 for i in range(64)])], "vec_id long, embedding array<float>")
    prints = audio.fingerprints(df, "vec_id", "embedding", audio.melody)
    rows = audio.align(prints, prints, "vec_id").collect()
    assert all(r["bit_error"] == 0 and r["offset"] == 0 for r in rows if r["query_id"] == r["match_id"])
    assert {r["n_copies"] for r in rows if r["query_id"] == 3} == {2}
    none = prints.limit(0)
    assert audio.align(none, prints, "vec_id").collect() == []
    assert audio.align(prints, none, "vec_id").collect() == []
    assert len(audio.read_wav(b"not a wav")) == 0 and len(audio.read_wav(None)) == 0
