"""Results that must be whole: what the registered queries and stages return, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from tests.llm.test_brute_force import SF
from vintagekit.llm import audio, nearcopies, queries, recurrent


def alignments(asked, prints):
    """(query, recording) pairs of all rows that lie within the error at some offset."""
    out = set()
    for q, a in asked.items():
        for i, b in prints.items():
            for o in range(-(len(a) // 2), len(b) - len(a) // 2 + 1):
                x, y = a[max(0, -o):], b[max(0, o):]
                n = min(len(x), len(y))
                if n and 2 * n >= min(len(a), len(b)) and \
                        np.bitwise_count(x[:n] ^ y[:n]).sum() <= audio.MAX_ERROR * 32 * n:
                    out.add((q, i))
                    break
    return out


def heard(rows, play):
    return {r["vec_id"]: audio.packed(audio.chroma(play(r["embedding"]))) for r in rows}


def near_copies(spark, folder, n=16):
    """A table with one melody and n - 1 near copies of it, each of another fingerprint."""
    base = np.array(spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id = 20").first()["embedding"])
    made = [(0, base.tolist())]
    for i in range(1, n):
        other = base.copy()
        other[-4 * (i % 3 + 1):] = np.roll(other[-4 * (i % 3 + 1):], i // 3 + 1) * (1 if i % 2 else -1)
        made.append((i, other.tolist()))
    spark.createDataFrame(made, "vec_id long, embedding array<double>") \
        .withColumn("embedding", F.col("embedding").cast("array<float>")) \
        .write.parquet(f"{folder}/embeddings.parquet")
    return spark.read.parquet(f"{folder}/embeddings.parquet").collect()


def test_audio_returns_every_alignment(spark, tmp_path):
    rows = near_copies(spark, str(tmp_path))
    want = alignments(heard([r for r in rows if r["vec_id"] % 20 == 0], audio.excerpt),
                      heard(rows, audio.melody))
    got = queries.op10_media_columns(spark, str(tmp_path)).where("match_id is not null").collect()
    assert len(want) > 5
    assert sum(r["match_copies"] for r in got) == len(want)


def expanded(rows):
    """Pairs of rows that the alignments of classes stand for."""
    of = {kind: {} for kind in ("query", "recording")}
    for r in rows:
        if r["kind"] in of:
            of[r["kind"]].setdefault(r["class_id"], []).append(r["id"])
    return [(q, i) for r in rows if r["kind"] == "alignment"
            for q in of["query"][r["query_id"]] for i in of["recording"][r["match_id"]]]


def test_audio_names_the_class_of_every_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    one, two = (rng.uniform(-0.7, 0.7, 64).tolist() for _ in range(2))
    made = [(i, one if i < 41 else two) for i in range(60)] + [(60, None)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op10_media_columns(spark, str(tmp_path)).collect()
    in_class = {(r["kind"], r["id"]): r["class_id"] for r in rows if r["kind"] != "alignment"}
    assert len(rows) - len([r for r in rows if r["kind"] == "alignment"]) == len(in_class) == 61 + 4
    assert all(in_class["recording", i] == (0 if i < 41 else 41) for i in range(60))
    assert in_class["recording", 60] is None and in_class["query", 60] is None
    assert {in_class["query", i] for i in (0, 20, 40)} == {0}
    assert {(q, i) for q, i in expanded(rows)} >= {(q, i) for q in (0, 20, 40) for i in range(41)}


def test_melodies_use_every_value():
    base = np.random.default_rng(4).uniform(-0.6, 0.6, 70)
    heard = audio.melody(base.tolist())
    for i in range(len(base)):
        other = base.copy()
        other[i] = -base[i] + (0.2 if base[i] < 0 else -0.2)
        changed = audio.melody(other.tolist())
        assert len(changed) == len(heard) and not np.array_equal(changed, heard), i


def test_registered_audio_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = alignments(heard([r for r in rows if r["vec_id"] % 20 == 0], audio.excerpt),
                      heard(rows, audio.melody))
    got = expanded(queries.op10_media_columns(spark, SF).collect())
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.95 * len(want) and len(want) >= 10


def test_network_learns_from_every_word():
    own = [b"w%d" % i for i in range(1000)]
    net = recurrent.Network.new(recurrent.Counts(2003, 1001, {w: 2 for w in own} | {b"": 3}))
    before = net.p["e"].copy()
    seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in net.p.items()}
    texts = [np.array([0, *range(1, 1001), 0]), np.array([0, 0]), np.array([0, *range(1000, 0, -1), 0])]
    assert net.fit(iter(texts), seen) == (3, 2003)
    assert (net.p["e"] != before).any(axis=1)[1:1001].all()
    assert net.fit(iter([]), seen) == (0, 0)


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    rows, want = [], 0
    for i in range(60):
        words = rng.choice(5000, 300).astype(str)
        rows.append((i, " ".join(words), "en", "a", 0))
        other = words.copy()
        other[rng.choice(300, 2 if i < 40 else 12, replace=False)] = "new"
        rows.append((1000 + i, " ".join(other), "en", "a", 0))
        a, b = (nearcopies.shingle_set(r[1]) for r in rows[-2:])
        want += len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b))
    docs = frame(spark, rows)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert 15 <= want <= 25
    assert len(kept) == 60 + want


def test_tiles_in_parts_link_the_same(spark):
    rng = np.random.default_rng(6)
    words = rng.choice(5000, 100).astype(str)
    rows = []
    for i in range(40):
        other = words.copy()
        other[i] = "new"
        rows.append((i, " ".join(other), "en", "a", 0))
    roots = nearcopies.near_copies(frame(spark, rows), "doc_id", split=8).collect()
    assert len(roots) == 40 and len({r["root"] for r in roots}) == 1


def test_stage_keeps_one_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    a, b = (" ".join(rng.choice(5000, 50).astype(str)) for _ in range(2))
    docs = frame(spark, [(7000, a, "en", "a", 0)] * 3 + [(None, b, "en", "a", 0)] * 3)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert len(kept) == 2 and kept.count(7000) == kept.count(None) == 1
