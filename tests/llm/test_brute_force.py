"""Operators that SQL cannot express, against plain Python over the small tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests import oracle
from tests.llm.conftest import frame
from vintagekit.llm import audio, mixing, packing, queries, recurrent, simhash, suffix
from vintagekit.llm.common import documents, words_of
from vintagekit.llm.components import connected
from vintagekit.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.SQL[name]) is None


def test_language_model(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, SF).collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words, r = [*words_of(t), b""], rows[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    counts = recurrent.Counts(50, 3, {b"": 20, b"a": 20, b"b": 10})
    net = recurrent.Network.new(counts)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64) + rng.standard_normal(net.p[k].shape) * 0.1
    given, targets = rng.integers(0, 1600, (5, 3)), rng.integers(0, 1600, (5, 3))
    real = np.ones((5, 3), bool)
    real[3:, 1] = False
    h0 = rng.standard_normal((3, recurrent.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(5):
            x = net.p["e"][given[t]] @ net.p["wx"] + net.p["b"]
            h = np.where(real[t][:, None], net.step(x, h)[4], h)
            total -= net.log_likelihood(h, targets[t])[real[t]].sum()
        return total / real.sum()

    grads, _ = net.gradients(given, targets, real, h0)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-5
        up = loss()
        net.p[name][at] = kept - 1e-5
        down = loss()
        net.p[name][at] = kept
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-4, abs_tol=1e-7), name


def test_probabilities_sum_to_one():
    net = recurrent.Network.new(recurrent.Counts(50, 3, {b"": 20, b"a": 20, b"b": 10}))
    h = np.random.default_rng(2).standard_normal((1, recurrent.HIDDEN)).repeat(1600, axis=0)
    assert math.isclose(np.exp(net.log_likelihood(h, np.arange(1600))).sum(), 1, rel_tol=1e-4)


def plain_fingerprint(words):
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_simhash_near_dedup(spark, SF).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(words_of(texts[i])) for i in ids]
    links = simhash.Links(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                links.join(a, b)
    for k, i in enumerate(ids):
        assert rows[i]["fingerprint"] == f"{prints[k]:016x}"
        assert rows[i]["component_id"] == ids[links.find(k)]


def test_simhash_splits_hot_buckets(spark):
    rng = np.random.default_rng(3)
    base = 0x0123456789ABCDEF
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))}
    near |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    roots = {r["node"]: r["root"] for r in connected(simhash.linked(df, split=16)).collect()}
    values = sorted(near)
    links = simhash.Links(len(values))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                links.join(a, b)
    assert {v: values[links.find(i)] for i, v in enumerate(values)} == {v: roots.get(v, v) for v in values}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 90), (90, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 41), 90]}, 101: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def covered(texts, least):
    seen, all_, later = defaultdict(list), defaultdict(set), defaultdict(set)
    for i in sorted(texts):
        w = words_of(texts[i])
        for s in range(len(w) - least + 1):
            seen[tuple(w[s:s + least])].append((i, s))
    for places in seen.values():
        for n, (i, s) in enumerate(places if len(places) > 1 else ()):
            all_[i].update(range(s, s + least))
            if n:
                later[i].update(range(s, s + least))
    return all_, later


def test_suffix_arrays(spark, texts):
    all_, later = covered(texts, 50)
    got, cut = defaultdict(set), Counter()
    for r in queries.op4_suffix_array_dedup(spark, SF).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        cut[r["doc_id"]] += r["cut_words"]
    assert got == all_ and +cut == +Counter({i: len(s) for i, s in later.items()})


def test_cut_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"Ein {passage} ende", None, None, 1), (2, f"Zwei\n{passage}\nschluss", None, None, 1),
            (3, passage, None, None, 1), (4, "nothing here", None, None, 1)]
    got = {r["doc_id"]: (r["text"], r["_cut"]) for r in suffix.without_repeats(frame(spark, rows)).collect()}
    assert got == {1: (rows[0][1], False), 2: ("Zwei\nschluss", True), 3: ("", True),
                   4: ("nothing here", False)}


def test_language_held_out(spark):
    rows = queries.op3_language_id(spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id")
    held = [r for r in rows.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = queries.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic = np.array([r["score"] for r in held if r["toxic"] == 1])
    clean = np.array([r["score"] for r in held if r["toxic"] == 0])
    assert (toxic[:, None] > clean[None]).mean() > 0.85


def test_mixing(spark, texts):
    rows = mixing.mix(documents(spark, SF)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(words_of(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    level, open_ = sum(sizes.values()), set(order)
    want = {}
    while True:
        share = level / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            level -= want[s]
        open_ -= full
    want |= {s: share * weight[s] for s in open_}
    for s in order:
        assert math.isclose(target[s], want[s])
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= largest
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(documents(spark, SF)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixing_levels(spark):
    rows = [(i, "w " * (i * 37 % 211), None, "s" if i % 3 else "t", 0) for i in range(700)]
    got = mixing.mix(frame(spark, rows), block=64).collect()
    for s in "st":
        part = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 211


def test_packing_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    odd = ["", " a", "a ", "a  b", "a \n b\n\n  c", "x<|endoftext|> y <|endoftext|>z", "don't we'll 12 a1 $$",
           "日本 語テ スト", " x y\t", "word " * 9000, "x" * 5000]
    texts |= {-i - 1: t for i, t in enumerate(odd)}
    df = frame(spark, [(i, t, None, None, 0) for i, t in texts.items()])
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
           for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, path, stretch=4096).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, want in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        total += at
    assert padding < 0.05 * total


def test_windows_are_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        pos = np.unique(np.concatenate(([0], rng.integers(1, 90, 25), np.arange(0, 100, 12))))
        penalty = rng.integers(0, 9, len(pos))
        best = {int(pos[0]): 0}
        for j in range(1, len(pos)):
            best[int(pos[j])] = min(
                best[int(p)] + int(penalty[j]) + min(
                    16 - d, packing.SHORT if d & (d - 1) == 0 and d < 16 else 16)
                for p in pos[:j] if (d := int(pos[j] - p)) <= 16)
        cost, at = 0, 0
        where = {int(p): int(c) for p, c in zip(pos, penalty, strict=True)}
        for cut in packing.windows(pos, penalty, 16):
            d = cut - at
            cost += where[cut] + min(16 - d, packing.SHORT if d & (d - 1) == 0 and d < 16 else 16)
            at = cut
        assert at == pos[-1] and cost == best[int(pos[-1])]


def test_audio_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = audio.fingerprints(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", audio.excerpt)
    prints = audio.fingerprints(vectors, "vec_id", "embedding", audio.melody)
    got = {(r["query_id"], r["match_id"]) for r in audio.align(asked, prints, "vec_id", top=1000).collect()}
    every = {r["vec_id"]: np.array(r["fp"], np.uint32) for r in prints.collect()}
    want = set()
    for q in asked.collect():
        a = np.array(q["fp"], np.uint32)
        for i, b in every.items():
            for o in range(-(len(a) // 2), len(b) - len(a) // 2 + 1):
                x, y = a[max(0, -o):], b[max(0, o):]
                n = min(len(x), len(y))
                if 2 * n >= min(len(a), len(b)) and \
                        np.bitwise_count(x[:n] ^ y[:n]).sum() <= audio.MAX_ERROR * 32 * n:
                    want.add((q["vec_id"], i))
    assert len(got & want) >= 0.9 * len(want) and len(want) >= 10


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark, SF)
    kept = {r["doc_id"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept and len(now) > 0.5 * len(kept), name
        kept = now
    rows = corpus_pipeline.run(spark, SF).agg(F.sum("length"), F.count("*")).first()
    assert rows[0] > 0 and rows[1] > 0


def test_network_in_columns_and_far_logits():
    """Streams as columns give the plain cell; softmax rows far from zero are as exact as near ones."""
    rng = np.random.default_rng(8)
    net = recurrent.Network(rng.normal(0, 0.3, sum(math.prod(s) for s in recurrent.Network.SHAPES.values())))
    x, h = rng.normal(0, 1, (7, 60)), rng.normal(0, 1, (7, 20))
    g = h @ net.p["u"]
    z, r = (1 / (1 + np.exp(-(x[:, a:a + 20] + g[:, a:a + 20]))) for a in (0, 20))
    n = np.tanh(x[:, 40:] + r * g[:, 40:])
    new = net.step_columns(x.T, h.T, net.p["u"].T)[4].T
    assert np.allclose(new, n + z * (h - n), atol=1e-6)
    for move in (0, 500, -500):
        rows = rng.normal(0, 2, (9, 40))
        at = rng.integers(0, 40, 9)
        want = rows[np.arange(9), at] - np.log(np.exp(rows).sum(axis=1))
        assert np.allclose(recurrent.log_chosen((rows + move).astype(np.float32), at), want, atol=1e-3)
