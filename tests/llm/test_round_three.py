"""Prefix trie, substring removal and ranked search: brute force, odd inputs, small bounds."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, frame
from tests.llm.test_brute_force import SF
from vintagekit.llm import langid, mixing, queries, recurrent, search, toxicity, trie, windows
from vintagekit.llm.common import bounded_sample, documents

CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, _conv string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONVERSATIONS)


def plain_trie(rows):
    """Nodes by a dictionary of sequences."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(own[c])] for c in own}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    out = {}

    def walk(s):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        saved, leaves = (len(members[s]) - 1) * words, 0 if kids[s] else 1
        for child in kids[s]:
            a, b = walk(child)
            saved, leaves = saved + a, leaves + b
        out[s] = (members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids[s]),
                  leaves, saved, hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest())
        return saved, leaves

    if members:
        walk(())
    return sorted(out.values(), key=str)


def talk_rows(seed, n=60, longest=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for i in range(int(rng.integers(1, longest))):
            rows.append((c, i, "user" if i % 2 == 0 else "bot", "word " * int(rng.integers(0, 3)) + "x"))
    return rows


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie_against_a_dictionary(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SPAN", 2)
    rows = talk_rows(block) + [(70, i, "user", "same") for i in range(40)] + [
        (71, i, "user", "same") for i in range(40)] + [(60, i, "user", "same") for i in range(30)]
    got = trie.prefix_trie(talks(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_on_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "a", "x y"), (1, 0, "a", "x y"), (None, 0, "a", "z"),
            (2, 3, "a", ""), (2, 1, None, "t " * 5000), (40, 0, "q", "r"), (41, 0, "q", "r"), (41, 0, "b", "r")]
    got = trie.prefix_trie(talks(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)
    assert trie.prefix_trie(talks(spark, [])).collect() == []
    assert trie.prefix_trie(talks(spark, [(None, 0, "a", "b")])).collect() == []


def test_a_hot_conversation_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(5, i, "u", f"t{i % 3}") for i in range(500)] + [
        (c, i, "u", "copy copy") for c in range(100, 300) for i in range(3)]
    got = trie.prefix_trie(talks(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def plain_removal(rows, width=13):
    least = {}
    cut = [(i, t.encode().split() if t else []) for i, t in rows]
    for i, w in cut:
        for a in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[a:a + width])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - width + 1):
            if i is not None and least[tuple(w[a:a + width])] < i:
                gone.update(range(a, a + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passage_rows(seed):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"s{p}w{i}" for i in range(int(rng.integers(12, 30)))) for p in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 25)))) for _ in range(3)]
        rows.append((i, f"{parts[0]} {shared[i % 6]} {parts[1]}\n{shared[i * 7 % 6]}\t{parts[2]}"))
    return [*rows, *rows[:5], (None, rows[0][1]), (None, None), (200, ""), (201, rows[3][1])]


@pytest.mark.parametrize("chunk,bucket", [(1 << 24, 1 << 21), (400, 50)])
def test_removal_against_brute_force(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(windows, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(windows, "BUCKET_WINDOWS", bucket)
    rows = passage_rows(3)
    df = frame(spark, [(*r, "en", "a", 0) for r in rows])
    got = sorted((tuple(r) for r in windows.window_digest(df).collect()), key=str)
    assert got == plain_removal(rows)
    spans = windows.repeated_windows(df).collect()
    assert {(r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]),
             hashlib.sha256(r["kept"].encode()).hexdigest()) for r in spans} == {
        (r[0], r[2], r[3]) for r in plain_removal(rows)}
    for r in spans:  # intervals are maximal: words stand between them
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_removal_on_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in windows.window_digest(odd).collect()), key=str)
    assert got == plain_removal([(r[0], r[1]) for r in ODD])
    assert windows.window_digest(empty).collect() == []
    assert windows.repeated_windows(empty).collect() == []


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    high = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    low = rng.integers(0, 1 << 24, 500).astype(np.uint32)
    least = rng.integers(-5, 70, 500)
    back = windows.unpack(windows.pack(high, low, least))
    assert all((a == b).all() for a, b in zip(back, (high, low, least), strict=True))


def plain_search(docs, items, k=50):
    cut = [(i, [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())])
           for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    df = Counter(w for _, ws in cut for w in set(ws))
    out = []
    for item, text in items:
        terms = {w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())}
        scored = []
        for i, ws in cut:
            tf, score = Counter(ws), 0
            for t in terms & set(ws):
                m = 50 + (50 * len(ws) * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                    (10 ** 9 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows,span,block", [(1 << 15, 2048, 128), (37, 16, 4)])
def test_search_against_all_scores(spark, monkeypatch, rows, span, block):
    for name, v in (("SHARD_ROWS", rows), ("RANGE", span), ("BLOCK", block), ("QUERIES", 3)):
        monkeypatch.setattr(search, name, v)
    rng = np.random.default_rng(4)
    words = [f"Word{i}" for i in range(60)] + ["Été", "naïve"]
    docs = [(i, " ".join(words[min(int(x), 61)] for x in rng.exponential(9, int(rng.integers(0, 60)))) + ".")
            for i in range(300)]
    docs += [docs[5], docs[5], (None, docs[7][1]), (400, None), (401, "!!"), (402, "word1 " * 9000)]
    items = [(j, " ".join(rng.choice(words, int(rng.integers(1, 12))))) for j in range(12)]
    items += [(20, None), (21, ""), (22, "unseen"), (None, "word1 word2"), (3, "word5"), (3, "word5")]
    asked = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, rank string")
    index = search.build_index(frame(spark, [(*d, "en", "a", 0) for d in docs]))
    for k in (50, 5):
        got = search.search(index, asked, k=k).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_search(docs, items, k)


def test_search_on_odd_rows(spark, odd, empty):
    items = [(1, "same words"), (2, "one")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(search.build_index(odd), asked).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_search([(r[0], r[1]) for r in ODD], items)
    assert search.search(search.build_index(empty), asked).collect() == []
    assert search.search(search.build_index(odd), asked.limit(0)).collect() == []


def test_blocks_are_rejected_before_decompression(spark, monkeypatch):
    """The k-th score grows, and lists that cannot beat it alone are looked up in few blocks."""
    rng = np.random.default_rng(2)
    m = np.full(4000, 100, np.int64)
    shard = search.Shard()
    for i in range(4000):
        shard.add(i, " ".join(["rare"] * (i % 400 == 0) + ["often"] * int(rng.integers(0, 3)) + ["pad"]))
    rows = [r for b in shard.records(0, 4000, 8000) for r in b.to_pylist() if r["term"]]
    lists = {r["term"]: search.Postings(r, m) for r in rows}
    asked = []
    kept = search.Postings.decoded
    monkeypatch.setattr(search.Postings, "decoded", lambda self, blocks: (
        asked.append((self, len(blocks))), kept(self, blocks))[1])
    docs, scores = search.best_of([(9000, lists[b"rare"]), (10, lists[b"often"])], 4000, 3)
    assert len(docs) == 3 and (np.diff(scores) <= 0).all()
    often = sum(n for p, n in asked if p is lists[b"often"])
    assert often < len(lists[b"often"].last)


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 21, (1 << 28) + 5, (1 << 31) - 1])
    raw, size = search.varints(values)
    assert (search.numbers(raw) == values).all() and size.sum() == len(raw)


def test_bounded_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("IF(id < 2000, 7, id) AS doc_id")
    for rows in (0, 1, 500, 2999, 3000, 4999, 5000, 9000):
        got = bounded_sample(df, "doc_id", rows)
        n = got.count()
        assert n <= rows and (rows < 5000 or n == 5000)
        assert got.where("doc_id = 7").count() in (0, 2000)
    assert bounded_sample(df.limit(0), "doc_id", 10).count() == 0


def test_mixing_spreads_repeated_and_null_ids(spark):
    rows = [(None, "a " * (1 + i % 9), "en", "x", 0) for i in range(300)]
    rows += [(7, "b " * (1 + i % 5), "en", "y", 0) for i in range(200)]
    rows += [(100 + i, "c " * (1 + i % 7), "en", "z", 0) for i in range(60)]
    got = mixing.mix(frame(spark, rows), block=32).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in target)


def test_mix_stage_hits_its_targets_with_null_ids(spark):
    rows = [(None, f"w{i} " * (1 + i % 9), "en", "xyz"[i % 3], 0) for i in range(300)]
    rows += [(i % 5, f"v{i} " * (1 + i % 5), "fr", "xyz"[i % 3], 0) for i in range(60)]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    want = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    taken = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - want[s]) <= 9 for s in want)


@pytest.mark.parametrize("stage", ["reject_toxic", "drop_near_copies", "cut_repeats", "mix_sources", "pack"])
def test_stages_on_odd_and_empty_rows(spark, odd, empty, tmp_path, stage):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (7, 0, 1), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = getattr(corpus_pipeline, stage)
    for docs in (odd, empty):
        got = run(spark, docs.select(*corpus_pipeline.COLUMNS), str(tmp_path))
        n = got.count()
        if stage != "pack":
            assert got.columns == corpus_pipeline.COLUMNS
        assert n == 0 if docs is empty else n > 0


def test_toxicity_without_usable_labels(spark, odd):
    for labels in ([], [(2, 1)], [(2, 1), (9, 1)], [(2, 0), (9, 0)], [(5, 1), (6, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        clash = odd.withColumn("toxic", F.lit("clash")).withColumn("_id", F.lit(1))
        model = toxicity.fit(toxicity.labelled_sample(clash, table), rows=None)
        got = toxicity.score(clash, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_language_by_plain_backoff(spark):
    """Every prediction and score again, from dictionaries and loops."""
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in documents(spark, SF).collect()}
    counts = [defaultdict(Counter) for _ in range(6)]
    for i, (text, lang) in docs.items():
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            for w in langid.LETTERS.findall(text.lower()):
                counts[0][w][lang] += 1
                for n in range(1, 6):
                    for at in range(len(w) + 3 - n):
                        counts[n][f"<{w}>"[at:at + n]][lang] += 1
    langs = sorted({x for c in counts[0].values() for x in c})
    logs = []
    for n, table in enumerate(counts):
        most = langid.GRAMS_KEPT if n else langid.WORDS_KEPT
        kept = sorted(table, key=lambda g: (-sum(table[g].values()), g))[:most]
        total = {x: sum(table[g][x] + 0.5 for g in kept) + 0.5 for x in langs}
        logs.append({g: [math.log((table[g][x] + 0.5) / total[x]) for x in langs] for g in kept})

    def word(w):
        if w in logs[0]:
            return logs[0][w]
        for n in range(5, 0, -1):
            known = [logs[n][g] for g in langid.grams(w, n) if g in logs[n]]
            if known:
                return [sum(k[j] for k in known) / len(known) for j in range(len(langs))]
        return [0.0] * len(langs)

    for r in queries.op3_language_id(spark, SF).collect():
        text = docs[r["doc_id"]][0]
        words = langid.LETTERS.findall((text or "").lower())
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        found = [word(w) for w in words]
        mean = [sum(f[j] for f in found) / len(found) for j in range(len(langs))]
        best = max(range(len(langs)), key=lambda j: mean[j])
        share = sum(math.exp((m - mean[best]) * math.sqrt(len(words))) for m in mean)
        assert r["lang_pred"] == langs[best] and r["score"] == pytest.approx(1 / share, rel=1e-6)


def test_toxicity_scores_by_loops():
    """The pooled filters of a text, word by word, against the gathered table rows."""
    rng = np.random.default_rng(3)
    model = toxicity.Model.new(5)
    docs = [toxicity.hashed(" ".join(f"w{x}" for x in rng.integers(0, 40, n))) for n in (0, 1, 2, 17, 60)]
    got = model.scores(docs, model.tables())
    for doc, p in zip(docs, got, strict=True):
        rows = toxicity.rows_of(doc)
        words = [sum(model.embeddings[t][rows[t][i]] for t in rows) for i in range(len(doc))]
        words += [np.zeros(toxicity.DIM)] * (2 * max(toxicity.WIDTHS))
        pooled = []
        for w in toxicity.WIDTHS:
            every = [sum(words[i + j] @ model.filters[w][j] for j in range(w))
                     for i in range(len(doc) + max(toxicity.WIDTHS))]
            pooled.append(np.max(every, axis=0))
        h = np.maximum(np.concatenate(pooled) + model.bias, 0)
        assert p == pytest.approx(1 / (1 + math.exp(-(h @ model.out + model.out_bias))), rel=1e-4)


def test_network_scores_word_by_word():
    """Windows, texts side by side and carried states against one word after another."""
    rng = np.random.default_rng(8)
    net = recurrent.Network.new(recurrent.Counts(50, 3, {b"": 20, b"a": 20, b"b": 10}))
    for k in net.p:
        net.p[k] = (net.p[k] + rng.standard_normal(net.p[k].shape) * 0.1).astype(np.float32)
    texts = [rng.integers(0, 1600, n) for n in (1, 2, 33, 70, 64, 5)]
    for text, got in zip(texts, net.score(texts), strict=True):
        h, total, before = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0, 0
        for x in text:
            h = net.step(net.p["e"][[before]] @ net.p["wx"] + net.p["b"], h)[4]
            total += float(net.log_likelihood(h, np.array([x]))[0])
            before = x
        assert got == pytest.approx(total / math.log(10), rel=1e-4)
