"""Nulls, repeats, long texts, empty tables and clashing column names in every operator and pipeline stage; the pipeline against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.llm import chat, decontaminate, embeddings, packing, quality, secrets, simhash, substrings, suffixes, tokens
from strandlake.llm.queries import vocabulary

R = random.Random(11)
WORDS = ["".join(R.choices("abcdefghij", k=R.randint(3, 9))) for _ in range(400)]
SMALL = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
NAMES = "row doc id code key node starts ends spans items host path logit_quality p_quality site_quality keep component distances part label sequence_id n_tokens salt _id _text none".split()


def prose(n):
    return " ".join(R.choices(WORDS, k=n))


SAME, ONCE = prose(80), prose(90)
LONG = prose(60_000)
ROWS = [(1, SAME), (1, SAME), (1, ONCE), (2, None), (None, None), (None, SAME), (None, prose(70)), (3, ""), (4, LONG), (5, "x " * 3), (None, prose(75)), (9, SAME)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", None if i == 3 else "web", len(t) if t else None) for i, t in ROWS], schema).repartition(3)
    return frame.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(3000)), (2, " ".join(ONCE.split()[:15])), (2, " ".join(ONCE.split()[:15])), (None, "zz yy xx"), (3, None), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")


def keys(rows):
    return Counter((r["doc_id"],) for r in rows)


IDS = Counter((i,) for i, _ in ROWS)


def unchanged(rows, names=NAMES):
    """No column of the caller's was overwritten."""
    return all(r[n] == f"own {n}" for r in rows for n in names)


def test_repeated_bytes(docs):
    got = suffixes.remove_repeats(docs, keep_text=True).collect()
    assert keys(got) == IDS
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    n = len(SAME.encode())
    # rows of one doc_id, or of none, keep what only they have
    assert sorted(by[1]) == sorted([(n, n, 1), (n, n, 1), (len(ONCE.encode()), 0, 0)]) and by[9] == [(n, n, 1)]
    assert sorted(by[None])[0] == (0, 0, 0) and sorted(x[1] for x in by[None]) == [0, 0, 0, n]
    assert by[2] == [(0, 0, 0)] and by[3] == [(0, 0, 0)] and by[4] == [(len(LONG), 0, 0)]
    assert all(r["kept"] is not None for r in got)


def test_earlier_words(docs):
    got = substrings.remove_earlier(docs, keep_text=True).collect()
    assert keys(got) == IDS
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    # no id comes first: its rows keep all, every other copy goes, of whatever row of its id
    assert sorted(by[None]) == [(0, 0), (70, 0), (75, 0), (80, 0)]
    assert sorted(by[1]) == [(80, 80), (80, 80), (90, 0)] and by[9] == [(80, 80)] and by[4] == [(60_000, 0)] and by[3] == [(0, 0)]


def test_rows_of_one_id_are_told_apart(spark):
    texts = [prose(60) for _ in range(3000)]
    for id_ in (5, None):
        frame = spark.createDataFrame([(id_, t) for t in texts], "doc_id long, text string")
        assert suffixes.remove_repeats(frame).agg(F.sum("n_removed")).first()[0] == 0
        assert substrings.remove_earlier(frame).agg(F.sum("n_removed")).first()[0] == 0


def test_fingerprints(docs):
    got = simhash.simhash_classes(docs).collect()
    assert keys(got) == IDS
    same = {r["component_id"] for r in got if r["doc_id"] in (9,)}
    assert same == {1} and {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}


def test_near_duplicates(docs):
    got = simhash.drop_near_duplicates(docs).collect()
    texts = Counter(r["text"] or "" for r in got)
    assert unchanged(got) and texts == Counter({t or "": 1 for _, t in ROWS})
    by = {r["text"] or "": r["doc_id"] for r in got}
    assert by[SAME] == 1 and by[""] == 2 and by[ONCE] == 1


def test_contamination(docs, bench):
    for max_words in (1_000_000, 50):
        got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.find_contamination(docs, bench, max_words=max_words).collect()}
        assert got[1, 90]["n_hit"] == 15 and got[1, 90]["n_items"] == 1 and got[1, 80]["n_hit"] == 0 and got[4, 60_000]["n_hit"] == 0
        assert got[1, 90]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
        clean = decontaminate.decontaminate(docs, bench, max_words=max_words).collect()
        assert unchanged(clean) and len(clean) == len(ROWS)
        cut = [r for r in clean if r["text"] and len(r["text"].split()) == 75 and r["doc_id"] == 1]
        assert len(cut) == 1 and cut[0]["n_chars"] == len(cut[0]["text"])
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_long_items_are_cut(spark):
    text = prose(50)
    words = decontaminate.words_of(text)
    found = decontaminate.sections(spark.createDataFrame([(1, text), (2, "a b")], "item_id long, text string"), 10, section=7).collect()
    windows = {tuple(p[i : i + 10]) for p in (bytes(r["text"]).split(b" ") for r in found if r["item"] == "1") for i in range(len(p) - 9)}
    assert windows == {tuple(words[i : i + 10]) for i in range(41)} and max(r["words"] for r in found) <= 16
    assert [(r["size"], bytes(r["text"])) for r in found if r["item"] == "2"] == [(2, b"a b")]


def test_secrets(docs):
    assert keys(secrets.scan_secrets(docs).collect()) == IDS
    got = secrets.redact_secrets(docs).collect()
    assert unchanged(got) and Counter(r["text"] for r in got) == Counter(t for _, t in ROWS)


def test_quality(docs, labels):
    got = quality.classify(docs, labels).collect()
    assert keys(got) == IDS and unchanged(got, [n for n in NAMES if n not in quality.RESULTS])
    assert all(isinstance(r["keep"], bool) and 0 <= r["p_quality"] <= 1 for r in got)
    twice = defaultdict(set)
    for r in got:
        twice[r["text"], r["source"]].add((r["p_quality"], r["p_toxic"]))
    assert all(len(x) == 1 for x in twice.values())
    good = quality.keep_good(docs, labels).collect()
    assert unchanged(good) and len(good) == sum(r["keep"] for r in got)


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 10, prose(20)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    seen = []
    kept = quality.fit
    monkeypatch.setattr(quality, "fit", lambda tokens, *a, **k: seen.append(len(tokens)) or kept(tokens, *a, **k))
    quality.fit_models(rows, labels)
    assert max(seen) <= 10


def test_packing(docs):
    got = packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    encoder = packing.Encoder.load(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, t in ROWS:
        want[i] += len(encoder.tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want


def test_token_counts(docs):
    counter = tokens.PrefixCounter.load(vocabulary("byte_bpe_50k.json"))
    got = tokens.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(counter.tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)


def test_long_white_space_takes_linear_time():
    counter = tokens.PrefixCounter.load(vocabulary("byte_bpe_50k.json"))
    for ch in (" ", "\n", "\t ", "　"):
        text = "x" + ch * (30_000 // len(ch)) + "y"
        assert counter.total(text) == len(counter.tok.encode(text, add_special_tokens=False).ids)


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (1, v, "a"), (2, [2.0, 4.0, 6.0], "a"), (3, [1e200, 2e200, 3e200], "a"), (4, [1e-200, 2e-200, 3e-200], "a"), (5, [1e200, 2.001e200, 3e200], "a"), (6, v, "b"), (None, v, "a"), (7, v, None), (8, None, "a"), (9, [float("inf"), 1.0, 1.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").select("*", *[F.lit("own").alias(n) for n in NAMES if n != "label"])
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_classes(frame).collect()}
    assert {(x[0], x[2]) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (None, None), (7, 7), (8, 8), (9, 9)}
    assert all(x[1] == 5 for x in got if x[0] in (2, 3, 4, 5)) and all(x[1] == 0 and x[3] for x in got if x[0] not in (1, 2, 3, 4, 5))
    whole = spark.createDataFrame([(1, v, 1 << 40), (2, v, 1 << 40), (3, v, 1)], "vec_id long, embedding array<double>, label long")
    assert {r["vec_id"]: r["component_id"] for r in embeddings.embedding_classes(whole).collect()} == {1: 1, 2: 1, 3: 3}
    assert embeddings.embedding_classes(frame.limit(0)).count() == 0


def test_codes_bound_what_is_near():
    r = np.random.default_rng(1)
    for dim in (3, 64, 100):
        a = r.standard_normal((200, dim))
        b = a + r.standard_normal((200, dim)) * r.choice([0.02, 0.1, 0.3], 200)[:, None]
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
        near = np.einsum("ij,ij->i", a, b) >= 0.98
        (ca, _, la), (cb, fb, lb) = (embeddings.encode(x, 0.98) for x in (a, b))
        apart = np.bitwise_count(ca ^ cb).sum(1)
        assert (apart[near] <= np.minimum(la, lb)[near]).all()
        assert embeddings.may_reach(a @ embeddings.rotation(dim).T, cb, fb, 0.98)[near].all() and 0 < near.sum() < 200


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, 0, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(n) for n in (*NAMES, "formatted", "n_turns")])
    got = chat.format_conversations(frame).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in got) == [("1", 3, 0), ("2", 1, len(LONG)), ("None", 1, 0), ("None", 1, 0)]
    assert all(r["reads_back"] for r in got) and chat.format_conversations(frame.limit(0)).count() == 0


def plain(frame):
    return frame.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="sample tables are not here")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, name, stage):
    got = stage(spark, plain(docs), SMALL)
    if name != "packing":
        assert got.columns == plain(docs).columns and unchanged(stage(spark, docs, SMALL).collect())
    assert 0 < got.count() and stage(spark, plain(docs).limit(0), SMALL).count() == 0


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="sample tables are not here")
def test_pipeline_is_its_stages_by_brute_force(spark):
    table = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet")
    judged = quality.classify(table("documents"), table("labels")).collect()
    left = sorted(((r["doc_id"], r["text"]) for r in judged if r["keep"]), key=lambda x: x[0])
    sets = [shingles(t or "") for _, t in left]
    up = list(range(len(left)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    left = [x for i, x in enumerate(left) if find(i) == i]
    windows = set()
    for r in table("benchmark").collect():
        w = decontaminate.words_of(r["text"] or "")
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    cleaned = []
    for i, text in left:
        w, hit = decontaminate.words_of(text), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) < 0.5 * len(w) or not hit:
            runs = []
            for k in sorted(hit):
                runs = [*runs[:-1], [runs[-1][0], k + 1]] if runs and runs[-1][1] == k else [*runs, [k, k + 1]]
            cleaned.append((i, decontaminate.remove_spans(text, runs) if runs else text))
    encoder = packing.Encoder.load(vocabulary("word_bpe_49k.json"))
    want = {i: len(encoder.tok.encode(secrets.redact(t, secrets.find_secrets(t)), add_special_tokens=False).ids) + 1 for i, t in cleaned}
    got = Counter()
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want and len(want) > 50
