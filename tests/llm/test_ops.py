"""Operators against brute force, library or round trip, on small tables and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusilade.llm import bpe, chat, covertree, jaccard, langid, media, mixing, quality, suffix, toxicity
from fusilade.llm.common import components, window_hash, words

SF = "/root/testdata/sf0.001"
PASSAGE = "the shared passage of quite a few words that stands in more than one document and is longer than fifty bytes"
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "word", "de", None), (5, "word", "de", "b"), (5, "word", "de", "b"),
    (6, f"start one {PASSAGE} end", "en", "a"), (7, f"other start {PASSAGE} and more", "fr", "b"), (8, "x" * 20000, "en", "a"),
    (9, "é日本<|endoftext|>don't 're  \x1c end", "ja", "c"), (10, f"start one {PASSAGE} end", "en", "a"), (None, "no id here at all", "en", "a"), (12, "ab " * 3000, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, held_out string, size long, target string, n_chars int, kept string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0.5, "x", 7, "t", 1, "k") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


# --- 1 and 6 ---------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, awkward, docs, module, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit(docs, labels)
    got = module.score(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert module.score(awkward.limit(0), model).count() == 0
    for empty in (module.fit(docs.limit(0), labels), module.fit(docs, labels.limit(0))):
        assert module.score(awkward, empty).count() == len(AWKWARD)


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for module, label, least in ((toxicity, "toxic", 0.97), (quality, "quality", 0.98)):
        learn, test = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
        got = module.score(test, module.fit(learn, labels)).join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("double").alias("ok")).agg(F.avg("ok")).first()[0]
        assert got >= least


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    s = toxicity.raw_score(toxicity.boost(x, y), x)
    assert ((s > 0) == y).mean() > 0.95
    xs, ys = toxicity.isotonic(s, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys.min() and ys.max() < 1


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    e, t, per = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.array([3, 2])
    m, pair, z = quality.forward_backward(e, t, per)
    want, wz, wp = np.zeros((5, 2)), 0.0, np.zeros((2, 2))
    for at, n in ((0, 3), (3, 2)):
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        p = np.array([np.exp(sum(e[at + i, s[i]] for i in range(n)) + sum(t[s[i], s[i + 1]] for i in range(n - 1))) for s in paths])
        wz += np.log(p.sum())
        for s, v in zip(paths, p / p.sum(), strict=True):
            for i in range(n):
                want[at + i, s[i]] += v
                if i:
                    wp[s[i - 1], s[i]] += v
    assert np.allclose(m, want) and np.isclose(z, wz) and np.allclose(pair, wp)


# --- 2 -----------------------------------------------------------------------------------------------------------------------------
def brute_suffix(rows, width=50):
    """Per row, in order: bytes, bytes removed, runs, digest of what is kept."""
    first, out = {}, []
    for i, t in sorted(rows):
        for k in range(len(t) - width + 1):
            first.setdefault(t[k : k + width], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if first[t[k : k + width]] < i:
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def removed(df, **options):
    return sorted(tuple(r) for r in suffix.dedup(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize(("pieces", "copies"), [(20_000, 1), (1, 1), (20_000, 2), (20_000, None)])
def test_suffix_equals_brute_force(spark, docs, awkward, monkeypatch, pieces, copies):
    monkeypatch.setattr(suffix, "SHARD_BLOCKS", pieces)  # 1: every seed is spread, windows meet by hash
    for df in (docs, awkward.where("doc_id is not null")):
        assert removed(df, copies=copies) == brute_suffix(texts_of(df))
    assert suffix.dedup(awkward).count() == len(AWKWARD)
    assert suffix.dedup(awkward.limit(0)).count() == 0


def test_suffix_with_ids_that_texts_share(spark):
    a, b = f"{PASSAGE} and then alpha beta gamma delta", " ".join(f"word{k}" for k in range(40))
    rows = [(3, a), (5, a), (5, b), (5, b), (5, f"{b} {a}"), (7, b[40:] + a), (7, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [(i, (t or "").encode()) for i, t in rows if i is not None]
    assert removed(df.where("doc_id is not null")) == brute_suffix(plain)
    assert suffix.dedup(df).where("doc_id is null and n_removed = 0").count() == 1


@pytest.mark.parametrize(("width", "seed"), [(50, 20), (51, 20), (400, 20), (30, 30), (31, 30)])
def test_suffix_of_other_widths(spark, width, seed):
    rng, words = random.Random(8), [f"w{k}" for k in range(30)]
    long = " ".join(rng.choice(words) for _ in range(400))
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + long[rng.randrange(600) :][: rng.randrange(900)] + "tail" * i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(df, width=width, seed=seed) == brute_suffix([(i, t.encode()) for i, t in rows], width)


def test_suffix_widths_that_cannot_be(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for width in (10, 70_000):
        with pytest.raises(ValueError, match="width"):
            suffix.dedup(df, width=width)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, a in ((1, 1), (60, 1), (200, 2), (700, 4), (2000, 250), (5000, 3)):
        t = rng.integers(0, a, n).astype(np.uint8)
        b, sa = t.tobytes(), suffix.suffix_array(t)
        assert list(sa) == sorted(range(n), key=lambda i: b[i:])
        plcp = suffix.permuted_lcp(t, sa)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            k = 0
            while k < 50 and max(i, j) + k < n and b[i + k] == b[j + k]:
                k += 1
            assert plcp[i] == k


def test_suffix_arrays_induce_once_a_level(monkeypatch):
    calls = []
    for name in ("_induce", "_induce_names"):
        monkeypatch.setattr(suffix, name, lambda t, *a, f=getattr(suffix, name): calls.append(len(t)) or f(t, *a))
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, a, n).astype(np.uint8) for n, a in ((300, 2), (3000, 3), (400, 256))]
    texts += [np.tile(texts[0], 5), np.repeat(texts[0], rng.integers(1, 20, 300)), np.zeros(300, np.uint8)]  # repeats, long runs
    for t in texts:
        b = t.tobytes()
        calls.clear()
        assert list(suffix.suffix_array(t)) == sorted(range(len(b)), key=lambda i: b[i:])
        assert len(set(calls)) == len(calls)  # a level's string is shorter than that of the level above


# --- 3 -----------------------------------------------------------------------------------------------------------------------------
def test_bpe_equals_library(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_MASK", 7)
    e, rng = bpe.Encoder(bpe.default_path()), random.Random(2)
    parts = ["a", "'", "'s", "'re", " ", "  ", "\n", "\t", "é", "1", "!", "...", "日本", " ", "\x85", "\x1c", "😀", "²", "<|endoftext|>", "<|endof", "word", " The", "don't", "́", "ǅ"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(150)))
        raw = t.encode()
        data = np.frombuffer(raw, np.uint8)
        got = e.encode([raw[p:q] for p, q in bpe.borders(data, np.array([0, len(data)]))[0]])
        ids = e.tok.encode(t, add_special_tokens=False).ids
        assert got == (",".join(map(str, ids)), e.tok.decode(ids, skip_special_tokens=False))


def test_bpe_with_another_file(spark, tmp_path):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    texts = ["Some Words <|startoftext|> here", "", "don't <a><ab> stop"]
    more = Tokenizer.from_file(bpe.default_path())
    more.add_tokens([AddedToken("<a>", normalized=False), AddedToken("<ab>", normalized=False)])
    more.save(str(tmp_path / "more.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "more.json")):
        tok = Tokenizer.from_file(path)
        got = {r.doc_id: list(r.token_ids) for r in bpe.encode(df, path=path).collect()}
        assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_bpe_frames(spark, awkward):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in AWKWARD:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in bpe.digests(awkward).collect()), key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))
    back = bpe.decode(bpe.encode(awkward)).select("text", "decoded", "n_tokens", F.size("token_ids").alias("n")).collect()
    assert all(r.decoded == (r.text or "") and r.n == r.n_tokens for r in back)
    assert bpe.digests(awkward.limit(0)).count() == 0
    del key


# --- 4 -----------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [8192, 25])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:40] + 0.1 * rng.normal(size=(40, 8)), x[:10], 3 * x[:5], x[:20] + 0.3 * rng.normal(size=(20, 8))])
    rows = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)]
    odd = [(900, None, "z"), (901, [0.0] * 8, "z"), (902, [float("nan")] * 8, "z"), (903, [None] * 8, "z"), (904, [], "z"), (905, [1.0, 2.0], "z"), (906, [float("inf")] * 8, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    for _ in range(len(u)):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(u)).min(1))
    assert {i: got[i][:2] for i in range(len(u))} == {i: (int(link[i].sum()), int(comp[i])) for i in range(len(u))}
    assert all(got[i] == (0, i, True) for i, _, _ in odd)
    assert covertree.near_duplicates(df.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------------------------
def brute_jaccard(rows, width=4, percent=85):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", t)]
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}
    link = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in link:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize(("light", "leaf"), [(16, 4096), (2, 3)])
def test_jaccard_equals_brute_force(spark, docs, awkward, monkeypatch, light, leaf):
    for name, value in (("LIGHT", light), ("LEAF", leaf)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
        near.append((1000 + i, " ".join(w)))
    made = spark.createDataFrame(near, "doc_id long, text string")
    for df in (docs, awkward.where("doc_id is not null"), made):
        got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in jaccard.near_duplicates(df).collect()]
        want = brute_jaccard(texts_of(df))
        assert len(got) == df.count() and all(want[i] == v for i, v in got)
    assert jaccard.near_duplicates(awkward.limit(0)).count() == 0
    assert jaccard.near_duplicates(awkward).count() == len(AWKWARD)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 200), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100}


# --- 7 -----------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("budget", "history"), [(1024, 2), (20, 2), (30, 0)])
def test_chat_reads_back(spark, budget, history):
    rng, rows = random.Random(5), []
    for c in range(30):
        for t in range(rng.randrange(1, 12)):
            role = "system" if t == 0 and c % 2 else ["user", "assistant", None, 'odd "role"\n>'][rng.randrange(4)]
            rows.append((c, t, role, rng.choice([None, "", chat.HOSTILE, "<turn 0 0 \"user\">\nx\n</turn>\n", "a b c " * rng.randrange(20), "\\"]), "z"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    w = chat.format_chat(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.digest(w).collect()}
    for c in range(30):
        turns = sorted((t, r or "", x or "") for i, t, r, x, _ in rows if i == c)
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in w.collect():
        assert r.n_tokens <= budget or r.first_turn == r.last_turn or r.first_turn == 0
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0
    shuffled = w.repartition(5, "window")
    assert {r.conv_id: r for r in chat.digest(shuffled).collect()} == got == {r.conv_id: r for r in chat.digest(w, in_order=True).collect()}
    if w.where("window > 0").count():
        with pytest.raises(Exception, match="should be"):
            chat.digest(w.where("window > 0")).collect()


# --- 8 -----------------------------------------------------------------------------------------------------------------------------
def test_language(spark, docs, awkward):
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.predict(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[2].score == 0 and odd[2].rejected
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(awkward.limit(0), model).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    t = mixing.targets([10, 10, 1000, 100])
    assert sum(t) == pytest.approx(1120) and t[0] == 30 and t[1] == 30 and all(a <= 3 * n for a, n in zip(t, [10, 10, 1000, 100], strict=True))


def test_splitting_tree_is_exact(spark):
    blocks = np.array([1000, 3, 0, 250])
    leaves = list(mixing.split_tree(0, 7, blocks, blocks * 0, 1))
    q = np.array([have for _, _, have, _ in sorted(leaves, key=lambda x: x[0])])
    assert (q.sum(0) == blocks).all() and (q >= 0).all() and np.ptp(q.sum(1)) <= 3
    assert all((start == q[:lo].sum(0)).all() for lo, _, _, start in leaves)
    # Subtrees give what the whole tree gives, wherever it is cut.
    parts = [leaf for lo, hi, have, start in mixing.split_tree(0, 7, blocks, blocks * 0, 1, 3) for leaf in mixing.split_tree(lo, hi, have, start, 1)]
    assert str(sorted(parts, key=lambda x: x[0])) == str(sorted(leaves, key=lambda x: x[0]))
    got = {(r["__s"], r.shard): (r.lo, r.hi) for r in mixing.quotas(spark, blocks, 7, 1).collect()}
    assert got == {(s, i): (int(q[:i, s].sum()), int(q[: i + 1, s].sum())) for i in range(7) for s in range(4) if q[i, s]}
    # The draws follow the multivariate hypergeometric law: the mean share of a source is its share of all.
    left = [next(iter(mixing.split_tree(0, 2, np.array([60, 40]), np.zeros(2), seed)))[2][0] for seed in range(2000)]
    assert np.mean(left) == pytest.approx(30, abs=0.3) and np.var(left) == pytest.approx(50 * 0.6 * 0.4 * 50 / 99, rel=0.15)


def test_mix_equals_a_plain_computation(spark, docs):
    """Passes, cut blocks, quotas and placements once more, with dictionaries, from the same hashes."""
    words, shard_words, seed = 500, 3000, mixing.SEED
    rows = docs.select("doc_id", "source", mixing.n_words("text").alias("size"))
    hashed = rows.select("*", *[F.xxhash64(F.lit(seed + k), "doc_id").alias(f"h{k}") for k in (0, 1)]).collect()
    names = sorted({r.source for r in hashed}, key=lambda n: (n is None, (n or "").encode()))
    sizes = [sum(r.size for r in hashed if r.source == n) for n in names]
    aims = mixing.targets(sizes)
    n_shards, copies, cut_rows = max(1, round(sum(sizes) / shard_words)), {}, {}
    spot = {}
    for s, (name, n, aim) in enumerate(zip(names, sizes, aims, strict=True)):
        n_blocks, passes = max(1, n // words), int(aim // n) if n else 0
        own = {}
        for r in hashed:
            if r.source == name:
                own.setdefault(r.h0 % n_blocks, []).append(r)
                spot[r.doc_id] = (s, r.h0 % n_blocks)
        keys = spark.createDataFrame([(s, b) for b in own], "s int, b long").select("b", F.xxhash64(F.lit(seed + 2), "s", "b").alias("h")).collect()
        left = aim - passes * n
        for b, _ in sorted(((k.b, k.h) for k in keys), key=lambda x: (x[1], x[0])):
            total = sum(r.size for r in own[b])
            times = passes + (1 if left > 0 else 0)
            if left > 0 and total > left:
                gap, taken = left, set()
                for r in sorted(own[b], key=lambda r: r.h1):
                    if r.size <= gap:
                        taken.add(r.doc_id)
                        gap -= r.size
                cut_rows[s, b] = (passes, taken)
            left -= total
            copies.update({(s, b, c): None for c in range(times)})
    listed = spark.createDataFrame(list(copies), "s int, b long, c int").select("s", "b", "c", F.xxhash64(F.lit(seed + 3), "s", "b", "c").alias("h")).collect()
    blocks = np.array([sum(r.s == s for r in listed) for s in range(len(names))])
    runs = {lo: (have, start) for lo, _, have, start in mixing.split_tree(0, n_shards, blocks, blocks * 0, seed)}
    for s in range(len(names)):
        order = sorted((r for r in listed if r.s == s), key=lambda r: (r.h, r.b, r.c))
        for shard, (have, start) in runs.items():
            for r in order[start[s] : start[s] + have[s]]:
                copies[r.s, r.b, r.c] = shard
    got = {r.doc_id: {p.copy: p.shard for p in r.placements} for r in mixing.plan(rows, block_words=words, shard_words=shard_words).collect()}
    for r in hashed:
        s, b = spot[r.doc_id]
        want = {c: shard for (i, j, c), shard in copies.items() if (i, j) == (s, b) and not ((s, b) in cut_rows and c >= cut_rows[s, b][0] and r.doc_id not in cut_rows[s, b][1])}
        assert got[r.doc_id] == want


def test_mixing(spark, docs, awkward):
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("size"))
    p = mixing.plan(sized, block_words=500, shard_words=3000).withColumn("copies", F.size("placements")).toPandas()
    assert len(p) == 200 and p.copies.max() <= 3
    by = p.assign(taken=p["size"] * p.copies).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    again = mixing.plan(sized, block_words=500, shard_words=3000).withColumn("copies", F.size("placements")).toPandas()
    assert p.set_index("doc_id").copies.to_dict() == again.set_index("doc_id").copies.to_dict()
    m = mixing.mixed(docs, block_words=500, shard_words=3000)
    assert m.columns == docs.columns and m.count() == p.copies.sum()
    assert mixing.mixed(awkward).columns == awkward.columns and mixing.mixed(awkward).count() > 0
    assert mixing.mixed(awkward.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------------------------
def plain_features(codes):
    """The stated features, a sample at a time."""
    x = []
    for c in codes:
        u = ~c & 0xFF
        m = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
        x.append(-m if u & 128 else m)
    crossed = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    return f"rms={rms:.3f};peak={max(map(abs, x))};zcr={crossed / len(x):.6f};mean={sum(x) / len(x):.3f};n={len(x)}"


def plain_wave(payload):
    """The bytes of a mu-law file, field by field."""
    n = lambda v, k: v.to_bytes(k, "little")
    fmt = n(7, 2) + n(1, 2) + n(8000, 4) + n(8000, 4) + n(1, 2) + n(8, 2) + n(0, 2)
    return b"RIFF" + n(4 + 8 + 18 + 8 + len(payload), 4) + b"WAVEfmt " + n(18, 4) + fmt + b"data" + n(len(payload), 4) + payload


def plain_ima(block):
    """One channel of a block of the format, a nibble at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            value = max(-32768, min(32767, value + (-d if nib & 8 else d)))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nib & 7]))
            out.append(value)
    return out


def test_audio_round_trip(spark, awkward):
    stored = media.to_audio(awkward, derived=True)
    got = media.digest(stored).collect()
    sha, want = lambda x: hashlib.sha256(x).hexdigest(), {}
    for r in AWKWARD:
        t = (r[1] or "").encode()
        p = t + b" " * ((-len(t)) % 192 or 192 * (not t))
        w = plain_wave(p)
        want.setdefault(r[0], (len(t), len(p), sha(p), zlib.crc32(p[-16:]), len(w), sha(w), plain_features(p)))
    assert len(got) == len(AWKWARD)
    assert all(want[r.doc_id] == tuple(r)[1:8] for r in got)
    for r in stored.collect():
        sound = media.read_wav(bytes(r.adpcm))
        blocks = [sound.data[k : k + sound.align] for k in range(0, len(sound.data), sound.align)]
        heard = [v for b in blocks for v in plain_ima(b)][: sound.samples]
        own = media.MULAW_PCM[np.frombuffer(media.read_wav(bytes(r.media)).data, np.uint8)]
        assert sound.samples == len(own) == len(heard)
        pcm = np.frombuffer(r.pcm, "<i2")
        assert list(pcm[::2]) == heard and len(pcm) == 2 * len(heard)
        assert all(v in (pytest.approx((a + b) / 2, abs=0.5),) for v, a, b in zip(pcm[1:-1:2].tolist(), heard, heard[1:], strict=False))
    assert media.digest(media.to_audio(awkward.limit(0), derived=True)).count() == 0
    for kind in (media.MULAW, media.ALAW, media.IMA):
        pcm = media.store_pcm(media.to_audio(awkward, kind=kind).withColumn("pcm", F.lit("clash"))).select("n_bytes", F.length("pcm").alias("n"), "pcm_rate").collect()
        assert all(r.n == 4 * (-(-max(r.n_bytes, 1) // 192) * 192) and r.pcm_rate == 16000 for r in pcm)


def test_media_that_cannot_be_read(spark):
    good = media.wav(b"abc", media.MULAW)
    broken = [None, b"", b"RIFF", b"not a wave file at all", media.wav(b"abc", rate=0), media.wav(b"abc", align=0), media.wav(b"abc", kind=85), media.wav(b"abcdefgh", media.IMA, align=0), good[:30], good[:40]]
    rows = [(i, 3, None if m is None else bytearray(m)) for i, m in enumerate([*broken, good])]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.digest(df).collect()}
    pcm = {r.doc_id: r for r in media.store_pcm(df).collect()}
    for i in range(len(broken)):
        assert got[i].payload_bytes is None and got[i].feature is None and pcm[i].pcm is None and pcm[i].pcm_rate is None
    assert got[len(broken)].payload_bytes == 3 and len(pcm[len(broken)].pcm) == 12


def test_companding_and_adpcm():
    assert media.MULAW_PCM[0xFF] == 0 and media.MULAW_PCM[0x00] == -32124 and media.MULAW_PCM[0x80] == 32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xAA] == 32256
    x = (8000 * np.sin(np.arange(505 * 4) / 9)).astype(np.int16)
    blocks = media.ima_encode(x)
    y = media.ima_decode(blocks).reshape(-1)
    assert np.abs(y.astype(int) - x)[100:].mean() < 400
    assert y.tolist() == [v for b in blocks for v in plain_ima(b.tobytes())]
    whole = media.wav(blocks.tobytes(), media.IMA, 8000, blocks.shape[1])
    pcm, rate = media.decode(whole)
    assert (pcm == y).all() and len(media.resample(pcm, rate, 16000)) == 2 * len(pcm)
    cut = media.wav(blocks.tobytes()[:-100], media.IMA, 8000, blocks.shape[1], len(x))
    assert (media.decode(cut)[0] == y[: len(y) - 200]).all()
    # Two channels: heads, then four bytes of each in turn; what is read is their mean.
    left, right = blocks[0], blocks[1]
    body = np.stack([left[4:].reshape(-1, 4), right[4:].reshape(-1, 4)], 1).reshape(-1)
    both = media.Wave(media.IMA, 2, 8000, 512, np.concatenate([left[:4], right[:4], body]).tobytes())
    assert (media.pcm_of([both])[0] == np.rint((y[:505].astype(float) + y[505:1010]) / 2)).all()
    stereo = media.Wave(media.PCM, 2, 8000, 4, np.array([1, 3, -5, 5], "<i2").tobytes())
    assert media.pcm_of([stereo])[0].tolist() == [2, 0]


# --- kernels -----------------------------------------------------------------------------------------------------------------------
def test_kernels():
    rng = np.random.default_rng(6)
    d = rng.integers(0, 4, 500).astype(np.uint8)
    h = window_hash(d, 20)
    seen = {}
    assert all(seen.setdefault(d[i : i + 20].tobytes(), h[i]) == h[i] for i in range(len(h)))
    assert len(set(seen.values())) == len(seen)
    s, e, row = words(np.frombuffer(b"ab c d e", np.uint8), np.array([0, 1, 4, 4, 8]))
    assert list(zip(s, e, row, strict=True)) == [(0, 1, 0), (1, 2, 1), (3, 4, 1), (5, 6, 3), (7, 8, 3)]
