"""Operators against brute force on small fixtures with nulls, empty and long texts, copies and extra columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrules.llm import chat_format, common, components, elias_fano, embedding_dedup, minhash_dedup, ngram_scoring, packing, pieces, quality_classifier, quality_rules, registry, suffix_dedup, toxicity

vocab = pytest.importorskip("public_tokenizers")
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double"


def prose(n):
    out = []
    for k in range(n):
        w = RNG.choice(WORDS)
        out.append(w + (". " if k % 9 == 8 else " ") + ("\n" if k % 40 == 39 else ""))
    return "".join(out).replace(" \n", "\n").strip()


def corpus():
    shared, long_ = prose(70), prose(3000)
    base = [prose(n) for n in (30, 80, 150, 300)]
    near = base[3].split(" ")
    texts = [None, "", " \n ", "one", "two words", "a b c d", *base, base[1], base[1], " ".join(near[:150] + ["odd"] + near[151:]), long_, long_ + " end",
             prose(40) + " " + shared + " " + prose(20), shared + " " + prose(90), prose(33) + "\n" + shared, "x " * 400, "日本語 テスト 🤗 é ñ", "sp  ace\n\n\tmix   <|endoftext|> a\0b",
             " ".join(prose(60).split(" ")[:50])]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None if t is None else len(t), "clash", 0.5) for k, t in enumerate(texts)]
    return [*rows, (None, base[2], "en", "s1", None, "clash", None), (3, "one", "en", "s3", 3, "clash", 0.5)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"
PACK = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


def words(t):
    return (t or "").encode().split()


def test_packing_round_trip_and_best_cuts(docs, rows, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocab.path(PACK[0]))
    for ranks in (None, vocab.path(PACK[1])):
        got = packing.pack(docs, vocab.path(PACK[0]), ranks, vocab.PATTERN, block_tokens=3000).collect()
        want = Counter()
        for r in rows:
            ids = coder.encode(r[1] or "", add_special_tokens=False).ids + [0]
            mine = [g for g in got if g["doc_id"] == r[0] and g["doc_tokens"] == len(ids)]
            for g in mine:
                piece = np.array(ids[g["start"] : g["start"] + g["length"]], "<u4")
                want[r[0], g["start"]] += len(piece) == g["length"] and zlib.crc32(piece.tobytes()) == g["ids_crc32"]
            assert sum(g["length"] for g in mine) % len(ids) == 0 and mine
        assert all(want.values())
        by = defaultdict(list)
        for g in got:
            by[g["sequence_id"]].append(g)
        for pieces_ in by.values():
            at = 0
            for g in sorted(pieces_, key=lambda g: g["offset"]):
                assert g["offset"] == at
                at += g["length"]
            assert at == pieces_[0]["sequence_length"] <= 1024
    assert packing.pack(empty, vocab.path(PACK[0])).count() == 0
    for _ in range(20):  # all cuts against all cuts
        points = np.unique(np.array([RNG.randint(1, 60) for _ in range(9)] + [60]))
        costs = np.array([RNG.choice([0.0, 1.0, 6.0]) for _ in points])

        def cost(cuts):
            a, total = 0, 0.0
            for c in cuts:
                n = c - a
                if n > 32:
                    return math.inf
                total += costs[list(points).index(c)] + 5 + (0 if n & (n - 1) == 0 else 32 - n)
                a = c
            return total

        inner, best = list(points[:-1]), math.inf
        for mask in range(1 << len(inner)):
            best = min(best, cost([p for k, p in enumerate(inner) if mask >> k & 1] + [points[-1]]))
        if best < math.inf:
            assert cost(packing.best_cuts(points, costs, 32, 5.0)) == best


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 5), (100, 90), (1000, 1 << 40), (500, 2**64 - 2)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        e = elias_fano.EliasFano.build(v)
        assert (e.access(np.arange(n)) == v).all()
        q = r.integers(0, top, 200, dtype=np.uint64)
        assert (e.successor(q, np.zeros(200, int), np.full(200, n)) == np.searchsorted(v, q)).all()


@pytest.mark.parametrize("shard_tokens", [10**6, 900])
def test_ngram_scores(docs, rows, empty, shard_tokens):
    toks = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c, b, starts = Counter(), Counter(), 0
    for (_, t), h in zip(toks, held):
        if not h:
            c.update(t)
            b.update(zip([0, *t[:-1]], t))
            starts += 1
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    p1 = lambda w: (c[w] - d) / n if w in c else d * v / n
    m = ngram_scoring.PRIOR
    want = Counter()
    for (i, t), h in zip(toks, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10((b[u, w] + m * p1(w)) / ((starts if u == 0 else c[u]) + m)) for u, w in zip([0, *t[:-1]], t))
        want[i, h, len(t), sum(w in c for w in t), n, round(base, 6), round(score, 1)] += 1
    got = ngram_scoring.score(docs, shard_tokens=shard_tokens).collect()
    assert Counter((g[0], g[1], g[2], g[3], g[4], round(g[5], 6), round(g[6], 1)) for g in got) == want
    assert ngram_scoring.score(empty).count() == 0
    seen = [w for w in c]
    total = sum((b["q", w] + m * p1(w)) / m for w in seen) + d * v / n
    assert abs(total - 1) < 1e-9  # the model's probabilities of all words add up


def test_sentencepiece_equals_the_library_and_round_trips(docs, rows, empty):
    import sentencepiece

    path = vocab.path("piece_bpe_32k.model")
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Coder(path)
    texts = [r[1] or "" for r in rows] + ["x" * 900, "日本語" * 300, "é\u0301\n\n" * 50, "  lead", "trail  ", "a\u2581b c"]
    for got, t in zip(coder.encode(texts), texts):
        assert got.tolist() == sp.encode(t)
        assert coder.decode(got) == t.replace("\u2581", " ")
        if t:
            marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
            enc, out = pieces.Encoder(coder.v), []
            for ch in marked[:500]:  # one character at a time
                out += enc.push(ch)
                assert len(enc.text) <= 200
            assert out + enc.finish() == coder.stream(marked[:500])
            assert coder.stream(marked) == got.tolist()
    assert all(g["round_trip"] for g in pieces.digests(docs, path).collect()) and pieces.digests(empty, path).count() == 0
    back = pieces.decode(pieces.encode(docs, path), path).collect()
    assert Counter((g[0], g[1]) for g in back) == Counter((r[0], r[1] or "") for r in rows)


def unigram_model(path, scored):
    """A model file of given pieces and scores, written by hand: nothing is trained."""
    import struct

    def field(n, value):
        if isinstance(value, float):
            return bytes([n << 3 | 5]) + struct.pack("<f", value)
        if isinstance(value, int):
            return number(n << 3) + number(value)
        return number(n << 3 | 2) + number(len(value)) + value

    def number(x):
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes(out) + bytes([x])

    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256)), *((p, s, 1) for p, s in scored)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in entries)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(data)
    return str(path)


def test_sentencepiece_unigram_sums_are_the_best(tmp_path, rows):
    import itertools

    import sentencepiece

    r = random.Random(5)
    joined = pieces.SPACE + " ".join(r0[1] or "" for r0 in rows[:10]).replace(" ", pieces.SPACE)
    parts = {joined[k : k + r.randint(2, 7)] for k in (r.randrange(len(joined)) for _ in range(400))}
    parts = sorted(p for p in parts if "\n" not in p and pieces.SPACE not in p[1:]) + [pieces.SPACE, *"abcdefg."]
    scored = [(p, -r.uniform(1, 9) * (1 if len(p) > 1 else 1.4)) for p in parts]
    path = unigram_model(tmp_path / "unigram.model", scored)
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Coder(path, "unigram")
    texts = [t for t in [r0[1] or "" for r0 in rows] + ["h" * 30, "日本"] if "  " not in t and "\0" not in t]
    for got, t in zip(coder.encode(texts), texts):
        assert got.tolist() == sp.encode(t)
        assert not t or coder.stream(pieces.SPACE + t.replace(" ", pieces.SPACE)) == got.tolist()
    table = dict(scored)
    for word in ("abcabc", "gfedcb", "abah"):
        marked, best = pieces.SPACE + word, -math.inf
        for cut in itertools.product((0, 1), repeat=len(marked) - 1):
            cuts = [0, *(k + 1 for k, c in enumerate(cut) if c), len(marked)]
            run = [marked[a:b] for a, b in zip(cuts, cuts[1:])]
            if all(p in table or len(p) == 1 for p in run):
                best = max(best, sum(table.get(p, coder.v.unknown) for p in run))
        ids = coder.stream(marked)
        assert abs(sum(coder.v.unknown if i in coder.v.byte_ids else float(sp.get_score(i)) for i in ids) - best) < 1e-4


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def bag(t, width=5):
    w = words(t)
    return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else Counter()


def near_groups(rows):
    sets, named = components.Sets(), [r for r in rows if r[0] is not None]
    for a in named:
        for b in named:
            same = (a[1] or "") == (b[1] or "")
            if a[0] != b[0] and (same or jaccard(bag(a[1]), bag(b[1])) >= 0.8):
                sets.join(a[0], b[0])
    return {r[0]: sets.find(r[0]) for r in named}


def test_minhash_groups(docs, rows, empty):
    got = minhash_dedup.groups(docs).collect()
    want = near_groups(rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g["group_id"], g["kept"]) == ((want[g["doc_id"]], g["doc_id"] == want[g["doc_id"]]) if g["doc_id"] is not None else (None, True))
    kept = minhash_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted(set(want.values()))
    assert minhash_dedup.groups(empty).count() == 0 and minhash_dedup.keep(empty).count() == 0


def test_minhash_keeps_different_texts_of_one_id(spark):
    a, b, c = prose(120), prose(120), prose(60)
    near = b.replace(" ", "  ", 3) + " more"
    rows = [(1, a, "x"), (1, b, "y"), (2, near, "z"), (3, c, "b"), (3, c, "a"), (3, c, "b"), (4, c, "c"), (1, None, "n"), (5, "", "e"), (None, a, "q"), (2, "one", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string").withColumns({"_doc": F.lit(1), "_digest": F.lit("d"), "node": F.lit(2)}).repartition(4)
    got = minhash_dedup.groups(df).collect()
    assert len(got) == len(rows)
    kept = minhash_dedup.keep(df)
    assert kept.columns == df.columns
    # of (1, b) and (2, near) the first stays; of c's rows the one that is first as JSON; empty texts are copies
    assert Counter((r["doc_id"], r["text"], r["_gone"]) for r in kept.collect()) == Counter([(1, a, "x"), (1, b, "y"), (3, c, "a"), (1, None, "n"), (None, a, "q"), (2, "one", "r")])
    assert {(g["doc_id"], g["group_id"]) for g in got if g["kept"]} == {(1, 1), (3, 3), (None, None), (2, 2)}


def test_minhash_estimates_weighted_jaccard():
    hashes = common.WordHashes()
    errors = []
    for share in (0.2, 0.5, 0.8):
        a = [RNG.choice(WORDS) for _ in range(300)]
        b = a[: int(300 * share)] + [RNG.choice(WORDS) for _ in range(300 - int(300 * share))]
        pair = [" ".join(a), " ".join(b)]
        s = minhash_dedup.signatures(*minhash_dedup.shingles(pair, hashes, 1), 2000)
        errors.append(abs((s[0] == s[1]).mean() - jaccard(bag(pair[0], 1), bag(pair[1], 1))))
    assert max(errors) < 0.05


def test_minhash_open_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2)
    base = prose(200).split(" ")
    chain = []
    for k in range(8):  # neighbours are alike, ends are not
        base = base[:]
        base[20 * k + 5] = f"new{k}"
        chain.append((k, " ".join(base)))
    df = spark.createDataFrame([*chain, (99, prose(100))], "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in minhash_dedup.groups(df).collect()}
    assert got == near_groups([*chain, (99, df.where("doc_id = 99").first()["text"])])


def brute_spans(rows, n=suffix_dedup.PASSAGE):
    unique = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}, key=lambda x: x[0])
    count, first, out = Counter(), {}, {}
    for _, t in unique:
        w = words(t)
        count.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    for i, t in unique:
        w = words(t)
        shared, removed = set(), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if count[key] > 1:
                shared |= set(range(k, k + n))
                if key in first:
                    removed |= set(range(k, k + n))
                first.setdefault(key, 1)
        out[i] = (len(shared), len(removed))
    return out


@pytest.mark.parametrize("chunk", [1024, 1])
def test_suffix_spans(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    got = suffix_dedup.repeats(docs).collect()
    want = brute_spans(rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_shared_words"], g["n_removed_words"]) == want.get(g["doc_id"], (0, 0)), g["doc_id"]
    if chunk > 1:
        left = suffix_dedup.remove(docs)
        assert left.columns == docs.columns
        again = suffix_dedup.repeats(left).agg(F.sum("n_removed_words")).first()[0]
        assert again == 0
        assert all(r["n_chars"] in (None, len(r["text"] or "")) for r in left.collect())
        assert suffix_dedup.repeats(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


@pytest.mark.parametrize("chunk", [1024, 1])
def test_suffix_repeated_rows_are_one_document(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    r = random.Random(4)
    text = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (80, 120, 70, 90)]
    rows = [(1, text[0])] * 3 + [(2, text[1])] * 2 + [(3, text[2] + " " + text[0])] * 2 + [(4, text[3]), (5, "too short")] + [(5, "too short"), (None, text[3]), (None, text[3]), (6, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_spans(rows)
    got = suffix_dedup.repeats(df).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_shared_words"], g["n_removed_words"]) == want.get(g["doc_id"], (0, 0)), g["doc_id"]
    left = Counter((x["doc_id"], x["text"] and x["text"].strip()) for x in suffix_dedup.remove(df).collect())
    assert left == Counter([(1, text[0]), (2, text[1]), (3, text[2]), (4, text[3]), (5, "too short"), (5, "too short"), (None, text[3]), (None, text[3]), (6, None), (6, None)])


def test_suffix_helper_names_and_parts(spark, monkeypatch):
    h = np.random.default_rng(0).integers(0, 50, 5000).astype(np.uint64)
    counts = np.array([2000, 0, 2900, 100])
    want = suffix_dedup.minimisers(h, counts)
    monkeypatch.setattr(suffix_dedup, "PART", 333)
    assert all((a == b).all() for a, b in zip(want, suffix_dedup.minimisers(h, counts)))
    r = random.Random(9)
    a, b = (" ".join(r.choice(WORDS) for _ in range(n)) for n in (90, 70))
    rows = [(1, a, "x", "_"), (2, b + " " + a, "y", "_"), (3, b, "b", "_"), (3, b, "a", "_")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cut string, _SD string").withColumns({k: F.lit(k) for k in ("_sg", "_doc", "_digest", "_rows", "td", "sd", "removed", "hits")})
    left = suffix_dedup.remove(df)
    assert left.columns == df.columns
    assert sorted((x["doc_id"], x["text"].strip(), x["_cut"], x["removed"]) for x in left.collect()) == [(1, a, "x", "removed"), (2, b, "y", "removed")]
    assert suffix_dedup.repeats(df).where("n_removed_words > 0").select("doc_id").distinct().count() == 2


def test_cut_keeps_the_rest():
    t = " a b\n\nc  d e\n"
    assert suffix_dedup.cut(t, [{"start": 1, "length": 2}]) == " a d e\n"
    assert suffix_dedup.cut(t, [{"start": 0, "length": 5}]).strip() == ""


@pytest.mark.parametrize("block", [512, 3])
def test_embedding_links(spark, block):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 16)).tolist()
    v += [[y + 0.1 * float(z) for y, z in zip(v[k % 5], r.normal(size=16))] for k in range(30)] + [v[0]] * 4
    v += [None, [0.0] * 16, [math.nan] * 16, [None] * 16, [1.0] * 3, [math.inf] * 16]
    rows = [(k, x, k % 3) for k, x in enumerate(v)] + [(None, v[0], 1)]
    got = {g["vec_id"]: g for g in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    assert len(got) == len(rows)
    good = [(k, np.array(x) / np.linalg.norm(x)) for k, x, _ in rows if k is not None and k < 94]
    sets, links, found = components.Sets(), Counter(), 0
    for k, x in good:
        for m, y in good:
            if k != m and x @ y >= 0.9:
                links[k] += 1
                sets.join(k, m)
    assert sum(got[k]["n_links"] for k, _ in good) >= 0.9 * sum(links.values())
    assert all(got[k]["n_links"] <= links[k] for k, _ in good)
    assert np.mean([got[k]["component_id"] == sets.find(k) for k, _ in good]) > 0.9
    assert all(g["n_links"] == 0 for k, g in got.items() if k is None or k >= 94) and got[None]["kept"] is False
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    del found


@pytest.mark.parametrize(("vectors", "dimension"), [(65_536, 64), (2**20, 24), (2**24, 64)])
def test_pivot_recall_of_boundary_pairs(vectors, dimension):
    """Pairs at a cosine of 0.9 to 0.92 under the plan for tables of several sizes."""
    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, nearest = embedding_dedup.plan(vectors)
    points, x = unit(r.normal(size=(pivots, dimension))), unit(r.normal(size=(600, dimension)))
    z = r.normal(size=x.shape)
    z, c = unit(z - (z * x).sum(1, keepdims=True) * x), r.uniform(0.9, 0.92, (600, 1))
    a, b = (embedding_dedup.keys_of(v, points, nearest) for v in (x, c * x + np.sqrt(1 - c * c) * z))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.95


def test_embedding_ids_repeat_and_names_clash(spark):
    r = np.random.default_rng(4)
    v = [[float(np.float32(y)) for y in x] for x in r.normal(size=(3, 6))]
    rows = [(1, v[0]), (1, v[0]), (2, v[0]), (1, v[1]), (3, v[2]), (4, [0.0, -0.0] * 3), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(1) for k in ("vec", "rep", "key", "c", "node")}).repartition(3)
    got = Counter(tuple(g) for g in embedding_dedup.link(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (1, 0, 1, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)])


def test_embeddings_of_each_length_are_compared(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=8).tolist(), r.normal(size=5).tolist()
    vectors = [*r.normal(size=(20, 8)).tolist(), a, a, b, b, [x * 1.001 + 0.001 for x in b], [1.0, 2.0], [3.0] * 3, [3.0] * 3]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    got = {g["vec_id"]: (g["n_links"], g["component_id"], g["kept"]) for g in embedding_dedup.link(df, least=0.98).collect()}
    assert [got[k] for k in range(20, 28)] == [(1, 20, True), (1, 20, False), (2, 22, True), (2, 22, False), (2, 22, False), (0, 25, True), (1, 26, True), (1, 26, False)]
    assert embedding_dedup.link(df, dimension=8).where("vec_id >= 22 and n_links > 0").count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, k) for k in range(2000, 2100)]
    sets = components.Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}


def marked(spark, n=400, seed=11):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        text, toxic, good = [r.choice(WORDS) for _ in range(60)], r.random() < 0.25, r.random() < 0.8
        if toxic:
            text[r.randint(0, 59)] = r.choice(["vile", "rotten"])
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text), "en", f"s{k % 3}", None))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame([*rows, (-1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def test_toxicity_held_out(spark, empty):
    docs, labels = marked(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    held = [g for g in got if g["held_out"]]
    assert np.mean([g["predicted"] == g["toxic"] for g in held]) > 0.95 and all(0 <= g["score"] <= 1 for g in got)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(docs, toxicity.train(docs, none)).where("score > 0.01").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


@pytest.mark.parametrize("below", [False, True])
def test_toxicity_gradient_is_that_of_the_risk(below):
    """Finite differences, with the bracket above and below zero (there the step goes back along it)."""
    r = np.random.default_rng(6)
    xp, xu, w, b, prior = r.integers(0, 2, (9, 5)).astype(float), r.integers(0, 2, (40, 5)).astype(float), r.normal(size=5), 0.3, 0.4
    if below:
        xp, xu, prior = np.ones((9, 5)), np.zeros((40, 5)), 0.9
        w, b = np.full(5, 0.5), -2.0

    def risk(v):
        p, u = xp @ v[:-1] + v[-1], xu @ v[:-1] + v[-1]
        bracket = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return -bracket if bracket < 0 else prior * np.logaddexp(0, -p).mean() + bracket

    gw, gb, bracket = toxicity.risk_gradient(xp, xu, w, b, prior)
    assert (bracket < 0) == below
    at, step = np.append(w, b), 1e-6
    want = [(risk(at + step * e) - risk(at - step * e)) / (2 * step) for e in np.eye(6)]
    assert np.allclose(np.append(gw, gb), want, atol=1e-6)
    lists = lambda x: [np.flatnonzero(row) for row in x]
    sparse = toxicity.risk_gradient(toxicity.Rows(lists(xp), np.arange(5)), toxicity.Rows(lists(xu), np.arange(5)), w, b, prior)
    assert np.allclose(sparse[0], gw) and np.isclose(sparse[1], gb) and np.isclose(sparse[2], bracket)


def test_toxicity_counts_all_rows_and_takes_one_of_an_id(spark):
    docs, labels = marked(spark)
    again = spark.createDataFrame([(5, "again again", "en", "s0", None)] * 50 + [(7, "", None, None, None), (None, "alone", None, None, None)], docs.schema)
    docs = docs.unionByName(again).withColumns({"kind": F.lit(1), "kinds": F.lit(2), "digest": F.lit("d"), "buckets": F.lit(0), "one": F.lit(1)})
    counts, n = toxicity.frequencies(docs)
    want = Counter(b for r in docs.collect() for b in {toxicity.bucket(w) for w in toxicity.words_of(r["text"] or "")})
    assert n == docs.count() and {k: int(c) for k, c in enumerate(counts) if c} == want
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert model.weights[toxicity.bucket(b"vile")] > 0


def test_toxicity_keeps_every_telling_word():
    r = np.random.default_rng(2)
    toxic = [np.unique(np.append(r.choice(1000, 300, replace=False), r.integers(1000, 3000, 50))) for _ in range(200)]
    clean = [np.unique(r.integers(1000, 3000, 60)) for _ in range(600)]
    labels = np.array([1] * 200 + [0] * 600)
    model = toxicity.fit(toxic, toxic + clean, toxic + clean, labels, 0.25, steps=40)
    assert set(range(1000)) <= set(model.weights)


def test_toxicity_copies_do_not_crowd_out_words(spark):
    docs, labels = marked(spark)
    long_ = " ".join(f"copied{k}" for k in range(1500))
    docs = docs.unionByName(spark.createDataFrame([(k, long_, "en", "s0", None) for k in range(1000, 1170)], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(k, 1, 1) for k in range(1000, 1170)], LABELS))
    model = toxicity.train(docs, labels)
    assert all(model.weights.get(toxicity.bucket(w), 0) > 0 for w in (b"vile", b"rotten"))


def test_quality_views_exchange_their_surest_rows():
    r = random.Random(3)
    for _ in range(30):
        n, most, share = 40, r.randint(1, 12), r.random()
        p, free = np.array([r.choice([0.01, 0.04, 0.5, 0.96, 0.99, r.random()]) for _ in range(n)]), np.array([r.random() < 0.7 for _ in range(n)])
        got = dict((label, rows.tolist()) for rows, label in quality_classifier.handed_over(p, free, share, most))
        left = {c: [k for k in range(n) if free[k] and (p[k] if c else 1 - p[k]) >= quality_classifier.SURE] for c in (1, 0)}
        size = max(s / 100 for s in range(100 * most + 1) if all(s / 100 * q <= len(left[c]) + 1e-6 for c, q in ((1, share), (0, 1 - share))))
        for c, q in ((1, share), (0, 1 - share)):
            want = sorted(left[c], key=lambda k: (-(p[k] if c else 1 - p[k]), k))
            assert got[c] == want[: len(got[c])] and size * q - 1 < len(got[c]) <= (size + 0.01) * q + 1e-6


def test_quality_cotraining_uses_the_pool(spark):
    """One view's labels teach the other: with few labels, the pool makes the metadata view better."""
    r = np.random.default_rng(2)
    n = 3000
    good = r.random(n) < 0.5
    x = r.normal(size=(n, 4)) + np.outer(good, [6, 0, 0, 0])
    z = (r.random((n, 6)) < np.where(good[:, None], [0.7, 0.6, 0.6, 0.3, 0.4, 0.4], [0.3, 0.4, 0.4, 0.7, 0.6, 0.6])).astype(float)
    z = np.hstack([z, r.random((n, 40)) < 0.5]).astype(float)  # and columns that say nothing
    y = np.where(np.arange(n) < 80, good, -1).astype(int)
    hold = np.arange(n) < 40
    score = lambda m: ((z @ m.metadata[:-1] + m.metadata[-1] > 0) == good)[1000:].mean()
    alone, both = (quality_classifier.fit(x, z, y, hold, rounds=k) for k in (0, 4))
    assert score(both) > score(alone) + 0.02


def test_quality_repeated_rows_and_names(spark):
    docs, labels = marked(spark)
    again = spark.createDataFrame([(5, "again again", "en", "s0", None)] * 50 + [(7, "", None, None, None), (None, "alone", None, None, None)], docs.schema)
    docs = docs.unionByName(again).withColumns({"y": F.lit(1), "x": F.lit(2), "z": F.lit("d"), "one": F.lit(0), "hold": F.lit(1)})
    rows = docs.collect()
    features = quality_classifier.content_features([r["text"] or "" for r in rows]).astype(float)
    mean, spread = quality_classifier.figures(docs)
    assert np.allclose(mean, features.mean(0)) and np.allclose(spread, features.std(0) + 1e-3)
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows) and len({g["score"] for g in got if g["doc_id"] == 5}) == 2
    assert quality_classifier.keep(docs, model).columns == docs.columns
    assert Counter(g["kept"] for g in got)[True] == quality_classifier.keep(docs, model).count()


def test_quality_held_out(spark, empty):
    docs, labels = marked(spark)
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).join(labels, "doc_id").collect()
    held = [g for g in got if g["held_out"]]
    assert np.mean([(g["score"] >= 0.5) == (g["quality"] == 1) for g in held]) > 0.95
    kept = quality_classifier.keep(docs, model)
    assert kept.columns == docs.columns and kept.join(labels, "doc_id").where("quality = 1").count() >= 0.97 * labels.where("quality = 1").count()
    none = spark.createDataFrame([], LABELS)
    assert {g["score"] for g in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert quality_classifier.score(empty, quality_classifier.train(empty, labels)).count() == 0


def test_chat_rotation(spark):
    said = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "so"), (1, 3, "ann", "ok"), (1, 3, "ann", "ok"), (2, 0, "system", "x"), (None, None, "ann", ""), (None, 5, "ann", "é")]
    said += [(3, k, f"p{k % 3}", "w" * (k % 11)) for k in range(150)]
    df = spark.createDataFrame([(*s, "clash") for s in said], "conv_id long, turn long, role string, text string, segment string").repartition(5)
    got = chat_format.segments(df).collect()
    by = defaultdict(list)
    for g in got:
        by[g["conv_id"], g["perspective"]].append(g)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, None), (None, "ann"), (3, "p0"), (3, "p1"), (3, "p2")}
    for (conv, who), segs in by.items():
        segs.sort(key=lambda g: g["position"])
        whole = "".join(g["segment"] * g["copies"] for g in segs)
        at = 0
        for g in segs:
            assert g["char_start"] == at and g["learned"] == (g["role"] == who)
            if g["learned"]:
                span = whole[g["mask_start"] : g["mask_start"] + g["mask_chars"]]
                assert span.endswith("<|end|>") and g["segment"].startswith("<|assistant|>\n" + span)
            at += g["chars"] * g["copies"]
        assert len(re.findall(r"<\|end\|>", whole)) == sum(s[0] == conv for s in said)
    texts = {(r["conv_id"], r["perspective"]): r["text"] for r in chat_format.dialogues(chat_format.segments(df)).collect()}
    assert texts[1, "bob"].startswith("<|system|>\nbe <\\|kind|><|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n")
    assert chat_format.segments(df.limit(0)).count() == 0
    assert "Python" not in chat_format.segments(df)._jdf.queryExecution().toString()


def test_chat_of_many_speakers_at_one_turn(spark):
    """One turn number for a whole conversation, and more speakers than a block holds."""
    said = [(5, 0, f"p{k:03d}", f"said {k}") for k in range(120)]
    got = chat_format.segments(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    by = defaultdict(list)
    for g in got:
        by[g["perspective"]].append(g)
    assert len(by) == 120
    for who, segs in by.items():
        segs.sort(key=lambda g: g["position"])
        at = 0
        for g in segs:
            assert g["char_start"] == at and g["learned"] == (g["role"] == who)
            at += g["chars"] * g["copies"]
        assert sum(g["copies"] for g in segs) == 120


def test_ngram_words_are_hashed_without_a_table(docs, monkeypatch):
    made = []
    monkeypatch.setattr(ngram_scoring, "WordHashes", lambda *most: made.append(most) or common.WordHashes(*most))
    ngram_scoring.score(docs)
    assert made and set(made) == {(0,)}
    words = [b"a", b"b", b"a", "\u00e4".encode(), b""]
    common._WORDS.clear()
    assert common.WordHashes(0)(words).tolist() == common.WordHashes()(words).tolist() and common._WORDS
    common._WORDS.clear()
    common.WordHashes(0)(words)
    assert not common._WORDS


def test_quality_rules_keep_a_small_word_table():
    common.forget()
    common._WORDS.clear()
    rules, plain = quality_rules._Rules(quality_rules.Bands()), quality_rules._Rules(quality_rules.Bands())
    for k in range(8):
        values = [" ".join(f"w{k}x{i}" for i in range(j, j + 9000)) + " again and" * 9 for j in (0, 4500)]
        got = rules(pa.RecordBatch.from_pydict({"text": values}))
        assert len(common._WORDS) <= 50_000 and list(got["n_repeat_words"]) == [18, 18]
    common._WORDS.clear()
    assert [list(x) for x in got.values()] == [list(x) for x in plain(pa.RecordBatch.from_pydict({"text": values})).values()]
    common._WORDS.clear()


def test_quality_rules(docs, rows, empty):
    got = defaultdict(list)
    for g in quality_rules.measure(docs).collect():
        got[g["doc_id"]].append(g)
    for r in rows:
        t = r[1] or ""
        w = t.encode().split()
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.encode().strip()]
        g = got[r[0]][0]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (g["base_failed"] and g["kept"])
    assert all(g["kept"] for k in (6, 7, 8, 9) for g in got[k] if not g["base_failed"])
    assert quality_rules.keep(docs).columns == docs.columns and quality_rules.measure(empty).count() == 0
    import zstandard

    noise = bytes(RNG.randint(33, 126) for _ in range(20000))
    for data, ok in ((noise, False), (b"spam and eggs " * 2000, False), (prose(3000).encode(), True)):
        assert quality_rules.judge(data, zstandard.ZstdCompressor(), quality_rules.Bands())[2] == ok


@pytest.mark.parametrize("n", [120, 150, 180, 250, 300, 500, 900, 1000, 1900, 4000, 8000])
def test_quality_rules_reject_noise_of_any_length(n):
    import base64

    import zstandard

    r, packer, bands = random.Random(n), zstandard.ZstdCompressor(level=3), quality_rules.Bands()
    alphabets = ["".join(map(chr, x)) for x in ([*range(48, 58), *range(65, 91), *range(97, 123)], range(33, 127))]

    def noise(size, letters):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 10))) for _ in range(size // 3)).encode()[:size]

    for letters in alphabets * 20:
        assert not quality_rules.judge(noise(n, letters), packer, bands)[2]
    assert not quality_rules.judge(base64.b64encode(r.randbytes(n))[:n], packer, bands)[2]
    modules = (quality_rules, suffix_dedup, toxicity, embedding_dedup, minhash_dedup, ngram_scoring, packing, pieces, quality_classifier, chat_format)
    english = " ".join(" ".join(m.__doc__.split()) for m in modules).encode()
    assert quality_rules.judge(english[:n], packer, bands)[2]
    inside = english[:6000] + noise(8192, alphabets[0]) + english[:6000]  # noise in a longer text
    assert quality_rules.judge(inside, packer, bands)[1] > bands.bad_share


def test_the_session_stays_as_it_was(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    ngram_scoring.score(docs).count()
    minhash_dedup.groups(docs).count()
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "y" * 200, "", "z"]})
    assert [b.num_rows for b in common.slices(iter([batch]), most=100)] == [2, 1, 2]


def test_word_table_is_bounded():
    from xxhash import xxh64_intdigest

    hashes = common.WordHashes(most=10)
    for start, n in ((0, 8), (4, 9), (100, 8), (200, 30), (0, 3)):
        some = [b"%d" % k for k in range(start, start + n)] * 2
        assert hashes(some).tolist() == [xxh64_intdigest(w) for w in some]
        assert len(common._WORDS) <= 10
    common.give_back()
    assert not common._WORDS


def test_workers_hold_nothing_after_a_stage(spark, docs):
    """Each task sees a word table or tokenizer of no other one, and a worker makes its tokenizer once."""
    import gc

    def held(batch):
        found = Counter(type(x).__name__ for x in gc.get_objects())
        return {"n": [found["TextTokenizer"]] * batch.num_rows, "words": [len(common._WORDS)] * batch.num_rows}

    for stage in (lambda: packing.pack(docs, vocab.path(PACK[0])), lambda: quality_rules.measure(docs)):
        stage().count()
        assert set(map(tuple, common.map_texts(docs, ["text"], held, "n long, words long").distinct().collect())) == {(0, 0)}
    made = []
    runs = [common.lean(lambda batches: (yield common.kept(("x",), lambda: made.append(1) or len(made))), keeps=True) for _ in range(3)]
    assert [list(run(iter([]))) for run in runs] == [[1]] * 3
    assert list(common.lean(lambda batches: batches)(iter([5]))) == [5] and not common._KEPT


def brute_cut(rows, n=suffix_dedup.PASSAGE):
    """Words left of each document once passages that an earlier place has are cut, in order of doc_id."""
    first, left = set(), {}
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in rows):
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in first:
                gone |= set(range(k, k + n))
            first.add(key)
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


def brute_rules(text):
    import zstandard

    w = words(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and quality_rules.judge((text or "").encode(), zstandard.ZstdCompressor(level=3), quality_rules.Bands())[2]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = marked(spark, 150)
    r, base = random.Random(21), docs.where("doc_id >= 0").collect()
    shared = " ".join(r.choice(WORDS) for _ in range(70))
    more = [(1000, "x " * 300), (1001, "short text"), (1002, None), (1003, ""), (1004, " ".join(r.choice(WORDS) for _ in range(40)) + " " + shared), (1005, shared + " " + " ".join(r.choice(WORDS) for _ in range(50)))]
    for k in range(20):  # near and exact copies
        w = base[k]["text"].split(" ")
        w[r.randrange(len(w))] = r.choice(WORDS) if k % 2 else w[0]
        more.append((2000 + k, " ".join(w)))
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", None if i % 2 else "s1", None) for i, t in more], docs.schema))
    docs = docs.withColumns({"score": F.lit(0.5), "digest": F.lit("d"), "_Doc": F.lit(1), "node": F.lit(2), "kept": F.lit(True)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {g["doc_id"]: g["score"] for g in quality_classifier.score(now, quality_classifier.train(now, labels)).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in now.collect()]
        now = common.store(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in now.collect()}
        assert len(got) == now.count()
        if name == "quality_classifier":
            want = {r["doc_id"] for r in before if scores[r["doc_id"]] >= 0.5}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in before if brute_rules(r["text"])}
        elif name == "minhash_dedup":
            want = set(near_groups([(r["doc_id"], r["text"]) for r in before]).values())
        else:
            left = brute_cut(before)
            want = {i for i, w in left.items() if w}
            assert all(words(got[i]) == left[i] for i in want)
        assert set(got) == want, name
        assert 50 < len(want) <= len(before)
    assert 1004 in got and 1005 in got and not set(got) & {1000, 1001, 1002, 1003}
    coder, pieces_ = Tokenizer.from_file(vocab.path(PACK[0])), defaultdict(list)
    for g in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces_[g["doc_id"]].append(g)
    assert set(pieces_) == set(got)
    for i, parts in pieces_.items():
        ids, at = coder.encode(got[i], add_special_tokens=False).ids + [0], 0
        for g in sorted(parts, key=lambda g: g["start"]):
            assert g["start"] == at and g["ids_crc32"] == zlib.crc32(np.array(ids[at : at + g["length"]], "<u4").tobytes())
            at += g["length"]
        assert at == len(ids)


def test_pipeline_of_odd_tables(spark, tmp_path, docs, empty):
    spark.createDataFrame([(0, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for k, table in enumerate((empty, docs)):  # nulls in any column, repeated rows, empty and long texts
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.store(stage(spark, now, str(tmp_path)), name)
            assert now.columns == table.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert (packed.count() > 0) == bool(k)
    assert set(registry.oracle_sql()) <= set(registry.queries())
