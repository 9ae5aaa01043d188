"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternspark.llm import embeddings, fingerprints, graph, langid, licenses, lines, minhash, mixing, packing, suffix, urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60, 150]))) for _ in range(n - 40)]
    shared = " ".join(rng.choice(words) for _ in range(20))
    texts += [texts[k] for k in range(10)]
    for k in range(12):  # near copies
        w = texts[k].split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [f"{rng.choice(words)} {shared}\n{rng.choice(words)}" for _ in range(10)]
    texts += [None, "", " ", "one", "One", "\n\n", "x" * 5000, "é" * 60 + " ü" * 40]
    rng.shuffle(texts)
    return [(k, t, None, f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 and 10 ------------------------------------------------------------------------------------------------

def placed_within_a_block(got, weights):
    """Every block has a slot of its own in its window; deviation stays under one block while nobody has run out."""
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    run_out = min(max(s for s, (x, _) in slots.items() if x == source) for source, w in weights.items() if w)
    done = dict.fromkeys(weights, 0)
    for t in range(run_out):
        if t in slots:
            done[slots[t][0]] += 1
        assert all(abs(done[k] - (t + 1) * w / sum(weights.values())) < 1 for k, w in weights.items())


@pytest.mark.parametrize("weights", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.61803, "b": 0.27, "c": 0.11197}, {"a": 1 / 3, "b": 0.5, "c": 1 / 7}])
def test_mix_keeps_every_row_within_a_block(spark, weights):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 40), None, rng.choice(["a", "a", "a", "b", "c"]), None) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), weights, block_chars=50).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    placed_within_a_block(got, weights)


@pytest.mark.parametrize(("weights", "blocks"), [({"a": 0.999, "b": 0.001}, (3000, 4)), ({"a": 3, "b": 2, "c": 1}, (40, 900, 500)), ({"a": 1.0, "b": 1e-4, "c": 0.37}, (700, 2, 300)), ({"a": 5, "b": 5}, (0, 0))])
def test_schedule_is_exact(spark, weights, blocks):
    r = mixing.rates(dict(zip(weights, [100 * b for b in blocks], strict=True)), weights, block_chars=100)
    assert [q / r.n for q in r.q] == pytest.approx([weights[k] / sum(weights.values()) for k in r.names])
    made = mixing.schedule(spark, r).collect()
    limit = dict(zip(r.names, r.q if r.repeats else r.blocks, strict=True))
    assert sorted((x.source, x.k) for x in made) == sorted((k, i) for k, n in limit.items() for i in range(n))
    rate = {k: (q, r.n) for k, q in zip(r.names, r.q, strict=True)}
    assert len({x.slot0 for x in made}) == len(made) == r.steps
    assert all(x.k * rate[x.source][1] // rate[x.source][0] <= x.slot0 < -(-(x.k + 1) * rate[x.source][1] // rate[x.source][0]) for x in made)


def test_sources_without_weight_follow(spark):
    rows = [(k, "x" * 10, None, "abcd"[k % 4], None) for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), {"a": 2, "b": 1, "c": 0}, block_chars=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(400)) and all(r.release <= r.slot < r.deadline for r in got)
    last = max(r.slot for r in got if r.source in "ab")
    rest = sorted((r.slot, r.source) for r in got if r.source in "cd")
    assert rest[0][0] > last and [x for _, x in rest] == ["c", "d"] * 100
    with pytest.raises(ValueError):
        mixing.rates({"a": 5}, {"a": float("nan")})


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "abc", None, "a", 7)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("mine"))).collect()
    assert sorted((r.source, r.n_chars) for r in got) == [("", 0), ("", 0), ("a", 3)]
    order = mixing.in_mix_order(spark.createDataFrame(rows, DOCS))
    assert order.columns == DOCS.names and order.count() == 3 and order.where("source is null").count() == 2


def test_packing(docs, empty):
    got = packing.pack(docs, buckets=4, budget=1000).collect()
    assert sorted(r.doc_id for r in got) == list(range(docs.count()))
    assert all(r.n_tokens <= r.padded_len for r in got)
    groups = {}
    for r in got:
        groups.setdefault((r.bucket, r.batch), []).append(r)
    assert all(len(g) * g[0].padded_len <= 1000 or len(g) == 1 for g in groups.values())
    assert packing.pack(empty).count() == 0


def test_a_long_text_does_not_coarsen_the_bounds_of_short_ones(spark):
    rng = random.Random(6)
    lengths = [rng.randint(1, 3000) for _ in range(300)] + [4_000_000]
    got = packing.pack(spark.createDataFrame([(k, "x" * n) for k, n in enumerate(lengths)], "doc_id long, text string"), buckets=5).collect()
    cells = sorted(set(lengths))
    best = {c: (c * sum(n <= c for n in lengths) - sum(n for n in lengths if n <= c)) for c in cells}
    for _ in range(4):
        best = {c: min(best[b] + sum(c - n for n in lengths if b < n <= c) for b in cells if b < c and b in best) for c in cells if any(b < c for b in best)}
    assert sum(r.padded_len - r.n_tokens for r in got) == best[4_000_000]


def test_one_huge_text_leaves_the_padding_of_a_real_table(spark):
    sizes = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n")).cache()
    huge = sizes.union(spark.createDataFrame([(-1, 18_000_000)], "doc_id long, n long"))
    plain, other = (packing.pack(x, length=F.col("n")).where("doc_id >= 0").agg(F.sum("padded_len")).first()[0] for x in (sizes, huge))
    assert other <= 1.05 * plain
    sizes.unpersist()


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(7)
    cells = np.unique(rng.integers(1, 10**7, 150_000))
    counts = rng.integers(1, 100, len(cells))
    bounds = np.array(packing.boundaries(cells, counts, 12))
    pad = int(((bounds[np.searchsorted(bounds, cells)] - cells) * counts).sum())
    n = np.linspace(0, len(cells) - 1, 13)[1:].astype(int)  # near the best for even lengths
    even = int(((cells[n][np.searchsorted(cells[n], cells)] - cells) * counts).sum())
    assert len(bounds) == 12 and bounds[-1] == cells[-1] and pad <= even
    for k in range(11):  # no bound is better one cell off
        for step in (-1, 1):
            other = bounds.copy()
            other[k] = cells[np.searchsorted(cells, other[k]) + step]
            assert int(((other[np.searchsorted(other, cells)] - cells) * counts).sum()) >= pad


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(50):
        cells = sorted(rng.sample(range(1, 30), 7))
        counts = [rng.randint(1, 9) for _ in cells]

        def cost(bounds, cells=cells, counts=counts):
            return sum(n * (min(b for b in bounds if b >= c) - c) for c, n in zip(cells, counts, strict=True))

        got = packing.boundaries(cells, counts, 3)
        best = min(cost([*x, cells[-1]]) for x in combinations(cells[:-1], 2))
        assert cost(got) == best and len(got) == 3
    assert packing.boundaries([5], [3], 12) == [5]


# ---- 2 -------------------------------------------------------------------------------------------------------

def canon(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", x).strip(" ")


def test_fingerprints_follow_canonical_texts(spark):
    texts = [None, "", "  ", "Straße", "STRASSE", "ﬁne", "fine", "e\u0301", "é", "a\t b", "A B", "a  b ", "ab"]
    got = {i: f for i, f in enumerate(r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect())}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canon(a or "") == canon(b or "")), (a, b)
    classes = fingerprints.exact_classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len({r.class_id for r in classes}) == len({canon(t or "") for t in texts})


def test_cells(spark):
    bounds = [-5, 0, 3, 7, 11, 100, 2**40]
    xs = [-10, -5, -1, 0, 3, 99, 100, 2**40 - 1, 2**41]
    got = {r.id: r.c for r in spark.createDataFrame([(x,) for x in xs], "id long").select("id", fingerprints._cell(F.col("id"), bounds).alias("c")).collect()}
    assert got == {x: sum(b <= x for b in bounds) for x in xs}


def test_edits(docs, spark, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edits(docs).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].near_edited == float(canon(e) == canon(t)) and got[i].near_next == float(canon(nxt) == canon(t))
    assert fingerprints.edits(empty).count() == 0
    one = fingerprints.edits(spark.createDataFrame([(7, "abcdef", None, None, None)], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    twice = fingerprints.edits(spark.createDataFrame([(7, "abc", None, None, None), (7, "abc", None, None, None), (None, None, None, None, None)], DOCS))
    assert twice.count() == 3


def test_edits_of_many_rows_without_ids(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1000).cast("string")).alias("text"))
    more = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("five "), (F.col("id") % 300).cast("string")).alias("text"))
    got = fingerprints.edits(rows.union(more).union(spark.range(50).select("id", F.lit("once").alias("text")))).cache()
    assert got.count() == 120_050
    # all but one of equal rows are followed by their like
    assert got.where("doc_id is null and near_next = 1").count() == 99_000 and got.where("doc_id = 5 and near_next = 1").count() == 19_700
    assert got.select("fingerprint").distinct().count() == 1301
    got.unpersist()


@pytest.mark.parametrize("digits", [1, 2])
def test_texts_that_share_a_digest_are_told_apart(docs, spark, digits):
    docs = docs.union(spark.createDataFrame([(1000, "ONE", None, None, None), (1001, "a  b", None, None, None), (1002, "A b", None, None, None)], DOCS))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edits(docs, digits=digits).collect()}
    names = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i].near_edited == float(canon(e) == canon(t)) and got[i].near_next == float(canon(nxt) == canon(t))
        assert names.setdefault(got[i].fingerprint, canon(t)) == canon(t) and names.setdefault(got[i].edited_fingerprint, canon(e)) == canon(e)
    assert len(set(names.values())) == len(names) and any("-" in x for x in names)
    marked = fingerprints.fingerprint(docs.select("doc_id", "text"), digits=digits).collect()
    assert len({r.fingerprint for r in marked}) == len({canon(t) for _, t in rows})


# ---- 3 -------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    made = ["https://WWW.Example.com/en/x", "http://a.example.com/en/", "http://example.com/fr", "http://com/", "http://com", "ftp://x.net/es/1", "x.net/es/1", None, "", "http://x.net/de/",
            "http://x.net/es", "http://xnet/es/", "http://spam-farm.example.org/a", "http://m.spam-farm.example.org?q#f", "http://a.org/p?x=1#y", "http://a.org#f", "://net/fr/z", "http://u://net/es/", "http://ÀB.com/é"]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(made)], "page_id long, url string, host string")).collect()}
    for i, u in enumerate(made):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]
        fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        verdict = urls.RULES[rule] if rule else "block" if any(host == b or host.endswith("." + b) for b in urls.BLOCKED_HOSTS) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_with_tiny_filters(spark, monkeypatch):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 17)] + ["elsewhere"]
    monkeypatch.setattr(urls, "PASSED", 1000.0)
    levels = urls.cascade(universe, listed, bits_per_key=2)
    assert len(levels) > 2
    assert {r.key for r in universe.where(urls.member(F.col("key"), levels)).collect()} == set(listed) - {"elsewhere"}


def test_cascade_of_a_long_list_and_a_large_universe(spark):
    universe = spark.range(300_000).select(F.concat(F.lit("h"), "id", F.lit(".example.org")).alias("key"))
    few = urls.cascade(universe, [f"h{k}.example.org" for k in range(18)])
    assert sum(x.bits for x in few) < 18 * 64 * 3  # some 20 bits a listed key, not 10 a key of the universe
    listed = [f"h{k}.example.org" for k in range(0, 300_000, 75)]
    levels = urls.cascade(universe, listed)
    assert sum(x.bits for x in levels) < 40 * len(listed)
    assert universe.where(urls.member(F.col("key"), levels)).count() == len(listed) == universe.where(urls.member(F.col("key"), levels) & F.col("key").isin(listed)).count()


def test_a_long_list_of_hosts_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_KEYS", 10)
    blocked = tuple(f"b{k}.example.org" for k in range(0, 60_000, 3))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.b"), "id", F.lit(".example.org/p")).alias("url"))
    got = urls.judge(pages, {"b3.example.org/p": "allow"}, blocked)
    wrong = got.where((F.col("verdict") == "block") != ((F.col("page_id") % 3 == 0) & (F.col("page_id") != 3)))
    assert got.count() == 60_000 and wrong.isEmpty()
    assert [tuple(r) for r in got.where("rule is not null").select("page_id", "rule", "verdict").collect()] == [(3, "b3.example.org/p", "allow")]


# ---- 4 -------------------------------------------------------------------------------------------------------

def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups_of(sets, linked):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def jaccard(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(docs, words):
    sets = {r.doc_id: shingles(r.text, words) for r in docs.collect()}
    want = groups_of(sets, jaccard)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=words).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_small_sets_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(90):
        w = base[: rng.choice([4, 5, 6, 7, 8, 30])]
        for _ in range(rng.randint(0, 3)):
            w = [*w]
            w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(w), None, None, None))
    rows += [(None, rows[0][1], None, None, None), (None, None, None, None, None), (3, rows[3][1], None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    sets = {r[0]: shingles(r[1], 1) for r in rows if r[0] is not None}
    got = minhash.near_duplicates(df, words=1).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == groups_of(sets, jaccard)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_one_id_with_several_texts(spark):
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, word(1)), (1, word(2)), (2, word(2) + " end"), (3, word(3)), (4, word(1) + " end"), (5, word(3)), (5, word(5)), (6, word(5) + " more")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 3, 6: 3}


@pytest.mark.parametrize("percent", [60, 95])
def test_near_duplicates_of_other_bounds(spark, monkeypatch, percent):
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    rng = random.Random(percent)
    base = [[f"b{g}w{k}" for k in range(rng.choice([30, 90, 300]))] for g in range(4)]
    rows = []
    for k in range(80):
        w = [x if rng.random() > 0.2 * rng.random() else f"r{rng.randrange(10**6)}" for x in rng.choice(base)]
        rows.append((k, " ".join(w)))
    sets = {i: shingles(t, 1) for i, t in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=percent).collect()}
    assert got == groups_of(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))


def test_estimates_let_no_similar_pair_go():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(10, 900)))
        for _ in range(10):
            keep = rng.random(len(base)) > 0.12 * rng.random()
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 1 + len(base) // 10))])))
    near = set(zip(*(x.tolist() for x in minhash._candidates(sets, 80, 64)), strict=True))
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= near and len(near) < len(sets) * 8


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}


# ---- 5 -------------------------------------------------------------------------------------------------------

def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": ["na", "ta", "kata", "nata", "lama"], "bb": ["zor", "vorz", "grok", "zork", "vog"], "çç": ["éçé", "çaé", "éé", "aç", "éça"]}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 40))), x, None, None) for k in range(400) for x in [rng.choice(list(words))]]
    rows += [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "123 !!", None, None, None), (1003, "漢字かな", None, None, None), (None, "na ta", None, None, None), (1004, "na ta " * 20_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].lang_pred == r[2] for r in rows[:400])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].rejected and by[1003].lang_pred in words and not by[1004].rejected and by[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(by[r[0]].rejected for r in rows[:400])
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()} == {"und"}


def test_languages_of_many_scripts(spark):
    rng = random.Random(8)
    letters = {"la": range(97, 123), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x4EC8), "ja": [*range(0x3041, 0x3091), *range(0x5000, 0x5064)], "ko": range(0xAC00, 0xAC80), "new": range(0x905, 0x939)}
    rows = []
    for lang, points in letters.items():
        own = [chr(p) for p in points]
        words = ["".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(80)]
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(40)), lang, None, None) for k in range(60 if lang != "la" else 200)]
    known = langid.fit(spark.createDataFrame([r for r in rows if r[2] != "new" and r[0] % 3], DOCS))
    got = known.predict(spark.createDataFrame([r for r in rows if r[2] == "new" or not r[0] % 3], DOCS)).collect()
    assert all(r.rejected if r.lang == "new" else r.lang_pred == r.lang and not r.rejected for r in got)
    assert {r.lang for r in got} == set(letters)


def plain_kneser_ney(texts, order):
    """Interpolated Kneser-Ney straight from its formula: probability of a symbol after a tuple of symbols."""
    from collections import Counter

    grams = {order: Counter(tuple(t[i - order : i]) for t in texts for i in range(order, len(t) + 1))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    size = len({x for g in grams[order] for x in g}) + 1
    totals, kinds, ones, twos = ({k: Counter() for k in grams} for _ in range(4))
    for k, seen in grams.items():
        for g, n in seen.items():
            totals[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
            ones[k][0] += n == 1
            twos[k][0] += n == 2

    def p(symbol, context):
        k = len(context) + 1
        if k == 0 or not grams.get(k):
            return 1 / size
        lower = p(symbol, context[1:]) if k > 1 else 1 / size
        total = totals[k][context]
        if not total:
            return lower
        n1, n2 = ones[k][0], twos[k][0]
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5
        return max(grams[k][(*context, symbol)] - d, 0) / total + d * kinds[k][context] / total * lower

    return p, size


def test_kneser_ney_is_that_of_the_formula():
    rng = random.Random(0)
    order = 3
    texts = ["".join(rng.choice("aaabbcde ") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    every, place = langid.padded(*langid.symbols_of(texts), order)
    rows = np.lib.stride_tricks.sliding_window_view(every, order)[place - order + 1]
    grams, n = np.unique(rows, axis=0, return_counts=True)
    # the symbols as the model sees them: letters, gaps as one, a gap at the end, gaps before the beginning
    plain = [[0] * order + [ord(c) if c != " " else 0 for c in re.sub(" +", " ", t.strip(" ") + " ")] for t in texts]
    p, size = plain_kneser_ney([x[1:] for x in plain], order)
    assert size == len(np.unique(grams)) + 1
    model = langid.kneser_ney(grams.astype(np.uint32), n, size)
    symbols = [0, *map(ord, "abcdez")]
    for a in symbols:
        for b in symbols:
            row = np.array([a, b], dtype=np.uint32)
            got = []
            for c in symbols:
                full = np.array([[*row, c]], dtype=np.uint32)
                hashes = [langid._row_hashes(full[:, order - k :]) for k in range(1, order + 1)]
                contexts = [langid._row_hashes(full[:, order - k : -1]) for k in range(1, order + 1)]
                got.append(float(np.exp(model.score(hashes, contexts))[0]))
            assert got == pytest.approx([p(c, (a, b)) for c in symbols])
            assert sum(got) == pytest.approx(1)  # of six known symbols and one that stands for all others


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    known = langid.fit(docs.where(~langid.is_held_out()))
    held = known.predict(docs.where(langid.is_held_out())).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert held[0] > 0.998 and held[1] < 3 * langid.REJECTED
    rng = random.Random(5)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rng.randint(60, 400))) for _ in range(200)]
    junk += ["".join(chr(rng.randint(0x430, 0x44F)) for _ in range(40)) for _ in range(20)]
    bad = spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string")
    assert known.predict(bad).where("rejected").count() >= 0.99 * len(junk)
    broken = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('FFFE41C328') as string)").alias("text"))
    assert known.predict(broken).count() == 3


# ---- 6 -------------------------------------------------------------------------------------------------------

def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    x[60:90] = x[:30] + rng.normal(size=(30, 8)) * 0.1
    x[90:120] = x[0] + rng.normal(size=(30, 8)) * 0.15
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(200, rows[5][1]), (201, [2 * v for v in rows[5][1]]), (300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 3), (304, [None] * 8), (305, []), (None, rows[5][1])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {k: np.array(v) for k, v in rows if k is not None and k < 300 or k == 303}

    def linked(a, b):
        return len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95

    want = groups_of(good, linked)
    n = {a: sum(linked(good[a], good[b]) for b in good if b != a) for a in good}
    assert {k: got[k].component_id for k in good} == want and {k: got[k].n_links for k in good} == n
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (300, 301, 302, 304, 305))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_extreme_components_and_of_one_id(spark):
    x = np.random.default_rng(2).normal(size=6)
    y = np.random.default_rng(3).normal(size=6)
    rows = [(1, x * 1e-300), (2, x * 1e200), (3, (x + 0.01) * 1e-170), (4, y * 1e-320), (5, y * 1e300), (6, y), (6, -x), (7, -x * 3), (8, x * 5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), (3, 1))
    assert got[5][1] == got[7][1] == got[6][1] and got[7][0] == 1


def test_recall_on_the_given_vectors(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = data.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    n = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(data).collect()}
    assert sum(got.values()) >= 0.9999 * n.sum() and all(got[r.vec_id] <= c + 1 for r, c in zip(rows, n.tolist(), strict=True))


# ---- 7 -------------------------------------------------------------------------------------------------------

def brute_lines(rows, min_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(urls.UPPER, urls.LOWER))

    holders = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if not (len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i)]
        out[i] = (len(all_lines), len(all_lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    pool = [f"line number {k} of the pool" for k in range(12)] + ["short", "é" * 19, "é" * 20, "  Line Number 3 OF the pool\t", "", " " * 30]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(40)] + [(90, None), (91, ""), (92, "\n")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("n_lines", F.lit("clash"))
    want = brute_lines(rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in lines.drop_repeated_lines(df).collect()}
    assert got == want
    assert lines.drop_repeated_lines(empty).count() == 0


def index_state(index):
    filters = {r.shard: lines.CuckooFilter.read(r.filter) for r in index.filters.collect()}
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.postings.collect())), {k: f.entries() for k, f in filters.items() if f.entries()}


def test_line_index_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    rng = random.Random(3)
    pool = [f"a line that is long enough, number {k}" for k in range(60)]
    texts = lambda n, first: spark.createDataFrame([(first + k, "\n".join(rng.sample(pool, rng.randint(1, 12)))) for k in range(n)], "doc_id long, text string")
    a, b = texts(30, 0).cache(), texts(25, 100).cache()
    index = lines.build(a)
    assert index.shards > 1
    before = index_state(index)
    both = lines.insert(index, b)
    fresh = lines.build(a.union(b))
    assert index_state(both)[:2] == index_state(fresh)[:2] and index_state(both)[2] != before[2]
    keys = lambda i: {(r.hi, r.lo) for r in lines.probe(i, i.postings).collect()}
    assert {(r.hi, r.lo) for r in both.repeated().collect()} <= keys(both)
    kept = lambda df, i: sorted(map(tuple, lines.drop_repeated_lines(df, i).collect()))
    assert kept(b, both) == sorted(t for t in kept(a.union(b), None) if t[0] >= 100)
    assert index_state(lines.remove(both, b)) == before
    assert index_state(lines.insert(lines.remove(index, a.where("doc_id < 10")), a.where("doc_id < 10"))) == before


def test_probing_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lines, "PROBE_ROWS", 7)
    rows = [(k, f"the line that everybody has\nand another line, number {k % 9}") for k in range(80)] + [(None, "the line that everybody has")] * 20 + [(3, "the line that everybody has")]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.text == "the line that everybody has" and not r.n_dropped for r in got if r.doc_id is None)
    assert [r.doc_id for r in got if r.doc_id is not None and "everybody" in r.text] == [79]
    odd = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(concat(repeat('FF41', 15), '0A', repeat('C3', 25))) as string)").alias("text"))
    assert sorted(r.n_dropped for r in lines.drop_repeated_lines(odd).select("n_dropped").collect()) == [0, 2, 2, 2]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    hi, lo = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
    f = lines.CuckooFilter.of(hi, lo)
    assert f.contains(hi, lo).all()
    other = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    assert f.contains(np.ascontiguousarray(other[:, 0]), np.ascontiguousarray(other[:, 1])).mean() < 0.01
    f.delete(hi[:2500], lo[:2500])
    assert f.contains(hi[2500:], lo[2500:]).all() and f.contains(hi[:2500], lo[:2500]).mean() < 0.02


# ---- 8 -------------------------------------------------------------------------------------------------------

def brute_spans(rows):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            seen[b[s : s + 50]] = min(i, seen.get(b[s : s + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), sum(gone), len(spans), spans, kept)
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_spans(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(12)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = "".join(rng.choice("abc ") for _ in range(3000))
    for k in range(60):
        a, n = rng.randrange(2900), rng.choice([40, 49, 50, 51, 99, 300])
        rows.append((1000 + k, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + long[a : a + n] + rng.choice(["", "é", long[:80]])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows)
    assert suffix.repeated_spans(empty).count() == 0


def test_repeated_spans_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(suffix, "FILTER_MOST", 64)
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(suffix, "HOT", 1)
    t = "".join(random.Random(5).choice("abcd") for _ in range(400))
    rows = [(1, t), (2, t[100:300]), (3, "zz" + t[:200] + "zz"), (4, "q" * 120), (5, "q" * 90)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows)


def test_repeated_ids(spark):
    t = "the same text again and again, longer than fifty bytes, in every row"
    rows = [(1, t), (1, t), (2, t), (None, t)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, len(t)), (True, 0, len(t))]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 40))]
        assert suffix.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_arrays_of_many_texts():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 5, 200])) for _ in range(rng.choice([0, 1, 2, 9, 40, 90]))] for _ in range(rng.randint(1, 30))]
        width = max(1, *map(len, texts))
        x = np.full((len(texts), width), 7, dtype=np.int16)
        for k, t in enumerate(texts):
            x[k, : len(t)] = t
        got = suffix.suffix_arrays(x, np.array([len(t) for t in texts]))
        for row, t in zip(got.tolist(), texts, strict=True):
            assert row[: len(t)] == sorted(range(len(t)), key=lambda i: t[i:]) and set(row[len(t) :]) <= {-1}


@pytest.mark.parametrize("fewest", [1, 10**6])
def test_smallest_holders(monkeypatch, fewest):
    monkeypatch.setattr(suffix, "FEWEST", fewest)
    rng = random.Random(fewest)
    for _ in range(20):
        base = bytes(rng.choice(b"ab\x00\xff") for _ in range(200))
        group, stretches = [], []
        for g in range(rng.randint(1, 12)):
            for _ in range(rng.randint(1, 5)):
                a = rng.randint(0, 140)
                stretches.append(base[a : a + rng.randint(50, 60)])
                group.append(g)
        low = np.array([rng.randint(0, 9) for _ in stretches])
        got = suffix.smallest_holders(stretches, low, np.array(group)).tolist()
        want = [min(d for s, d, h in zip(stretches, low.tolist(), group, strict=True) if h == g and t[i : i + 50] in s) for t, g in zip(stretches, group, strict=True) for i in range(len(t) - 49)]
        assert got == want
    assert len(suffix.smallest_holders([], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))) == 0


@pytest.mark.parametrize("fewest", [1, 10**6])
def test_copies_of_a_stretch_are_sorted_once(monkeypatch, fewest):
    monkeypatch.setattr(suffix, "FEWEST", fewest)
    sorted_symbols = []
    together, alone = suffix.suffix_orders, suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_orders", lambda x, n: (sorted_symbols.append(len(x) - len(n)), together(x, n))[1])
    monkeypatch.setattr(suffix, "suffix_array", lambda x: (sorted_symbols.append(len(x)), alone(x))[1])
    rng = random.Random(7)
    a, b = (bytes(rng.choice(b"abcd") for _ in range(90)) for _ in range(2))
    stretches, group = [a, a, b + a, a, b, b], np.array([3, 3, 3, 4, 4, 4])
    got = suffix.smallest_holders(stretches, np.array([5, 8, 7, 6, 9, 2]), group).tolist()
    assert sum(sorted_symbols) == (91 + 181) + (91 + 91)  # once a group, with a separator each
    assert got == [5] * 41 + [5] * 41 + [7] * 90 + [5] * 41 + [6] * 41 + [2] * 41 + [2] * 41


def test_suffix_orders_of_ragged_texts():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 5, 200])) for _ in range(rng.choice([0, 1, 2, 9, 40, 90]))] for _ in range(rng.randint(1, 30))]
        got = suffix.suffix_orders(np.array([x for t in texts for x in [0, *t]], dtype=np.int16), np.array([len(t) + 1 for t in texts])).tolist()
        at = 0
        for t in texts:
            assert [x - at - 1 for x in got[at + 1 : at + 1 + len(t)]] == sorted(range(len(t)), key=lambda i: t[i:])
            at += len(t) + 1


def test_runs_of_least_hashes():
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 30, 50, 51, 400]))) + b"q" * rng.choice([0, 0, 70]) for _ in range(60)]
    text = suffix.Text(bodies)
    own, a, b = text.chunks()
    repeated = [[k for k in range(n) if rng.random() < 0.4] for n in np.bincount(own, minlength=len(bodies))]
    least, want, number = text.least().view(np.int64), [], 0
    for k in range(len(own)):
        number = 0 if k == 0 or own[k] != own[k - 1] else number + 1
        if number in repeated[own[k]]:
            continue
        for s in range(a[k], b[k]):
            if want and want[-1][0] == least[s] and want[-1][1] == own[k] and want[-1][2] + want[-1][3] == s:
                want[-1][3] += 1
            else:
                want.append([least[s], own[k], s, 1])
    got = suffix._runs(text, *suffix._fresh(text, repeated))
    assert len(want) > 100 and np.array(want).tolist() == np.stack(got, axis=1).tolist()


# ---- 9 -------------------------------------------------------------------------------------------------------

def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    made = [mit, "before " * 300 + mit.upper() + " after" * 300, "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "the of and", "", None,
            "This work is licensed under the GNU General Public License, version 3.", "under the license " * 50, mit.replace("merge", "combine").replace("publish, ", "")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(made)], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].license for i in range(10)] == ["MIT-text", "MIT-text", "MIT", "Apache-2.0", None, None, None, "GPL-3.0", None, "MIT-text"]
    assert got[1].first_word == 300 and got[0].coverage == 1.0 and 0.95 < got[9].coverage < 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_relatives_and_copies(spark):
    t = licenses.TEMPLATES
    gnu = "This work is licensed under the GNU {} Public License, version {}."
    want = {
        "Released under the BSD License.": ["BSD"], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"], "Licensed under CC BY-NC 3.0.": [],
        gnu.format("General", "2"): ["GPL-2.0"], gnu.format("General", "3.0"): ["GPL-3.0"], gnu.format("Lesser General", "3"): ["LGPL-3.0"], gnu.format("Foo General", "3"): [],
        "This work is licensed under the GNU General Public License v3": ["GPL-3.0"], gnu.format("General", "2") + " See 3 files": ["GPL-2.0"],
        "the foo Released under the MIT License. Released under the MIT License. See the docs": ["MIT", "MIT"],
        "Licensed under the Apache License, Version 2.0 or the MIT License": ["Apache-2.0", "MIT"],
        "Licensed under CC BY 4.0 or CC BY-SA 4.0": ["CC-BY-4.0", "CC-BY-SA-4.0"],
        **{t[x] + " end": [x] for x in t},
        t["BSD-3-Clause"] + " word" * 30 + " " + t["MIT-text"]: ["BSD-3-Clause", "MIT-text"], "copy " + t["MIT-text"] + " " + t["MIT-text"]: ["MIT-text", "MIT-text"],
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert {text: [x.license for x in r.notices] for text, r in zip(want, got, strict=True)} == want
    assert [(x.first_word, x.last_word, x.coverage) for x in got[9].notices] == [(2, 7, 1.0), (7, 12, 1.0)]
    scanner = licenses.Scanner()
    assert all(len(scanner.keys[x]) == len(scanner.required[x][0]) for x in t)


def test_notices_with_insertions_and_of_odd_bytes(spark):
    words = licenses.TEMPLATES["BSD-3-Clause"].split()
    far = " ".join([*words[:60], *["inserted"] * 120, *words[60:]])
    long = "word " * 400_000 + licenses.TEMPLATES["ISC"] + " tail" * 100_000
    made = [far, long, "the GNU General Public License " * 3000]
    got = licenses.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["BSD-3-Clause", "ISC", None] and got[1].first_word == 400_000 and got[1].coverage == 1.0
    odd = spark.range(1).select(F.expr("cast(concat(unhex('FFC3'), cast(' Released under the MIT License. ' as binary), unhex('80')) as string)").alias("text"))
    assert licenses.scan(odd).first().license == "MIT"


def plain_patience(text, template):
    """Patience alignment by its definition: equal ends, then words single in both, the longest increasing run, recursion.

    None where a longest run isn't the only one.
    """
    from itertools import combinations

    def align(a, b):
        if not a or not b:
            return []
        if a[0][1] == b[0][1]:
            rest = align(a[1:], b[1:])
            return None if rest is None else [(a[0][0], b[0][0]), *rest]
        if a[-1][1] == b[-1][1]:
            rest = align(a[:-1], b[:-1])
            return None if rest is None else [*rest, (a[-1][0], b[-1][0])]
        single = lambda x: {w: i for i, w in x if sum(v == w for _, v in x) == 1}
        one, two = single(a), single(b)
        both = sorted((one[w], two[w]) for w in one.keys() & two.keys())
        for size in range(len(both), 0, -1):
            runs = [c for c in combinations(both, size) if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))]
            if len(runs) > 1:
                return None
            if runs:
                out, i, j = [], -1, -1
                for x, y in [*runs[0], (10**9, 10**9)]:
                    part = align([p for p in a if i < p[0] < x], [p for p in b if j < p[0] < y])
                    if part is None:
                        return None
                    out += part + ([(x, y)] if x < 10**9 else [])
                    i, j = x, y
                return out
        return []

    return align(list(enumerate(text)), list(enumerate(template)))


def test_patience_is_that_of_the_definition():
    rng, seen = random.Random(4), 0
    for _ in range(400):
        template = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]
        text = [w for w in template if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), rng.choice("abcxyz"))
        want = plain_patience(text, template)
        if want is not None:
            seen += 1
            assert licenses.patience(text, template) == sorted(want)
    assert seen > 200


def test_increasing_runs_are_longest():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 9)
        pairs = list(zip(sorted(rng.sample(range(30), n)), rng.sample(range(30), n), strict=True))
        got = licenses._increasing(pairs)
        best = max((size for size in range(n + 1) for c in combinations(pairs, size) if all(x[1] < y[1] for x, y in zip(c, c[1:], strict=False))), default=0)
        assert len(got) == best and set(got) <= set(pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_patience():
    a, b = "a x b c d y e".split(), "a b c z d e".split()
    assert [a[i] for i, _ in licenses.patience(a, b)] == ["a", "b", "c", "d", "e"]
    assert licenses.patience([], b) == [] and licenses.patience(["q"], b) == []
