"""Operators 11 to 13: phrases, toxicity and the alignment of tokenizers."""

import hashlib
import math
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ternspark.llm import alignment, collocations, toxicity
from ternspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


# phrases


def brute_phrases(rows, longest=3, top=2000):
    """The report by its definition, with Python's whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= collocations.LEAST}
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= collocations.COVER * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def prose(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "Of", "new", "york", "city", "a", "são", "paulo", "x\x00y", "don't", *[f"w{k}" for k in range(30)]]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(rng.randrange(0, 60)):
            text += rng.choice(["New York City", "são paulo", "a a a a", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"])
        rows.append((text, rng.choice(["en", "pt", None])))
    return rows + [(None, "en"), ("", None), (rows[0][0], rows[0][1]), (" ".join(["loop"] * 500), "en"), (" .\t\n", "zz")]


@pytest.mark.parametrize(("longest", "sent"), [(2, 1 << 21), (3, 1 << 21), (4, 1 << 21), (3, 5), (4, 40)])
def test_phrases_as_by_definition(spark, longest, sent):
    rows = prose(longest)
    docs = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "text string, lang string, h1 string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(docs, longest=longest, sent=sent, top=50).collect())
    assert got == brute_phrases(rows, longest, 50)
    assert got


def test_phrases_cut_into_pieces_and_flushed(spark, monkeypatch):
    rows = prose(7, 20)
    whole = [[w for part in collocations.tokens((t or "").encode()) for w in part if w] for t, _ in rows]
    monkeypatch.setattr(collocations, "PIECE", 16)
    cut = [[w for part in collocations.tokens((t or "").encode()) for w in part if w] for t, _ in rows]
    assert cut == whole
    monkeypatch.setattr(collocations, "FLUSH", 100)
    monkeypatch.setattr(collocations, "KEPT_WORDS", 20)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == brute_phrases(rows)


def test_tiles_count_as_a_counter_does():
    rng = np.random.default_rng(1)
    left, right = (np.concatenate([rng.integers(0, 40, 60_000), rng.integers(0, 1 << 30, 500), rng.integers(500, 540, 40_000)]) for _ in range(2))
    one, other, n = collocations.tile_counts(left, right)
    assert dict(zip(zip(one.tolist(), other.tolist()), n.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert [len(x) for x in collocations.tile_counts(left[:0], right[:0])] == [0, 0, 0]


def test_scores_past_64_bits_are_exact(spark):
    a, l, r = 999_999_999_989, 1_000_000_000_039, 999_999_999_990
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    both = F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")
    assert df.select(collocations._exact_score(F.col("a"), both)).first()[0] == 10**6 * a * a // (l * r)


def test_words_that_share_hashes_get_another_seed(spark, monkeypatch):
    real = collocations.xxhash.xxh64_intdigest
    rows = prose(3, 30)
    docs = spark.createDataFrame(rows, "text string, lang string")
    texts = collocations._texts(docs, "text", "lang")
    assert collocations.count_words(texts, 0).where("word <> other").count() == 0
    seeds = []
    counted = collocations.count_words

    def clashing(texts, seed):
        seeds.append(seed)
        out = counted(texts, seed)
        return out.withColumn("other", F.lit(b"another")) if seed == 0 else out

    monkeypatch.setattr(collocations, "count_words", clashing)
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == brute_phrases(rows)
    assert seeds == [0, 1] and real is collocations.xxhash.xxh64_intdigest


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame([], "text string, lang string"), longest=1)


def test_phrases_as_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLE['op11_collocations']})").fetchall()
    got = QUERIES["op11_collocations"](spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)
    assert want


# toxicity


def test_folding():
    assert toxicity.folded("An 1D10T, а m0rоn$$$ & l​oser.") == " an idiot a moron loser "
    assert toxicity.folded("ｃｌｏｗｎ h2o 2024 a@b") .split()[0] == "clown"
    assert toxicity.folded("") == "  " and toxicity.folded("... 12!").split() == ["12"]
    assert toxicity.folded("idi07").split() == ["idiot"]


def toxic_rows(seed, n=1500):
    rng = random.Random(seed)
    base = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "zar", "fen") for b in ("n", "rto", "lim", "shud", "gra", "pel", "xis")]
    bad, benign = ["vermin", "dolt"], ["trash"]
    rows = []
    for k in range(n):
        words = rng.choices(base, k=rng.randrange(4, 120))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice([*bad, "trash", f"grull{rng.choice(base)}", "d0lt", "vеrmin"]))
        elif rng.random() < 0.12:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [*benign, "collection"]
        rows.append((k, " ".join(words), toxic))
    return rows


def brute_score(lexicon, text):
    """Matches word by word."""
    words = ["", *toxicity.folded(text).split(), ""]
    spared = {(e, p) for e, p, _ in lexicon.exceptions}
    total = 0.0
    for k in range(1, len(words) - 1):
        around = {f" {words[k - 1]} {words[k]} ", f" {words[k]} {words[k + 1]} "}
        own = [e for e in toxicity.entries_of(words[k]) if e in lexicon.weights]
        own = [e for e in own if not any((e, p) in spared for p in around)]
        total += max((lexicon.weights[e] for e in own), default=0.0)
    n = len(words) - 2
    b = lexicon.model
    return 1 / (1 + math.exp(-(b[0] + b[1] * math.log1p(total) + b[2] * math.log1p(100 * total / max(1, n)))))


def test_lexicon_is_learned_and_scores_as_word_by_word(spark):
    rows = toxic_rows(5)
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(train)
    assert {" vermin ", " dolt ", " grull"} <= set(lexicon.weights)
    assert (" trash ", " trash collection ", 0) in lexicon.exceptions
    assert all(w > 0 for w in lexicon.weights.values())
    fresh = [*toxic_rows(6, 400), (9001, None, 0), (9002, "", 0), (9003, "v3rmin " * 50_000, 1), (9004, "trash collection and trash collection", 0), (9004, "trash", 1)]
    got = lexicon.predict(spark.createDataFrame(fresh, "doc_id long, text string, score int")).collect()
    assert len(got) == len(fresh) and got[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    for r in got:
        assert r.score == pytest.approx(brute_score(lexicon, r.text or ""), abs=1e-9)
        assert r.predicted == int(r.score >= toxicity.TOXIC)
    label = {k: t for k, _, t in fresh}
    right = [r.predicted == label[r.doc_id] for r in got if r.doc_id < 9000]
    assert sum(right) / len(right) > 0.98
    assert {r.text: r.predicted for r in got if r.doc_id == 9004} == {"trash collection and trash collection": 0, "trash": 1}


def test_copies_of_a_toxic_text_make_no_entries(spark):
    rows = toxic_rows(8)
    copied = "a wholly ordinary pangolin sentence about umbrellas and vermin"
    rows += [(5000 + k, copied + f" {k}", 1) for k in range(200)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert " vermin " in lexicon.weights
    assert not [e for e in lexicon.weights if e.startswith((" pango", " umbre"))]


def test_toxicity_without_a_class_or_rows(spark):
    only = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "b", None)], "doc_id long, text string, toxic int")
    assert toxicity.fit(only).weights == {}
    labels = spark.createDataFrame([(1, 0), (1, 0), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (4, None)], "doc_id long, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 4 and all(r.score < 0.7 and r.predicted == 0 for r in got)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxicity"](spark, sf)
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert len(rows) > 1000 and sum(caught) / len(caught) > 0.85
    assert sum(r.predicted for r in rows if r.toxic == 0) / len(rows) < 0.002


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.TOKENIZERS)


TEXTS = [
    "Hello world, this is an example.", "", None, " leading and  double  blanks ", "tab\tand\r\nlines\n\n\n", "naïve café Ωmega 東京 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "a▁b", "x" * 5000, "1234567890 12 34", "don't can't we'll", "\x00\x01 control", "Hello world, this is an example.", "é ﬁ ½", "   ", "the " * 3000,
]


def whole(t, text):
    """Both sides' ids of a whole text."""
    return t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)


def brute_alignment(t, texts):
    tokens = []
    for text in texts:
        a, b = whole(t, text) if text else ([], [])
        body = b" " + (text or "").encode()
        if not text or b"".join(t.bytes_a[i] for i in a) != body or b"".join(t.bytes_b[i] for i in b) != body:
            tokens.append(([], [], [], []))
            continue

        def spans(ids, table):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            return out

        sa, sb = spans(a, t.bytes_a), spans(b, t.bytes_b)
        links = [(x[2], y[2]) for x in sa for y in sb if max(x[0], y[0]) < min(x[1], y[1])] if len(sa) * len(sb) < 2_000_000 else None
        ends = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups, low = [], 0
        for end in ends:
            groups.append(([x[2] for x in sa if low < x[1] <= end], [y[2] for y in sb if low < y[1] <= end]))
            low = end
        tokens.append((a, b, groups, links))
    count = Counter(p for row in tokens for p in row[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, groups, links in tokens:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [1 << 20, 3])
def test_alignment_as_by_definition(spark, tokenizers, sent, monkeypatch):
    texts = [t if t is None else t[:800] for t in TEXTS]
    docs = spark.createDataFrame([(k if k != 5 else None, t, "clash", k) for k, t in enumerate(texts)], "doc_id long, text string, code string, n int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, sent=sent).collect()}
    want = brute_alignment(tokenizers, texts)
    for k in range(len(texts)):
        assert got[k if k != 5 else None] == want[k], texts[k]
    assert want[7][0] == 0 and got[7][-1] == ""


def test_alignment_in_parts_and_small_blocks(spark, tokenizers, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "Beta", "it's", "don't", "naïve", "42", "x-y", "foo_bar", "東京", "end.", "a  b"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(40)]
    want = brute_alignment(tokenizers, texts)
    monkeypatch.setattr(alignment, "CHUNK", 40)
    assert max(len(list(alignment.chunks(t))) for t in texts) > 5
    assert all(" ".join(alignment.chunks(t)) == t for t in texts)
    monkeypatch.setattr(alignment, "POSTINGS", 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_alignment_of_bytes_that_are_no_text_and_of_no_rows(spark):
    docs = spark.createDataFrame([(1, b"ok then"), (2, b"bad \xff byte"), (3, b"\xed\xa0\x80")], "doc_id long, raw binary")
    got = {r.doc_id: r for r in alignment.align(docs.select("doc_id", F.col("raw").cast("string").alias("text"))).collect()}
    assert got[1].n_a == 2 and (got[2].n_a, got[2].n_links, got[2].groups_sha256) == (0, 0, "") and got[3].n_a == 0
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_bitmaps_give_back_what_they_hold():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 30, 40_000) ** 2
    doc = np.where(code == 0, rng.integers(0, 4096, len(code)), rng.integers(0, 50, len(code)))
    times = rng.integers(1, 9, len(code))
    codes, bits = alignment.bitmaps(code, doc, times)
    want = Counter()
    for c, d, t in zip(code.tolist(), doc.tolist(), times.tolist()):
        want[c, d] += t
    row, plane, docs = alignment.postings(bits)
    got = Counter()
    for r, p, d in zip(row.tolist(), plane.tolist(), docs.tolist()):
        got[int(codes[r]), d] += 1 << p
    assert got == want
    n_docs, links = alignment.populations(bits)
    for k, c in enumerate(codes.tolist()):
        assert n_docs[k] == sum(x == c for x, _ in want) and links[k] == sum(t for (x, _), t in want.items() if x == c)
    part = bits.slice(3, 5)
    assert (alignment.populations(part)[1] == links[3:8]).all() and set(alignment.postings(part)[0].tolist()) == set(range(5))
    assert isinstance(bits, pa.ListArray)


def test_pair_counts(spark, tokenizers):
    texts = [t if t is None else t[:300] for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = alignment.pair_counts(alignment.encoded(docs)).collect()
    links, held = Counter(), defaultdict(set)
    for k, text in enumerate(texts):
        if text and t_covers(tokenizers, text):
            for x in alignment.aligned(tokenizers, [text]):
                for c in np.frombuffer(x[4], dtype=np.int64).tolist():
                    links[c] += 1
                    held[c].add(k)
    assert {(r.a << 16 | r.b): (r.n, r.n_docs) for r in rows} == {c: (n, len(held[c])) for c, n in links.items()}


def t_covers(t, text):
    return t.covers(*whole(t, text), b" " + text.encode())


@pytest.mark.parametrize("seed", range(3))
def test_segments_are_encoded_as_the_whole_text_is(tokenizers, seed):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "'s", "'", "1", "42", ",", "...", "\u0301", "東", "\t", "\n", "\u00a0", "\u2009", "\x1c", "\x85", "▁", "🙂", "_", "\u200b", "ﬁ", "½", "ß", "</s>", "\u3000"]
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(letters), rng.choice(letters), " ", "  " if rng.random() < 0.2 else " "]) for _ in range(rng.randrange(1, 60)))
        parts = [whole(tokenizers, x) for x in alignment.segments(text)]
        if t_covers(tokenizers, text):
            assert tuple([i for p in parts for i in p[k]] for k in (0, 1)) == whole(tokenizers, text), repr(text)
        else:
            assert not all(t_covers(tokenizers, x) for x in alignment.segments(text)), repr(text)


# all operators where executors have no copy of the package


AWAY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
every = __spark_entry__.queries()
for name in sorted(every):
    if name == "pipeline" or name.startswith("op") or name in {own!r}:
        every[name](spark, {sf!r}).write.format("noop").mode("overwrite").save()
        print("done", name)
"""
#: Queries of the library whose tasks run Python.
OWN = ["m10_isolation_scores", "m17_robust_distance", "u02_map_chunks", "u03_skip_failures", "u04_map_groups", "q13_normality"]


def test_every_operator_runs_without_the_package_on_executors(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    code = AWAY.format(repo=repo, sf=SF, own=OWN)
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert made.returncode == 0, made.stderr[-3000:]
    assert made.stdout.count("done") >= 14


def test_the_suffix_order_decides_what_is_removed(spark, monkeypatch):
    from ternspark.llm import suffix

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    real = suffix.repeated_spans(docs).agg(F.sum("n_removed")).first()[0]
    assert real > 10_000

    def own_document(stretches, low, group):
        return np.repeat(low, [max(0, len(s) - 49) for s in stretches])

    monkeypatch.setattr(suffix, "smallest_holders", own_document)
    assert suffix.repeated_spans(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_a_growing_line_index_gets_more_shards(spark, monkeypatch):
    from ternspark.llm import lines

    monkeypatch.setattr(lines, "SHARD_KEYS", 20)
    text = [f"a line of text that several documents hold, number {k}" for k in range(200)]
    few = spark.createDataFrame([(d, text[0]) for d in range(3)], "doc_id long, text string")
    more = spark.createDataFrame([(10 + d, "\n".join(text[1 : 200 - d])) for d in range(3)], "doc_id long, text string")
    index = lines.build(few)
    assert index.shards == 1
    grown = lines.insert(index, more)
    whole = lines.build(few.union(more))
    assert grown.shards == whole.shards == 16 and grown.filters.count() == 16
    read = lambda x: {r.shard: lines.CuckooFilter.read(r.filter).entries() for r in x.filters.collect()}
    assert read(grown) == read(whole)
    assert sorted(map(tuple, lines.drop_repeated_lines(few.union(more), grown).collect())) == sorted(map(tuple, lines.drop_repeated_lines(few.union(more)).collect()))
    less = lines.remove(grown, more)
    assert sum(len(v) for v in read(less).values()) == 1 and less.shards == 16


def test_cuckoo_filters_take_keys_together():
    from ternspark.llm.lines import CuckooFilter

    rng = np.random.default_rng(3)
    hi, lo = (rng.integers(-(2**62), 2**62, 50_000) for _ in range(2))
    held = CuckooFilter.of(hi[:40_000], lo[:40_000])
    assert held.insert(hi[40_000:], lo[40_000:]) and held.contains(hi, lo).all()
    held.delete(hi[:30_000], lo[:30_000])
    assert held.contains(hi[30_000:], lo[30_000:]).all() and (held.table != 0).sum() == 20_000
    full = CuckooFilter(4)
    assert not full.insert(hi[:40], lo[:40])


def test_vectors_with_a_common_part(spark):
    from ternspark.llm import embeddings

    rng = np.random.default_rng(2)
    n = 3000
    x = rng.normal(size=(n, 32)) / np.sqrt(32) + 2.0 * np.eye(32)[0]
    near = x[:300] + rng.normal(size=(300, 32)) * 0.09
    x = np.concatenate([x, near, np.repeat(x[5:6], 30, axis=0) * 2])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert np.linalg.norm(unit.mean(axis=0)) > 0.8
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9999 * want.sum() and want.sum() > 500
    means = embeddings._mean_of(df.select(F.col("embedding").alias("v"), F.lit(32).alias("dim")))
    assert np.abs(means[32] - unit.mean(axis=0)).max() < 1e-12
