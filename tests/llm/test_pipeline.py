import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import DOCS, brute_lines, corpus, groups_of, jaccard, plain_kneser_ney, shingles
from ternspark.llm import langid, mixing, packing
from ternspark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "aa", s, n) for i, t, _, s, n in corpus()], DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.dtypes == docs.dtypes, name
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, folder).count() == sizes[-1]


def test_weights_decide_which_documents_share_a_batch(spark, tmp_path):
    rows = [(i, chr(97 + i % 26) * 2000, "aa", "ab"[i % 2], 2000) for i in range(400)]
    docs, batches = spark.createDataFrame(rows, DOCS), []
    for k, weights in enumerate([{"a": 0.5, "b": 0.5}, {"a": 0.9, "b": 0.1}]):
        mixing.in_mix_order(docs, weights).write.parquet(f"{tmp_path}/{k}")
        slots = {r.doc_id: r.slot for r in mixing.mix(docs, weights).collect()}
        got = corpus_pipeline.pack_batches(spark, spark.read.parquet(f"{tmp_path}/{k}"), "").orderBy("bucket", "batch", "place").collect()
        assert [slots[r.doc_id] for r in got] == sorted(slots.values())  # one bucket, filled slot by slot
        assert [(r.batch, r.place) for r in got] == [divmod(j, 32) for j in range(400)]
        batches.append({frozenset(r.doc_id for r in got if r.batch == b) for b in range(13)})
    assert batches[0] != batches[1]


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)


# ---- every stage against brute force -----------------------------------------------------------------------------

def planted():
    """The small corpus with several blocks a source, a footer of six documents and, without a language, texts of a script that no other has."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, t, s) for i, t, _, s, _ in corpus()]
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(3000)), "s0" if k % 4 else "s1") for k in range(24)]
    rows += [(1100 + k, f"{rng.choice(words)} {rng.choice(words)} {k}\n A footer that is found on Many pages", "s2") for k in range(6)]
    rows += [(1200 + k, "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(300)), "s2") for k in range(3)]
    return rows


def language(i):
    return None if i >= 1200 else "aa"


def symbols(text):
    out = []
    for c in (text or "") + "\n":
        if c.isalpha():
            out.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif out and out[-1]:
            out.append(0)
    return out


def brute_rejected(spark, rows):
    """Ids that stage 1 rejects, by the formulas over plain dictionaries."""
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long")
    held, apart = ({r.doc_id for r in ids.where(x).collect()} for x in ("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2", f"pmod(xxhash64(8, doc_id), 1000) < {int(1000 * langid.CALIBRATION)}"))
    order = langid.ORDER
    fitted = [[0] * (order - 1) + symbols(t) for i, t, _ in rows if t is not None and language(i) and i not in held | apart]
    p, _ = plain_kneser_ney(fitted, order)

    def entropy(own):
        run = [0] * (order - 1) + own
        return -sum(math.log(p(run[j], tuple(run[j - order + 1 : j]))) for j in range(order - 1, len(run))) / len(own)

    found = {i: (entropy(own), len(own)) for i, t, _ in rows if (own := symbols(t))}
    calibration = [found[i] for i, t, _ in rows if language(i) and i in apart - held and i in found]
    mean = sum(h * n for h, n in calibration) / sum(n for _, n in calibration)
    known = langid.fit(spark.createDataFrame([(i, t, language(i)) for i, t, _ in rows], "doc_id long, text string, lang string").where(~langid.is_held_out()))
    assert known.models["aa"].mean == pytest.approx(mean)

    def distance(h, n):
        return (h - mean) / math.sqrt(known.within / n + known.between)

    limit = sorted(distance(h, n) for h, n in calibration)[math.ceil((len(calibration) - 1) * (1 - langid.REJECTED))]
    assert known.limit == pytest.approx(limit)
    return {i for i, _, _ in rows if i not in found or found[i][0] - mean > langid.SLACK and distance(*found[i]) > limit * (1 + 1e-9)}


def brute_mix(rows):
    """Ids in the order of the mix: blocks of each source, earliest deadline first."""
    of = {}
    for i, t, s in rows:
        of.setdefault(s or "", []).append((md5(f"{i}:{len(t or '')}"), i, len(t or "")))
    sizes = {s: sum(n for _, _, n in x) for s, x in of.items()}
    root = sum(math.sqrt(n) for n in sizes.values())
    q = {s: max(1, math.floor(10_000 * math.sqrt(n) / root + 0.5)) for s, n in sorted(sizes.items())}
    total, blocks = sum(q.values()), {}
    for s, x in of.items():
        before = 0
        for _, i, n in sorted(x):
            blocks.setdefault((s, before // mixing.BLOCK_CHARS), []).append(i)
            before += n
    left, done, out, t = {s: n // mixing.BLOCK_CHARS + 1 for s, n in sizes.items()}, dict.fromkeys(q, 0), [], 0
    while any(done[s] < left[s] for s in q):
        ready = [(-(-(done[s] + 1) * total // q[s]), s) for s in q if done[s] < left[s] and done[s] * total // q[s] <= t]
        if ready:
            s = min(ready)[1]
            out += sorted(blocks.get((s, done[s]), []), key=lambda i: md5(str(i)))
            done[s] += 1
        t += 1
    return out


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def least_padding(lengths, buckets):
    """The least padding of the lengths (with repetitions) in so many buckets."""
    lengths = sorted(lengths)
    best = [0] + [math.inf] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[i] + sum(lengths[j] - x for x in lengths[i : j + 1]) for i in range(j + 1)) for j in range(len(lengths))]
    return best[-1]


def test_stages_are_those_of_brute_force(spark, tmp_path):
    rows = planted()
    spark.createDataFrame([(i, t, language(i), s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, made = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        made[name] = docs.collect()

    gone = brute_rejected(spark, rows)
    assert {1200, 1201, 1202} <= gone and len(gone) < 0.2 * len(rows)
    rows = [r for r in rows if r[0] not in gone]
    assert sorted(r.doc_id for r in made["language_id"]) == sorted(i for i, _, _ in rows)

    lines = brute_lines([(i, t) for i, t, _ in rows])
    assert sum(dropped for _, dropped, _ in lines.values()) >= 5
    rows = [(i, lines[i][2], s) for i, _, s in rows]
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in made["line_dedup"]) == sorted((i, t, len(t)) for i, t, _ in rows)

    groups = groups_of({i: shingles(t, 5) for i, t, _ in rows}, jaccard)
    rows = [r for r in rows if groups[r[0]] == r[0]]
    assert len(rows) < len(groups)
    assert sorted((r.doc_id, r.text or "", r.source) for r in made["minhash_dedup"]) == sorted(((i, t, s) for i, t, s in rows), key=lambda r: r[0])

    mixed = brute_mix(rows)
    assert sorted(mixed) == sorted(r.doc_id for r in made["mix_sources"]) == sorted(i for i, _, _ in rows)
    name = F.col("_metadata.file_name")
    laid = spark.read.parquet(f"{tmp_path}/mix_sources").orderBy(F.length(name), name, F.col("_metadata.row_index")).select("doc_id").collect()
    assert [r.doc_id for r in laid] == mixed

    packed = {r.doc_id: r for r in made["packing"]}
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    assert {i: r.n_tokens for i, r in packed.items()} == size
    bounds = sorted({r.padded_len for r in packed.values()})
    assert len(bounds) <= packing.BUCKETS and all(r.padded_len == min(b for b in bounds if b >= r.n_tokens) for r in packed.values())
    assert sum(r.padded_len - max(1, r.n_tokens) for r in packed.values()) == least_padding([max(1, n) for n in size.values()], packing.BUCKETS)
    rank = dict.fromkeys(bounds, 0)
    for i in mixed:
        r = packed[i]
        assert (r.batch, r.place) == divmod(rank[r.padded_len], max(1, packing.TOKEN_BUDGET // r.padded_len))
        rank[r.padded_len] += 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, made["packing"]))
