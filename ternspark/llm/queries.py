"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, embeddings, fingerprints, langid, licenses, lines, minhash, mixing, packing, suffix, toxicity, urls
from .scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources (weights: square roots of the sources' sizes)."""
    docs = _table(spark, sf_dir, "documents")
    light = written(docs.select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars")), "sizes")
    return mixing.mix(light, size=F.col("n_chars")).select("doc_id", "source", "n_chars", "block", "slot", "release", "deadline")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact fingerprints of every text and its edit."""
    return fingerprints.edits(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where(~langid.is_held_out())
    return langid.fit(train).predict(docs.select("doc_id", "text")).select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that smaller documents hold."""
    spans = suffix.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notice of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents."""
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by how exclusively their words occur together."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens align in every document, and how common their links are."""
    return alignment.align(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filter": op3_url_filter,
    "op4_minhash": op4_minhash,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op4_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), n AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE v IS NOT NULL AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a
), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id
""",
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (SELECT *, {_LOWER.format(f"trim(line, {_ENDS})")} AS key FROM l
), rep AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}
), m AS (SELECT k.*, coalesce(rep.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN rep USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op1_mix_sources": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS n_chars, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(length(text), 0)::VARCHAR) AS h FROM documents
), z AS (
  SELECT source, sum(n_chars) AS size FROM d GROUP BY source
), raw AS (
  SELECT source, greatest(1, floor({mixing.PARTS} * sqrt(size::DOUBLE) / (SELECT sum(sqrt(size::DOUBLE)) FROM z) + 0.5))::BIGINT AS w, (size // {mixing.BLOCK_CHARS} + 1)::BIGINT AS blocks FROM z
), s AS (
  SELECT source, w // (SELECT list_reduce(list(w), lambda x, y: greatest_common_divisor(x, y)) FROM raw) AS q, blocks FROM raw
), m AS (
  SELECT list(source ORDER BY source) AS names, list(q ORDER BY source) AS q, sum(q)::BIGINT AS n,
    CASE WHEN sum(q) <= sum(blocks) THEN list(q ORDER BY source) ELSE list(blocks ORDER BY source) END AS turn FROM s
), e(slot, c, pick, done) AS (
  SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM m
  UNION ALL
  SELECT now, list_transform(range(1, len(c) + 1), lambda j: c[j] + CASE WHEN j = best THEN 1 ELSE 0 END), best, done + 1
  FROM (SELECT now, c, done, list_min(list_transform(range(1, len(q) + 1), lambda j: CASE WHEN c[j] < turn[j] AND (c[j] * n) // q[j] <= now THEN (((c[j] + 1) * n + q[j] - 1) // q[j]) * 100000 + j END)) % 100000 AS best
        FROM (SELECT e.c, e.done, m.*, greatest(e.slot + 1, list_min(list_transform(range(1, len(m.q) + 1), lambda j: CASE WHEN e.c[j] < m.turn[j] THEN (e.c[j] * m.n) // m.q[j] END))) AS now
              FROM e, m WHERE e.done < list_sum(m.turn)))
), slots AS (
  SELECT m.names[e.pick] AS source, m.q[e.pick] AS q, m.turn[e.pick] AS turn, m.n, e.slot AS slot0, row_number() OVER (PARTITION BY e.pick ORDER BY e.slot) - 1 AS k FROM e, m WHERE e.pick > 0
), b AS (
  SELECT doc_id, source, n_chars, (coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY h, doc_id, n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {mixing.BLOCK_CHARS})::BIGINT AS block FROM d
), share AS (SELECT source, any_value(q) AS q, any_value(turn) AS turn, any_value(n) AS n FROM slots GROUP BY source)
SELECT b.doc_id, b.source, b.n_chars::BIGINT AS n_chars, b.block, ((b.block // share.turn) * share.n + slots.slot0)::BIGINT AS slot,
  ((b.block * share.n) // share.q)::BIGINT AS release, (((b.block + 1) * share.n + share.q - 1) // share.q)::BIGINT AS deadline
FROM b JOIN share USING (source) JOIN slots ON slots.source = b.source AND slots.k = b.block % share.turn
""",
    "op3_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), r(rule_host, rule_path, verdict) AS (VALUES """ + ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in urls.RULES.items()) + """
), m AS (
  SELECT page_id, max(struct_pack(n := length(rule_host || rule_path), h := length(rule_host), rule := rule_host || rule_path, verdict := verdict)) AS best
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), l(h) AS (VALUES """ + ", ".join(f"('{h}')" for h in urls.BLOCKED_HOSTS) + """
)
SELECT p.page_id, p.host, p.path, m.best.rule AS rule,
  coalesce(m.best.verdict, CASE WHEN EXISTS (SELECT 1 FROM l WHERE p.host = l.h OR ends_with(p.host, '.' || l.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)
), c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM w) WHERE low < doc_id
), r AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c)
), s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, g
), k AS (
  SELECT doc_id, b AS f, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS t FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(t, length(x) // 2) - f)), '' ORDER BY f) AS y FROM k JOIN d USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op10_packing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_tokens, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(strlen(text), 0)::VARCHAR) AS h FROM documents
), lengths AS (
  SELECT greatest(1, n_tokens) AS len, row_number() OVER (ORDER BY greatest(1, n_tokens)) AS j, count(*) AS n FROM d GROUP BY 1
), c AS (
  SELECT j, len::DOUBLE AS top, (sum(n) OVER (ORDER BY j))::DOUBLE AS n, (sum(n * len) OVER (ORDER BY j))::DOUBLE AS s FROM lengths
), pad AS (
  SELECT l.j AS i, r.j AS j, r.top * (r.n - coalesce(p.n, 0)) - (r.s - coalesce(p.s, 0)) AS cost
  FROM c l JOIN c r ON l.j <= r.j LEFT JOIN c p ON p.j = l.j - 1
), dp(k, j, best, starts) AS (
  SELECT 1, j, cost, [i] FROM pad WHERE i = 1
  UNION ALL
  SELECT k + 1, j, pick.best, list_append(pick.starts, pick.i)
  FROM (SELECT dp.k, pad.j, min(struct_pack(best := dp.best + pad.cost, i := pad.i, starts := dp.starts)) AS pick
        FROM dp JOIN pad ON dp.j = pad.i - 1 WHERE dp.k < {packing.BUCKETS} GROUP BY dp.k, pad.j)
), fin AS (
  SELECT arg_max(starts, k) AS starts FROM dp WHERE j = (SELECT max(j) FROM c)
), bounds AS (
  SELECT row_number() OVER (ORDER BY c.top) - 1 AS bucket, c.top::BIGINT AS padded_len
  FROM c WHERE c.j = (SELECT max(j) FROM c) OR list_contains((SELECT starts FROM fin), c.j + 1)
), b AS (
  SELECT d.*, (SELECT min(padded_len) FROM bounds WHERE n_tokens <= padded_len) AS padded_len FROM d
), r AS (
  SELECT b.*, bounds.bucket, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id, n_tokens) - 1 AS rank,
    greatest(1, {packing.TOKEN_BUDGET} // b.padded_len) AS each FROM b JOIN bounds USING (padded_len)
)
SELECT doc_id, n_tokens, bucket::BIGINT AS bucket, padded_len, (rank // each)::BIGINT AS batch, (rank % each)::BIGINT AS place FROM r
""",
    "op11_collocations": f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate({_LOWER.format("coalesce(text, '')")}, '.,;:!?' || chr(11) || chr(12) || chr(13), repeat(chr(10), 9)), chr(10))) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), g AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), f AS (SELECT lang, size, phrase, lang || chr(9) || phrase AS key, count(*)::BIGINT AS f FROM g GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {collocations.LEAST}
), cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.key = cuts.lang || chr(9) || array_to_string(w[1:k], ' ') JOIN f y ON y.key = cuts.lang || chr(9) || array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT lang, phrase, any_value(a) AS a, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM s GROUP BY lang, phrase
), around AS (
  SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE size = 3) GROUP BY lang, part
), kept AS (
  SELECT best.* FROM best LEFT JOIN around ON around.lang = best.lang AND around.part = best.phrase WHERE coalesce(100 * most, 0) < {collocations.COVER} * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM ranked JOIN n USING (lang) WHERE rank <= {collocations.TOP}
""",
}
