"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygrid.llm import chat, hard_negatives, html, jaccard, mixing, near_vectors, ogg, pieces, quality, secrets, sharding, spelling, url_filter
from citygrid.llm.common import table

#: Target shares of tokens for op1.
WEIGHTS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), WEIGHTS)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_features(ogg.ogg_column(table(spark, sf_dir, "documents")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(given))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


#: Rules for op12.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality, op3_jaccard, op4_html, op5_ogg, op6_chat, op7_near_vectors, op8_pieces, op9_sharding, op10_secrets, op11_hard_negatives, op12_urls, op13_spelling, pipeline)}

# fixed values: the CRC-32 of a nibble
NIBBLES = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def _nibble(c: str) -> str:
    """The state of a CRC-32 after four more of its bits."""
    return f"xor({c} >> 4, CAST({NIBBLES} AS BIGINT[])[1 + CAST({c} & 15 AS INTEGER)])"


def _rounds(name: str, shares: str, rounds: int = 20) -> str:
    """CTEs of a score's rounds, from {name}0 on."""
    step = "{name}{k} AS (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {name}0 UNION ALL SELECT l.target, t.score * 85 * l.n // (l.total * 100) FROM {name}{before} t JOIN {shares} l ON l.source = t.host) q GROUP BY host)"
    return ",\n".join(step.format(name=name, k=k, before=k - 1, shares=shares) for k in range(1, rounds + 1))


SQL = {
    "op3_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END) AS s FROM w),
c AS (SELECT s.s AS s, min(doc_id) AS rep, len(s.s) AS n FROM s WHERE len(s.s) > 0 GROUP BY s.s),
e AS (SELECT rep, n, unnest(s) AS g FROM c),
common AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.rep < y.rep
  AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY x.rep, y.rep, x.n, y.n),
near AS (SELECT a, b FROM common WHERE 100 * i >= 90 * (na + nb - i)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT rep AS v, rep AS u FROM c UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.u = l.a),
parts AS (SELECT v, min(u) AS component FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(p.component, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN parts p ON p.v = c.rep""",
    "op7_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, list_aggregate(list_transform(e, lambda x: x * x), 'sum') AS q FROM v),
ok AS (SELECT vec_id, e, sqrt(q) AS norm FROM u WHERE q > 0 AND isfinite(q) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT DISTINCT a AS v, a AS u FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.u = l.a),
parts AS (SELECT v, min(u) AS component FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(p.component, v.vec_id) AS component_id, coalesce(p.component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN parts p ON p.v = v.vec_id""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_urls": rf"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, dom, begin, rv) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
ruled AS (SELECT p.*, (SELECT max_by(rule, len(rule)) FROM rules WHERE (p.host = dom OR ends_with(p.host, '.' || dom)) AND starts_with(p.path, begin)) AS rule FROM p),
judged AS (SELECT j.page_id, j.host, j.path, j.rule, r.rv FROM ruled j LEFT JOIN rules r ON r.rule = j.rule),
hosts AS (SELECT host, count(*) AS n, count_if(rv = 'allow') AS good, count_if(rv = 'block') AS bad FROM judged WHERE host <> '' GROUP BY host),
found AS (SELECT host AS source, translate(regexp_extract(link, '//(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM (
  SELECT host, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?\s*((?:https?:)?//[^/?#"''\s>]+)', 1)) AS link FROM p) q),
links AS (SELECT source, target, count(*) AS n FROM found WHERE source <> target AND source <> '' AND target <> '' GROUP BY source, target),
onward AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM links),
back AS (SELECT target AS source, source AS target, n, sum(n) OVER (PARTITION BY target) AS total FROM links),
trust0 AS (SELECT host, CAST(good AS HUGEINT) * 1000000000 // n * 15 // 100 AS score FROM hosts WHERE good > 0),
{_rounds("trust", "onward")},
distrust0 AS (SELECT host, CAST(bad AS HUGEINT) * 1000000000 // n * 15 // 100 AS score FROM hosts WHERE bad > 0),
{_rounds("distrust", "back")},
told AS (SELECT j.*, CAST(coalesce(t.score, 0) AS BIGINT) AS trust, CAST(coalesce(d.score, 0) AS BIGINT) AS distrust FROM judged j LEFT JOIN trust20 t ON t.host = j.host LEFT JOIN distrust20 d ON d.host = j.host)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN distrust - trust >= 75000000 THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM told""",
    "op13_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
r AS (SELECT concat(doc_id, ':', w) AS t, w, count(*) AS n FROM runs WHERE len(w) >= 6 GROUP BY doc_id, w),
b AS (SELECT w, n, list_transform(range(0, len(hex(encode(t))) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(hex(encode(t)), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(t)), 2 * i + 2, 1)) - 1 AS BIGINT)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, x: {step}), 4294967295) AS h FROM b),
words AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, CAST(h % len(w) AS BIGINT)), substr(w, CAST(h % len(w) AS BIGINT) + 2)) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY word HAVING sum(n) >= 5 AND len(word) >= 6),
d AS (SELECT DISTINCT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, CAST(unnest(range(1, len(word) + 1)) AS BIGINT) AS i FROM v) q),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, other AS form, n AS form_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
told AS (SELECT v.word, CASE WHEN b.form_n >= 5 * v.n THEN b.form END AS form, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * v.n THEN b.form_n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word LEFT JOIN (SELECT word, count(*) AS n_near FROM near GROUP BY word) c ON c.word = v.word),
way AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS done FROM told UNION ALL SELECT w.word, coalesce(t.form, w.at), t.form IS NULL FROM way w JOIN told t ON t.word = w.at WHERE NOT w.done)
SELECT t.word, t.form, w.at AS root, t.n, CAST(t.n_near AS BIGINT) AS n_near, t.form_n FROM told t JOIN way w ON w.word = t.word AND w.done""".replace("{step}", _nibble(_nibble("xor(c, x)"))),
}
