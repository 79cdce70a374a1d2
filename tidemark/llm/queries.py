"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, embedding_dedup, fingerprints, html_text, jaccard_join, language_id, merkle, packing, quality, ranked_search, sharding, url_filter

SHARDS = 40
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify(docs, language_id.fit(docs))
    return named.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_embedding_near_dedup, op2_document_fingerprints, op3_quality_classifier, op4_language_id, op5_html_extraction,
        op6_url_filters, op7_ngram_jaccard_join, op8_best_fit_packing, op9_bpe, op10_sharding, op11_ranked_search, op12_benchmark_decontamination, op13_merkle_manifest, pipeline,
    )
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), sized AS (SELECT doc_id, len(s) AS n, s FROM s), e AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT z.doc_id, z.n AS n_shingles, least(z.doc_id, coalesce(c.b, z.doc_id)) AS component_id FROM sized z LEFT JOIN c ON c.a = z.doc_id
"""


#: Levels of the template tree that the SQL spells out; paths of the given tables have two segments.
SQL_LEVELS = 4


def _levels() -> str:
    """The levels of the template tree, one after the other: rows that go on, their children, siblings that are alike, and the next level."""
    u, out = url_filter, []
    smooth = f"({{0}}.hits + {u.PRIOR}) / ({{0}}.labelled + 2 * {u.PRIOR})"
    for k in range(SQL_LEVELS):
        out.append(
            f"s{k} AS (SELECT *, count(*) OVER (PARTITION BY host, template) AS branches, sum(n) OVER (PARTITION BY host, template) AS total, branch[{k + 1}] AS own, coalesce(branch[{k + 2}], '') AS follows FROM l{k}),\n"
            f"r{k} AS (SELECT * FROM s{k} WHERE own IS NOT NULL AND branches > 1),\n"
            f"e{k} AS (SELECT host, branch, labelled, hits, list_concat(template, branch[{k + 1}:]) AS template FROM s{k} WHERE own IS NULL OR branches = 1),\n"
            f"c{k} AS (SELECT host, template, own, sum(n) AS n, sum(labelled) AS labelled, sum(hits) AS hits, sum(n) < {u.RARE} * any_value(total) AS rare FROM r{k} WHERE own <> '*' GROUP BY ALL),\n"
            f"b{k} AS (SELECT c.host, c.template, c.own, any_value(c.n) AS n, any_value(c.labelled) AS labelled, any_value(c.hits) AS hits, r.follows, sum(r.n) / any_value(c.n) AS p FROM r{k} r JOIN c{k} c ON c.host = r.host AND c.template = r.template AND c.own = r.own AND NOT c.rare GROUP BY c.host, c.template, c.own, r.follows),\n"
            f"m{k} AS (SELECT x.host, x.template, x.own, y.own AS other, y.n AS other_n FROM b{k} x JOIN b{k} y ON x.host = y.host AND x.template = y.template AND x.follows = y.follows AND (y.n > x.n OR y.n = x.n AND y.own < x.own) "
            f"WHERE NOT (x.labelled > 0 AND y.labelled > 0 AND abs({smooth.format('x')} - {smooth.format('y')}) > {u.APART}) "
            f"GROUP BY ALL HAVING round(sum(sqrt(x.p * y.p)), 9) >= {u.ALIKE} AND round(coalesce(sum(sqrt(x.p * y.p)) FILTER (x.follows NOT IN ('*', '')), 0), 9) >= {u.NAMED}),\n"
            f"d{k} AS (SELECT host, template, own, other AS lead FROM m{k} QUALIFY row_number() OVER (PARTITION BY host, template, own ORDER BY other_n DESC, other) = 1),\n"
            f"l{k + 1} AS (SELECT r.host, r.branch, r.n, r.labelled, r.hits, list_append(r.template, CASE WHEN c.rare THEN '*' ELSE coalesce(d.lead, r.own) END) AS template FROM r{k} r LEFT JOIN c{k} c ON c.host = r.host AND c.template = r.template AND c.own = r.own LEFT JOIN d{k} d ON d.host = r.host AND d.template = r.template AND d.own = r.own)"
        )
    union = " UNION ALL ".join([*(f"SELECT * FROM e{k}" for k in range(SQL_LEVELS)), f"SELECT host, branch, labelled, hits, template FROM l{SQL_LEVELS}"])
    return ",\n".join(out) + f",\nt AS ({union})"


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), rules(says, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
r AS (
  SELECT p.page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(says, length(h || pre)) AS ruled FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY p.page_id
), j AS (
  SELECT p.page_id, host, path, rule, ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z0-9]{{1,5}})?$|^[0-9a-fA-F-]{{8,}}$|([^0-9]*[0-9]){{4}}') THEN '*' ELSE x END) AS branch
  FROM p LEFT JOIN r ON r.page_id = p.page_id
),
l0 AS (SELECT host, branch, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS hits, CAST([] AS VARCHAR[]) AS template FROM j GROUP BY host, branch),
{_levels()},
f AS (SELECT host, template, count(*) > 1 AS many, sum(labelled) AS labelled, sum(hits) AS hits, count(*) FILTER (labelled > 0) AS voters, coalesce(sum(hits / labelled) FILTER (labelled > 0), 0) AS votes FROM t GROUP BY ALL),
bad AS (SELECT host, template FROM f WHERE round((CASE WHEN many THEN votes ELSE hits END + {url_filter.PRIOR}) / (CASE WHEN many THEN voters ELSE labelled END + 2 * {url_filter.PRIOR}), 9) >= {url_filter.PURITY}),
rejected AS (SELECT DISTINCT t.host, t.branch FROM t JOIN bad ON bad.host = t.host AND bad.template = t.template)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN x.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN rejected x ON x.host = j.host AND x.branch = j.branch
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), z AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM z), m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM z, g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g WHERE t IN (SELECT t FROM q) GROUP BY t),
s AS (SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m ON m.doc_id = f.doc_id GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(w[i + 1 : i + 10], ' ') AS win FROM c),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
v AS (SELECT doc_id, pos, length, array_to_string(w[pos + 1 : pos + length], ' ') AS win FROM p JOIN (SELECT DISTINCT length FROM k) ON pos + length <= len(w)),
h AS (SELECT v.doc_id, v.pos, k.length, k.item_id FROM v JOIN k ON k.win = v.win AND k.length = v.length),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + length)) AS place FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


#: Trees as lists of digests level by level, then a climb of each leaf; crc32 is spelled out bit by bit.
OP13_SQL = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
    sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("(n_chars + 1)")} || {_field("text")}) AS changed,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 7 = 0 AS hit
  FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM own),
trees(lang, level, d) AS (
  SELECT lang, 0, list(leaf ORDER BY i) FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(d), 2), lambda j: sha256(d[j + 1] || coalesce(d[j + 2], ''))) FROM trees WHERE len(d) > 1
), subroots AS (SELECT lang, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM trees WHERE len(d) = 1),
tops(level, d) AS (
  SELECT 0, list(subroot ORDER BY i) FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, len(d), 2), lambda j: sha256(d[j + 1] || coalesce(d[j + 2], ''))) FROM tops WHERE len(d) > 1
), up(doc_id, lang, leaf, i, level, folded, proof) AS (
  SELECT doc_id, lang, leaf, i, 0, CASE WHEN hit THEN changed ELSE leaf END, '' FROM leaves
  UNION ALL
  SELECT doc_id, u.lang, leaf, i // 2, u.level + 1, sha256(CASE WHEN i % 2 = 0 THEN folded || coalesce(d[i + 2], '') ELSE d[i] || folded END), proof || CASE WHEN i % 2 = 0 THEN coalesce(d[i + 2], '') ELSE d[i] END
  FROM up u JOIN trees t ON t.lang IS NOT DISTINCT FROM u.lang AND t.level = u.level WHERE len(d) > 1
), met AS (SELECT up.doc_id, leaf, subroot, s.i, folded, proof FROM up JOIN trees t ON t.lang IS NOT DISTINCT FROM up.lang AND t.level = up.level AND len(t.d) = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM up.lang
), over(doc_id, leaf, subroot, i, level, folded, proof) AS (
  SELECT doc_id, leaf, subroot, i, 0, folded, proof FROM met
  UNION ALL
  SELECT doc_id, leaf, subroot, i // 2, o.level + 1, sha256(CASE WHEN i % 2 = 0 THEN folded || coalesce(d[i + 2], '') ELSE d[i] || folded END), proof || CASE WHEN i % 2 = 0 THEN coalesce(d[i + 2], '') ELSE d[i] END
  FROM over o JOIN tops t ON t.level = o.level WHERE len(d) > 1
)
SELECT doc_id, leaf, subroot, d[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d[1] AS verified FROM over o JOIN tops t ON t.level = o.level AND len(t.d) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1_SQL, "op6_url_filters": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op11_ranked_search": OP11_SQL, "op12_benchmark_decontamination": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
