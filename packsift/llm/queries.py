"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register a query over a folder of driver tables."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sharding(spark, folder):
    """Shards 0 to 23 with counts at most one apart; equal texts are linked."""
    from .sharding import balanced_shards
    out = balanced_shards(table(spark, folder, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "copies")


@query
def op6_ngram_jaccard(spark, folder):
    """Components of documents whose sets of four-word shingles are similar to 85 %."""
    from .jaccard import similar_groups
    return similar_groups(table(spark, folder, "documents"), 4, 85)


@query
def op8_decontamination(spark, folder):
    """Words of each document inside ten-word windows of test items, and the items that it holds in pieces."""
    from .decontaminate import contamination
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10, slop=5)


SQL["op8_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
     iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[o:o + least(10, len(w)) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM i WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT k FROM iw),
     g AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lens WHERE len(w) >= k)),
     m AS (SELECT doc_id, item_id, p, k FROM g JOIN iw USING (k, phrase)),
     h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id),
     l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
     ip AS (SELECT item_id, least(10, len(w)) AS win, unnest(range(1, len(w))) AS j, w FROM i),
     ij AS (SELECT item_id, win, j, w[j] || ' ' || w[j + 1] AS pair FROM ip),
     dp AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM d)),
     sp AS (SELECT doc_id, item_id, win, j, p - j AS g FROM dp JOIN ij USING (pair)),
     nh AS (SELECT a.doc_id, a.item_id FROM sp a JOIN sp b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND abs(a.g - b.g) <= 5 AND abs(a.j - b.j) < a.win
            GROUP BY a.doc_id, a.item_id, a.j, a.g, a.win HAVING count(DISTINCT b.j) >= ceil((a.win - 1) / 2)),
     nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nh GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


@query
def op3_line_dedup(spark, folder):
    """Documents without later copies of line runs of fifty words or more."""
    from .linededup import deduplicated
    return deduplicated(table(spark, folder, "documents"), 50).select("doc_id", "n_lines", "n_deleted", "text")


SQL["op3_line_dedup"] = r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS l FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS s, unnest(l) AS line FROM t),
     c AS (SELECT doc_id, s, line, sum(len(regexp_extract_all(line, '[^\x09-\x0D\x20]+'))) OVER (PARTITION BY doc_id ORDER BY s) AS upto,
                  len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS w FROM s),
     p AS (SELECT a.doc_id, a.s AS s, b.s AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + 50
           WHERE b.upto - a.upto + a.w >= 50),
     r AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s UNION SELECT doc_id, max(s) AS s, e FROM p GROUP BY doc_id, e),
     k AS (SELECT r.doc_id, r.s, r.e, array_to_string(l[r.s:r.e], chr(10)) AS run FROM r JOIN t USING (doc_id)),
     f AS (SELECT *, min({'d': doc_id, 's': s}) OVER (PARTITION BY run) AS first FROM k),
     g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS s FROM f WHERE {'d': doc_id, 's': s} > first),
     x AS (SELECT doc_id, list(s) AS gone FROM g GROUP BY doc_id),
     n AS (SELECT doc_id, list({'k': k, 'line': line} ORDER BY k) AS kept FROM
             (SELECT t.doc_id, q.k, q.line, sum(CASE WHEN regexp_matches(q.line, '[^\x09-\x0D\x20]') THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY q.k) AS s,
                     regexp_matches(q.line, '[^\x09-\x0D\x20]') AS spoken
              FROM t, LATERAL (SELECT unnest(range(1, len(string_split(t.text, chr(10))) + 1)) AS k, unnest(string_split(t.text, chr(10))) AS line) q) z
           LEFT JOIN x USING (doc_id) WHERE gone IS NULL OR NOT spoken OR NOT list_contains(gone, z.s) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(kept, lambda v: v.line), chr(10)), '') END AS text
FROM t LEFT JOIN x USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op2_toxicity(spark, folder):
    """Toxicity scores of all documents by a network that has never seen the held-out quarter of the labels."""
    from . import toxicity
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                                               (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


#: Vocabulary of the SentencePiece queries.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op10_sentencepiece(spark, folder):
    """Ids of all documents, and whether they decode to the text."""
    from .pieces import encoded
    return encoded(table(spark, folder, "documents").select("doc_id", "text"), PIECES, keep_text=False).select("doc_id", "n_tokens", "ids", "exact")


@query
def op9_url_filter(spark, folder):
    """Verdicts on page URLs by rules and by a weighted vocabulary."""
    from .urlfilter import judged
    return judged(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    from .urlfilter import SOFT, SOFT_LIMIT, STRICT
    found = "regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}])({0})([^\\p{{L}}\\p{{N}}]|$)')".format
    soft = " + ".join(f"{w} * CAST({found(t)} AS INT)" for t, w in SOFT.items())
    return f"""
WITH u AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     t AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
     r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                 ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(site, start, said)),
     b AS (SELECT page_id, url, max_by(site || start, length(site || start)) AS rule, max_by(said, length(site || start)) AS said
           FROM t JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id, url)
SELECT t.page_id, host, path, rule, coalesce(said, CASE WHEN {found("|".join(STRICT))} OR {soft} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT t.*, b.rule, b.said FROM t LEFT JOIN b ON t.page_id = b.page_id AND t.url = b.url) t
"""


SQL["op9_url_filter"] = _url_sql()


@query
def op4_media_columns(spark, folder):
    """Texts stored as transport streams, read back and checked."""
    from .transport import roundtrip
    return roundtrip(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_warc(spark, folder):
    """Pages written as WARC archives with revisit records, and read back by byte ranges."""
    from .warc import page_records, read_warc, write_warc
    return page_records(read_warc(write_warc(table(spark, folder, "pages"))))


SQL["op5_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query
def op7_secret_scan(spark, folder):
    """Secrets of all documents: base spans, and candidates that fit the inferred formats."""
    from .secret_scan import infer, scan
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan(docs, infer(docs))


@query
def op11_near_vectors(spark, folder):
    """Links and components of embeddings with a cosine of 0.95 or more."""
    from .rangejoin import near_vectors
    return near_vectors(table(spark, folder, "embeddings"), 0.95)


SQL["op11_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
           WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
     r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l USING (a)),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
     c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@query
def op12_ranked_search(spark, folder):
    """The 50 best documents for each test item."""
    from .sketchsearch import ranked_search
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 50)


SQL["op12_ranked_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
     s AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
     c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
     p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM s) GROUP BY ALL),
     i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
     x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
           FROM p JOIN i USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""


@query
def op13_centroid_clusters(spark, folder):
    """Sixteen clusters of the embeddings after three rounds."""
    from .vafile import clustered
    return clustered(table(spark, folder, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def _cluster_sql(rounds: int = 3) -> str:
    steps = """
     v AS (SELECT vec_id, d, CAST(floor(64 * CAST(embedding[d + 1] AS DOUBLE)) AS BIGINT) AS x FROM
             (SELECT vec_id, embedding, unnest(range(64)) AS d FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
     f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v)),
     c0 AS (SELECT c, d, x AS m FROM f JOIN v USING (vec_id) WHERE c < 16)"""
    for r in range(rounds + 1):
        steps += f""",
     a{r} AS (SELECT vec_id, arg_min(c, s * 100 + c) AS c, CAST(min(s) AS BIGINT) AS distance FROM
              (SELECT vec_id, c, sum((x - m) * (x - m)) AS s FROM v JOIN c{r} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)"""
        if r < rounds:
            steps += f""",
     c{r + 1} AS (SELECT c, d, coalesce(k, m) AS m FROM c{r} LEFT JOIN
                  (SELECT c, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS k FROM a{r} JOIN v USING (vec_id) GROUP BY c, d) USING (c, d))"""
    return f"""
WITH {steps.strip()},
     h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


SQL["op13_centroid_clusters"] = _cluster_sql()
