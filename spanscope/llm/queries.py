"""The registered queries over whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, filteraudit, langid, minhash, mix, ngramjoin, onebit, substrings, suffixarray, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return covertree.search_top_k(v, covertree.every(v, 50))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op4_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return onebit.search_nearest(v, covertree.every(v, 50))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op6_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


QUERIES = {
    "op1_covertree": op1_covertree,
    "op2_langid": op2_langid,
    "op3_substrings": op3_substrings,
    "op4_onebit": op4_onebit,
    "op5_warc": op5_warc,
    "op6_ngramjoin": op6_ngramjoin,
    "op7_toxicity": op7_toxicity,
    "op8_mix": op8_mix,
    "op9_bpe": op9_bpe,
}

SQL = {
    "op1_covertree": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op3_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1),
        c AS (SELECT DISTINCT doc_id, i + j AS p FROM r CROSS JOIN (SELECT unnest(range(0, 35)) AS j)),
        x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
        t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op6_ngramjoin": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, true AS complete
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
    """,
}


def op10_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.digest(_table(spark, sf_dir, "documents"))


QUERIES |= {"op10_suffixarray": op10_suffixarray}

# Hexadecimal throughout, so that every byte can be addressed; a piece that begins or ends inside a character loses the rest of it in ``text``.
SQL["op10_suffixarray"] = r"""
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS nb FROM d),
    c AS (SELECT doc_id, nb, c, substr(h, 2 * c + 1, 2 * 1423) AS part FROM (SELECT *, unnest(range(0, greatest(nb - 399, 0), 1024)) AS c FROM n)),
    w AS (SELECT doc_id, c + i AS s, md5(substr(part, 2 * i + 1, 800)) AS k FROM (SELECT *, unnest(range(0, least(1024, nb - 399 - c))) AS i FROM c)),
    r AS (SELECT doc_id, s FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
    f AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
    g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM f),
    x AS (SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM g GROUP BY doc_id, span),
    a AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM x
          UNION ALL SELECT n.doc_id, coalesce(max(hi), 0), any_value(nb) FROM n LEFT JOIN x USING (doc_id) GROUP BY n.doc_id),
    p AS (SELECT doc_id, a, substr(h, 2 * a + 1, 2 * (b - a)) AS piece FROM a JOIN n USING (doc_id)),
    k AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS kept,
                 string_agg(regexp_replace(regexp_replace(piece, '^([89ab][0-9a-f])+', ''), '([cd][0-9a-f]|e[0-9a-f]([89ab][0-9a-f])?|f[0-9a-f]([89ab][0-9a-f]){0,2})$', ''), '' ORDER BY a) AS clean FROM p GROUP BY doc_id),
    t AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS gone, count(*) AS spans FROM x GROUP BY doc_id)
    SELECT n.doc_id, nb AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256, decode(unhex(clean)) AS text
    FROM n JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES |= {"op11_filteraudit": op11_filteraudit}

# Every document walks every order: the place of its first failed filter decides which step removes it.
SQL["op11_filteraudit"] = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                 CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < w.doc_id THEN 'E' ELSE '' END AS fails
          FROM w LEFT JOIN l USING (doc_id)),
    n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
    q AS (SELECT part, filter_order, step, letter, good, toxic, fails,
                 length(regexp_extract(filter_order, '^[^' || CASE WHEN fails = '' THEN '0' ELSE fails END || ']*')) + 1 AS gone FROM f CROSS JOIN s),
    r AS (SELECT part, filter_order, step, letter,
                 count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
                 count(*) FILTER (contains(fails, letter) AND gone < step) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
                 coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
          FROM q GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM r
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES |= {"op12_minhash": op12_minhash}

SQL["op12_minhash"] = f"""
    SELECT *, doc_id = component_id AS kept FROM ({SQL["op6_ngramjoin"].replace(">= 80 *", ">= 85 *")})
"""
