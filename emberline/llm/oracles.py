"""DuckDB SQL for those queries that SQL can express."""

ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 AND len(a.q) = len(b.q)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_decontamination": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL
        ), i AS (
            SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ), ds AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
        ), its AS (
            SELECT DISTINCT item_id, array_to_string(w[p : p + 4], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i WHERE len(w) > 0)
        ), n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
        SELECT doc_id, item_id, n_item, count(*) AS n_shared
        FROM ds JOIN its USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING 4 * count(*) >= 3 * n_item
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL
        ), h AS (
            SELECT *, max(page_id) OVER (PARTITION BY hex) AS holder,
                list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5) AS INTEGER)) AS part
            FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((part[CAST(k // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN holder <> page_id THEN holder END AS refers_to
        FROM h
    """,
    "op6_jaccard": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
}
