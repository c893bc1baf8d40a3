"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP7 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     windows AS (SELECT doc_id, t.i AS i, md5(array_to_string(ws[t.i:t.i + 49], ' ')) AS h FROM texts, unnest(range(1, len(ws) - 48)) AS t(i)),
     firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
     gone AS (SELECT DISTINCT doc_id, i + k.k AS p FROM windows JOIN firsts USING (h), range(50) AS k(k) WHERE first < doc_id),
     words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM texts),
     kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

_STEP = """SELECT a.*, CASE WHEN n.us <= t1 + 300000000 AND (x.us IS NULL OR x.us > n.us) THEN n.us END AS t{k}
  FROM a{j} a ASOF LEFT JOIN rows n ON a.client_id = n.client_id AND a.s{k} = n.kind AND a.t{j} < n.us
  ASOF LEFT JOIN rows x ON a.client_id = x.client_id AND a.barred = x.kind AND a.t{j} < x.us"""

OP11 = f"""
WITH rows AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS us FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
     funnels(funnel, s1, s2, s3, s4, barred) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
     a1 AS (SELECT funnels.*, client_id, us AS t1 FROM rows JOIN funnels ON kind = s1),
     a2 AS ({_STEP.format(j=1, k=2)}), a3 AS ({_STEP.format(j=2, k=3)}), a4 AS ({_STEP.format(j=3, k=4)}),
     depths AS (SELECT funnel, client_id, count(*) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4,
       CAST(max(CASE WHEN t4 IS NOT NULL THEN 4 WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 ELSE 1 END) AS INT) AS deepest,
       list_sort(list(t2 - t1) FILTER (t2 IS NOT NULL)) AS d2, list_sort(list(t3 - t2) FILTER (t3 IS NOT NULL)) AS d3, list_sort(list(t4 - t3) FILTER (t4 IS NOT NULL)) AS d4 FROM a4 GROUP BY ALL)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, d2[(25 * n2 + 99) // 100] AS t2, d3[(25 * n3 + 99) // 100] AS t3, d4[(25 * n4 + 99) // 100] AS t4,
       count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
FROM depths
"""

#: CRC-32 bit by bit of a decimal number.
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP13 = rf"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     cut AS (SELECT *, {_CRC} % 4 AS h FROM own),
     whole AS (SELECT o.conv_id, coalesce(b.turns[1:h], o.turns[1:0]) || o.turns[h + 1:] AS turns FROM cut o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
     members AS (SELECT conv_id, t.d AS d, turns[1:t.d] AS path, len(turns) AS n FROM whole, unnest(range(0, len(turns) + 1)) AS t(d)),
     nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, bool_or(n > d) AS has_more,
       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
       (count(*) - 1) * CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own_saved FROM members GROUP BY path, d),
     subtrees AS (SELECT path[1:t.k] AS path, CAST(sum(own_saved) AS BIGINT) AS saved_tokens, count(*) FILTER (NOT has_more) AS n_leaves FROM nodes, unnest(range(0, d + 1)) AS t(k) GROUP BY 1),
     children AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees USING (path) LEFT JOIN children USING (path) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
