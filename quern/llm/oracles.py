"""DuckDB SQL that gives the same rows as those queries of this subpackage which SQL can express."""

from __future__ import annotations

#: Stretches ``span (doc_id, r, a, b)`` of places that windows of some symbols starting at ``hit (doc_id, i)`` cover, and the stretches between them.
_SPANS = """
 mark AS (SELECT doc_id, i, CASE WHEN lag(i) OVER o IS NULL OR i > lag(i) OVER o + {n} THEN 1 ELSE 0 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
 span AS (SELECT doc_id, r, min(i) AS a, max(i) + {n} AS b FROM run GROUP BY doc_id, r),
 edge AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a AS y FROM span UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY doc_id)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS t FROM documents),
 q AS (SELECT item_id, t, least(len(t), 13) AS n FROM (SELECT item_id, {_ALNUM} AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) > 0),
 g AS (SELECT DISTINCT item_id, n, array_to_string(t[i:i + n - 1], ' ') AS s FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM q)),
 p AS (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(t) >= n),
 hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS s FROM p) JOIN g USING (n, s)),
 words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
 SELECT doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 part AS (SELECT doc_id, j, substr(h, 400 * j + 1, 498) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 400 + 1)) AS j FROM d)),
 w AS (SELECT doc_id, j, i, hash(substr(g, 2 * i - 1, 100)) AS k FROM (SELECT doc_id, j, g, unnest(range(1, least(length(g) // 2 - 48, 201))) AS i FROM part)),
 again AS (SELECT k FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
 c AS (SELECT doc_id, 200 * j + i AS i, substr(g, 2 * i - 1, 100) AS s FROM w SEMI JOIN again USING (k) JOIN part USING (doc_id, j)),
 first AS (SELECT s, min(doc_id) AS f FROM c GROUP BY s),
 hit AS (SELECT doc_id, i FROM c JOIN first USING (s) WHERE f < doc_id),{_SPANS.format(n=50)},
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * x - 1, 2 * (y - x)), '' ORDER BY x) AS k FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
 gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM span GROUP BY doc_id)
 SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP8 = f"""WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS t FROM documents),
 p AS (SELECT doc_id, t, unnest(range(1, len(t) - 18)) AS i FROM d),
 w AS (SELECT doc_id, i, array_to_string(t[i:i + 19], ' ') AS s FROM p),
 first AS (SELECT s, min(doc_id::HUGEINT * 1000000000 + i) AS f FROM w GROUP BY s),
 hit AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE f < doc_id::HUGEINT * 1000000000 + i),{_SPANS.format(n=20)},
 kept AS (SELECT doc_id, string_agg(array_to_string(t[x:y - 1], ' '), ' ' ORDER BY x) FILTER (len(t[x:y - 1]) > 0) AS k FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
 gone AS (SELECT doc_id, sum(b - a) AS n FROM span GROUP BY doc_id)
 SELECT doc_id, len(t) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(t, ' ') ELSE coalesce(k, '') END) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS t FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 3], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM d WHERE len(t) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
 link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
 reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
 SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id"""

OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
 w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
 v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS a FROM kept GROUP BY lang),
 s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
 p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (size + v) AS p, 1 + (1000000000 * (total + 1)) // (a + v) AS q FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
 f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
 pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
 term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200"""

OP12 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
 r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
 c AS (SELECT doc_id, t, len(u) AS n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM r)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op7_suffix_dedup": OP7, "op8_phrase_automata": OP8, "op10_jaccard_groups": OP10, "op11_source_divergence": OP11, "op12_fill_in_middle": OP12}
