"""The operators' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import decontam, neardup, substring

_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
h AS (SELECT doc_id, p, array_to_string(ws[p:p + {substring.WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW - 2})) AS p FROM w WHERE len(ws) >= {substring.WINDOW})),
m AS (SELECT g, min(doc_id) AS d FROM h GROUP BY g),
c AS (SELECT DISTINCT doc_id, q FROM (SELECT h.doc_id, unnest(range(p, p + {substring.WINDOW})) AS q FROM h JOIN m USING (g) WHERE d < h.doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_S = neardup.SHINGLE
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + {_S - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {_S - 2}))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= {neardup.PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""

_W, _V = decontam.WINDOW, decontam.SHORT_WINDOW
_MASKED = " UNION ".join(f"SELECT doc_id, t.p, item_id FROM t JOIN b ON list_select(t.g, {[k + 1 for k in mask]}) = list_select(b.g, {[k + 1 for k in mask]}) WHERE len([k for k in range(1, {_W + 1}) if t.g[k] <> b.g[k]]) <= {decontam.ERRORS}" for mask in decontam.MASKS)
DECONTAMINATION = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS ws FROM documents), bw AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS ws FROM benchmark),
t AS (SELECT doc_id, p, ws[p:p + {_W - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_W - 2})) AS p FROM dw WHERE len(ws) >= {_W})),
b AS (SELECT item_id, ws[p:p + {_W - 1}] AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - {_W - 2})) AS p FROM bw WHERE len(ws) >= {_W})),
ts AS (SELECT doc_id, p, ws[p:p + {_V - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_V - 2})) AS p FROM dw WHERE len(ws) >= {_V})),
bs AS (SELECT item_id, ws[p:p + {_V - 1}] AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - {_V - 2})) AS p FROM bw WHERE len(ws) >= {_V} AND len(ws) < {_W})),
f AS ({_MASKED} UNION SELECT doc_id, ts.p, item_id FROM ts JOIN bs USING (g)),
a AS (SELECT doc_id, count(DISTINCT p) AS n, list_sort(list(DISTINCT item_id)) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0) AS n_windows, coalesce(array_to_string(a.items, ','), '') AS item_ids, a.n IS NOT NULL AS contaminated, a.n IS NULL AS kept FROM documents d LEFT JOIN a USING (doc_id)"""

SQL = {"op5_near_duplicates": NEAR_DUPLICATES, "op8_decontamination": DECONTAMINATION, "op9_substring": SUBSTRING}
