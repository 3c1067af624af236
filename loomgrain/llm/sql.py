"""SQL that gives the rows of the training-data queries, where SQL can say it in fair time."""

from __future__ import annotations

import sys
import unicodedata

from loomgrain.llm.visual_form import skeleton


def _form_of(text: str) -> str:
    """SQL for the look-alike form of a text, composed: single characters by one translation, those that become several by replacement."""
    pairs, gone, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xDFFF or 0x20000 <= code <= 0xDFFFF:
            continue
        c = chr(code)
        to = unicodedata.normalize("NFC", skeleton(c))
        if to == unicodedata.normalize("NFC", c):
            continue
        (pairs if len(to) == 1 else several if to else gone).append((c, to))
    table = "".join(c for c, _ in pairs) + "".join(c for c, _ in gone)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate(nfc_normalize({text}), {quoted(table)}, {quoted(''.join(t for _, t in pairs))})"
    for c, to in several:
        out = f"replace({out}, {quoted(c)}, {quoted(to)})"
    return f"nfc_normalize({out})"


def _decomposed_length(form: str) -> str:
    """SQL for the length of a composed text when decomposed."""
    longer: dict[int, list[str]] = {}
    for code in range(0x80, 0x3400):
        n = len(unicodedata.normalize("NFD", chr(code))) - 1
        if n > 0:
            longer.setdefault(n, []).append(chr(code))
    return f"length({form})" + "".join(f" + {n} * (length({form}) - length(translate({form}, '{''.join(cs)}', '')))" for n, cs in sorted(longer.items()))


def _words(source: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, regexp_extract_all(lower({_form_of('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE {key} IS NOT NULL AND text IS NOT NULL"


def _windows(name: str, key: str) -> str:
    return f"SELECT {key}, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM {name} WHERE len(w) >= 13)"


FUNCTIONS = "functions AS (SELECT DISTINCT ON (fn_id) * FROM fingerprints WHERE fn_id IS NOT NULL ORDER BY fn_id, ingested_at DESC)"
ENTRIES = "entries AS (SELECT DISTINCT ON (entry_id) * FROM auto_filters WHERE entry_id IS NOT NULL ORDER BY entry_id, ingested_at DESC)"
FREQUENCIES = f"""
{ENTRIES}, calls AS (SELECT entry_id, lower(regexp_replace(c, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS call_name FROM
  (SELECT entry_id, unnest(list_concat(coalesce(contains_call_to, []), coalesce(required_calls, []))) AS c FROM entries)),
counted AS (SELECT call_name, count(*)::BIGINT AS occurrences, count(DISTINCT entry_id)::BIGINT AS records FROM calls WHERE call_name IS NOT NULL AND call_name <> '' GROUP BY 1),
marked AS (SELECT call_name, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.1 * (SELECT count(*) FROM entries) THEN 'common' END AS mark FROM counted)"""

OVERLAPS = f"""
{FUNCTIONS}, base AS (SELECT fn_id AS k, 0 AS side, ngram_hashes, structural_markers, semantic_markers FROM functions
  UNION ALL SELECT example_id, 1, ngram_hashes, structural_markers, semantic_markers FROM corpus_examples WHERE example_id IS NOT NULL),
big AS (SELECT * FROM base WHERE len(list_distinct(coalesce(ngram_hashes, []))) >= 8),
items AS (SELECT DISTINCT k, side, i FROM (
  SELECT k, side, 'n' || unnest(ngram_hashes)::VARCHAR AS i FROM big UNION ALL SELECT k, side, 't' || unnest(structural_markers)::VARCHAR FROM big
  UNION ALL SELECT k, side, 'm' || unnest(semantic_markers)::VARCHAR FROM big) WHERE i IS NOT NULL),
sizes AS (SELECT k, count(*) AS n FROM items GROUP BY 1),
common AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM items a JOIN items b ON a.i = b.i AND a.k < b.k AND a.side + b.side < 2 GROUP BY 1, 2)"""

LEAKS = f"""
dw AS ({_words("documents", "doc_id")}), iw AS ({_words("eval_items", "item_id")}), dg AS ({_windows("dw", "doc_id")}), ig AS (SELECT DISTINCT item_id, g FROM ({_windows("iw", "item_id")}))"""
FORMS = f"""
stored AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), formed AS (SELECT doc_id, text, {_form_of("text")} AS f FROM stored)"""

SQL = {
    "p8_found": f"WITH {LEAKS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p8_spans": f"""
WITH {LEAKS}, hits AS (SELECT DISTINCT doc_id, item_id, i FROM dg JOIN ig USING (g)),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 13 THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY i)),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS s FROM marked)
SELECT doc_id, item_id, min(i) - 1 AS first_word, max(i) + 11 AS last_word FROM spans GROUP BY doc_id, item_id, s""",
    "p10_found": f"""
WITH {FORMS}, long AS (SELECT * FROM formed WHERE {_decomposed_length("f")} > 60)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM long a JOIN long b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p10_forms": f"""
WITH {FORMS}, g AS (SELECT f, min(doc_id) AS form_id, count(*) AS members, count(DISTINCT text) AS spellings FROM formed GROUP BY 1)
SELECT doc_id, form_id, members::BIGINT AS members, spellings::BIGINT AS spellings FROM formed JOIN g USING (f)""",
    "p3_links": f"""
WITH {OVERLAPS}, sets AS (SELECT k, side, list_sort(list(i)) AS s FROM items GROUP BY 1, 2), cls AS (SELECT s, min(k) AS class_id, count(*) AS copies FROM sets GROUP BY 1),
own AS (SELECT k, side, class_id, copies FROM sets JOIN cls USING (s)),
linked AS (SELECT DISTINCT p.class_id AS x, q.class_id AS y FROM common JOIN sizes a ON a.k = ka JOIN sizes b ON b.k = kb JOIN own p ON p.k = ka JOIN own q ON q.k = kb WHERE c / (a.n + b.n - c) >= 0.6 AND p.class_id <> q.class_id),
deg AS (SELECT c, count(DISTINCT o) AS links FROM (SELECT x AS c, y AS o FROM linked UNION ALL SELECT y, x FROM linked) GROUP BY 1)
SELECT k AS key, side, class_id, copies::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links FROM own LEFT JOIN deg ON c = class_id""",
    "p1_found": f"""
WITH {FUNCTIONS}, occ AS (SELECT DISTINCT fn_id, h FROM (SELECT fn_id, unnest(ngram_hashes) AS h FROM functions) WHERE h IS NOT NULL),
df AS (SELECT h, count(*) AS df FROM occ GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM functions),
scored AS (SELECT o.fn_id, o.h, coalesce(f.weighted_ngram_hashes[o.h], 1.0) * ln(n.n / df.df) AS s FROM occ o JOIN df USING (h) JOIN functions f USING (fn_id) CROSS JOIN n),
ranked AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS next FROM scored WINDOW w AS (PARTITION BY fn_id ORDER BY s DESC))
SELECT fn_id, h AS ngram_hash FROM ranked WHERE r = 1 AND next IS NOT NULL AND s > 0 AND s >= 2 * next""",
    "p3_found": f"""
WITH {OVERLAPS}
SELECT ka AS key_a, kb AS key_b FROM common JOIN sizes x ON x.k = ka JOIN sizes y ON y.k = kb WHERE c / (x.n + y.n - c) >= 0.6""",
    "p4_found": f"WITH {FREQUENCIES} SELECT call_name, mark FROM marked WHERE mark IS NOT NULL",
    "p4_frequencies": f"WITH {FREQUENCIES} SELECT call_name, occurrences, records, mark FROM marked",
    "p2_found": """
WITH RECURSIVE links AS (
  SELECT left_fn AS a, right_fn AS b FROM match_pairs WHERE signature_sim >= 0.75 AND left_fn IS NOT NULL AND right_fn IS NOT NULL AND left_fn <> right_fn
  UNION SELECT x.fn_id, y.fn_id FROM (SELECT row_number() OVER () AS r, members FROM function_clusters) c, unnest(c.members) AS u(x), unnest(c.members) AS v(y) WHERE x.fn_id < y.fn_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(a, b) AS (SELECT a, a FROM both_ways UNION SELECT walk.a, e.b FROM walk JOIN both_ways e ON walk.b = e.a)
SELECT a AS fn_id, min(b) AS cluster_id FROM walk GROUP BY 1""",
    "p7_found": f"""
WITH RECURSIVE {FUNCTIONS}, big AS (SELECT fn_id, ngram_hashes, skeleton_hashes FROM functions WHERE len(list_distinct(coalesce(ngram_hashes, []))) >= 8),
items AS (SELECT DISTINCT fn_id, kind, h FROM (SELECT fn_id, 0 AS kind, unnest(ngram_hashes) AS h FROM big UNION ALL SELECT fn_id, 1, unnest(skeleton_hashes) FROM big) WHERE h IS NOT NULL),
sizes AS (SELECT fn_id, count(*) FILTER (kind = 0) AS n, count(*) FILTER (kind = 1) AS s FROM items GROUP BY 1),
common AS (SELECT a.fn_id AS x, b.fn_id AS y, count(*) FILTER (a.kind = 0) AS cn, count(*) FILTER (a.kind = 1) AS cs FROM items a JOIN items b ON a.kind = b.kind AND a.h = b.h AND a.fn_id < b.fn_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.fn_id = x JOIN sizes q ON q.fn_id = y WHERE (cn / (p.n + q.n - cn) + cs / greatest(p.s + q.s - cs, 1)) / 2 >= 0.7),
both_ways AS (SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links),
walk(a, b) AS (SELECT a, a FROM both_ways UNION SELECT walk.a, e.b FROM walk JOIN both_ways e ON walk.b = e.a)
SELECT a AS fn_id, min(b) AS group_id FROM walk GROUP BY 1""",
}
