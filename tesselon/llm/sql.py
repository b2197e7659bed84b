"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from tesselon.llm.license_scan import GRAM, LEAST_COVERAGE, NEIGHBOUR, template_grams

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, common.keeper IS NOT NULL AND common.keeper <> doc_id AS gone
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL["op8_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS l FROM documents))
), windows AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n
  FROM words
), hashed AS (SELECT doc_id, i, md5(s) AS h FROM windows WHERE n = 50),
firsts AS (SELECT h, min(doc_id) AS least FROM hashed GROUP BY h),
gone AS (SELECT doc_id, i FROM hashed JOIN firsts USING (h) WHERE least < doc_id),
marked AS (
  SELECT words.doc_id, words.i, w,
         max(gone.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) AS last_start
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (last_start + 49 >= i) AS n_removed,
         string_agg(w, ' ' ORDER BY i) FILTER (last_start IS NULL OR last_start + 49 < i) AS kept
  FROM marked GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL["op9_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), dealt AS (
  SELECT doc_id, source, size, CAST('0x' || substr(h, 1, 3) AS BIGINT) AS cell,
         CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS unit
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM dealt GROUP BY source
), weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM sources
), leveled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed
), targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN cap >= weight * lv THEN lv END) OVER ()), cap) AS target FROM leveled
), plan AS (
  SELECT cells.source, cells.cell, source_size, target, words, last,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0::DOUBLE END AS whole
  FROM (SELECT source, cell, CAST(sum(size) AS BIGINT) AS words, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS BIGINT) AS last
        FROM dealt GROUP BY source, cell) AS cells
  JOIN targets ON cells.source IS NOT DISTINCT FROM targets.source
), parts AS (
  SELECT *, CASE WHEN words = 0 THEN 0.0::DOUBLE
                 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((target - whole * source_size) - (last - words)) / words)) END AS part
  FROM plan
)
SELECT dealt.doc_id, dealt.size, parts.source_size, parts.target,
       CAST(whole * dealt.size + least(dealt.size, floor(part * dealt.size + unit)) AS BIGINT) AS taken
FROM dealt JOIN parts ON dealt.source IS NOT DISTINCT FROM parts.source AND dealt.cell = parts.cell
"""

ORACLE_SQL["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS l
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(l[i : i + 2], ' ')) AS s
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, 2))) AS i FROM docs WHERE len(l) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reached.a, ends.b FROM reached JOIN ends ON reached.b = ends.a
), least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, component_id, docs.doc_id = component_id AS kept
FROM docs JOIN least ON least.a = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id
"""

ORACLE_SQL["op7_embedding_dedup"] = r"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT r, vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM rows
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM rows
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), counted AS (SELECT r, count(*) AS n FROM links GROUP BY r),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT rows.vec_id, coalesce(n, 0) AS n_links, component_id, rows.vec_id = component_id AS kept
FROM rows LEFT JOIN counted USING (r) JOIN least ON least.a = rows.vec_id
"""

ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS l
  FROM documents
), drawn AS (
  SELECT doc_id, text, l, len(l) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(l) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(l[1 : least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1 : n], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _license_sql() -> str:
    values = ",\n    ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {k}, '{' '.join(gram)}')" for t, label, base, n, k, gram in template_grams())
    return rf"""
WITH templates(template, label, base, grams, place, gram) AS (VALUES
    {values}
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
  FROM documents
), words AS (
  SELECT r, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM docs
), grams AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER (PARTITION BY r ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS gram FROM words
), diagonals AS (
  SELECT r, template, label, base, grams, i - place AS diagonal, bit_or(1::BIGINT << place) AS mask, min(i) AS first, max(i) AS last
  FROM grams JOIN templates USING (gram) GROUP BY ALL
), gaps AS (
  SELECT *, CASE WHEN base THEN 1 WHEN diagonal - lag(diagonal) OVER w > {NEIGHBOUR} THEN 1 ELSE 0 END AS gap
  FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)
), islands AS (
  SELECT *, sum(gap) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM gaps
), spans AS (
  SELECT r, template, label, base, grams, min(first) AS first, max(last) + {GRAM - 1} AS last, bit_count(bit_or(mask)) AS held,
         bit_count(bit_or(mask))::DOUBLE / grams AS part
  FROM islands GROUP BY r, template, label, base, grams, island
), notices AS (
  SELECT * FROM spans WHERE NOT base AND part >= {LEAST_COVERAGE}
), winners AS (
  SELECT r, label FROM notices a WHERE NOT EXISTS (
    SELECT 1 FROM notices b WHERE b.r = a.r AND b.first <= a.last AND a.first <= b.last
    AND (b.held * a.grams > a.held * b.grams OR b.held * a.grams = a.held * b.grams AND
         (b.held > a.held OR b.held = a.held AND (b.template < a.template OR b.template = a.template AND b.first > a.first))))
), labelled AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT * FROM winners UNION ALL SELECT r, label FROM spans WHERE base AND part = 1) GROUP BY r
), found AS (
  SELECT r, count(*) FILTER (base AND part = 1) AS n_base, min(first) FILTER (base AND part = 1) AS first_word,
         max(first) FILTER (base AND part = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND part = 1) AS base_labels,
         max(part) FILTER (NOT base OR part = 1) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN found USING (r) LEFT JOIN labelled USING (r)
"""


ORACLE_SQL["op4_license_scan"] = _license_sql()
