"""DuckDB SQL for the operators that SQL can express, over the whole tables.

Absent: source mixing (draws by a seeded hash), fuzzy line dedup (MinHash), the classifier,
token counts and token files (byte-pair encoding), personal data (checksums over match positions)
and Hilbert sharding; tests/llm compares those with brute-force versions.
"""
from __future__ import annotations

from dealflow.llm import quality_rules as rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i + 1 : i + 35], ' ') AS k
      FROM (SELECT r, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(0, 35)) AS j FROM hit)),
w AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS k
       FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(0, n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i + 1 : i + 3], ' ') AS g
      FROM (SELECT r, w, unnest(range(0, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * m >= 90 * (p.n + q.n - m)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id
"""

_LIST = "[" + ", ".join(f"'{w}'" for w in rules.COMMON_WORDS) + "]"
_LANGUAGES = ", ".join(f"'{x}'" for x in rules.COMMON)

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
tri AS (SELECT r, i, array_to_string(w[i + 1 : i + 3], ' ') AS k
        FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM
        (SELECT r, i, unnest(range(0, 3)) AS j FROM tri WHERE (r, k) IN (SELECT (r, k) FROM tri GROUP BY r, k HAVING count(*) > 1)) GROUP BY r),
f AS (SELECT r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
        regexp_replace(array_to_string(w, ''), '\p{{Ll}}', '', 'g') AS rest, length(t) AS n_all,
        [len([x FOR x IN w IF x = y]) FOR y IN {_LIST}] AS known FROM d),
g AS (SELECT *, length(rest) AS n_rest, length(rest) - length(regexp_replace(rest, '\p{{Lu}}', '', 'g')) AS up,
        length(rest) - length(regexp_replace(rest, '[0-9]', '', 'g')) AS dig,
        length(rest) - length(regexp_replace(rest, '[.,;:!?''"()-]', '', 'g')) AS mark FROM f),
c AS (SELECT *, [word_chars - n_rest, up, dig, mark, n_rest - up - dig - mark, n_all - word_chars] AS chars,
        list_append(known, n_words - list_sum(known)::BIGINT) AS listed FROM g),
rc AS (SELECT lang, i, sum(x)::DOUBLE AS x FROM (SELECT lang, unnest(chars) AS x, unnest(range(0, len(chars))) AS i FROM c
        WHERE n_words >= {rules.MIN_WORDS} AND lang IN ({_LANGUAGES})) GROUP BY lang, i),
rl AS (SELECT lang, i, sum(x)::DOUBLE AS x FROM (SELECT lang, unnest(listed) AS x, unnest(range(0, len(listed))) AS i FROM c
        WHERE n_words >= {rules.MIN_WORDS} AND lang IN ({_LANGUAGES})) GROUP BY lang, i),
qc AS (SELECT lang, i, x / sum(x) OVER (PARTITION BY lang) AS q FROM rc),
ql AS (SELECT lang, i, x / sum(x) OVER (PARTITION BY lang) AS q FROM rl),
pc AS (SELECT r, i, x / n_all AS p FROM (SELECT r, n_all, unnest(chars) AS x, unnest(range(0, len(chars))) AS i FROM c WHERE n_all >= {rules.MIN_CHARS})),
pl AS (SELECT r, i, x / n_words AS p FROM (SELECT r, n_words, unnest(listed) AS x, unnest(range(0, len(listed))) AS i FROM c WHERE n_words >= {rules.MIN_LISTED})),
dc AS (SELECT r, min(v) AS v FROM (SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS v FROM pc JOIN qc USING (i) GROUP BY r, lang) GROUP BY r),
dl AS (SELECT r, min(v) AS v FROM (SELECT r, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS v FROM pl JOIN ql USING (i) GROUP BY r, lang) GROUP BY r),
o AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed,
        round(dc.v, 6) AS char_distance, round(dl.v, 6) AS word_distance
      FROM c LEFT JOIN rep USING (r) LEFT JOIN dc USING (r) LEFT JOIN dl USING (r))
SELECT *, NOT base_failed AND coalesce(char_distance <= {rules.MAX_CHAR_DISTANCE}, true)
          AND coalesce(word_distance <= {rules.MAX_WORD_DISTANCE}, true) AS kept FROM o
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
               OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM k)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

# CRC-32 of a word byte by byte, over the table of the reflected polynomial
OP13 = rf"""
WITH RECURSIVE step AS (SELECT range AS b, 0 AS k, range::BIGINT AS v FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS x FROM d),
bw AS (SELECT unnest(w) AS x FROM b),
words AS (SELECT x, [('0x' || hex(x)[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(0, strlen(x))] AS bytes
          FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
crc AS (SELECT x, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1]), 4294967295), 4294967295) % 10000 AS k
        FROM words, tab),
s AS (SELECT k, count(*) AS s FROM dw JOIN crc USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bw JOIN crc USING (x) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
         FROM s FULL JOIN t USING (k)),
f AS (SELECT r, count(*) AS n, sum(g) AS g FROM dw JOIN crc USING (x) JOIN gain USING (k) GROUP BY r),
o AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
        ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (r)),
z AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN p <= (SELECT 10 * count(*) // 100 FROM p) THEN p END::BIGINT AS rank FROM z LEFT JOIN p USING (r)
"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op3_benchmark_decontamination": OP3,
    "op7_quality_rules": OP7,
    "op8_ngram_jaccard_join": OP8,
    "op12_fill_in_middle": OP12,
    "op13_importance_resampling": OP13,
}
