"""SQL of the text queries that DuckDB can compute on whole tables."""

HARD_NEGATIVES = r"""
WITH usable AS (
    SELECT vec_id, label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows_ AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM usable
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id
WHERE NOT n.alike AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), vocabulary AS (
    SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM groups g
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), dense AS (
    SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 2)) // (t.n + 2 * v.v) AS p
    FROM totals t JOIN vocabulary v ON v.lang = t.lang JOIN kept k ON k.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
    SELECT d.lang, d.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(d.c) + 2)) // (n.n + 2 * v.v) AS q
    FROM dense d JOIN vocabulary v ON v.lang = d.lang JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) n ON n.lang = d.lang
    GROUP BY d.lang, d.term, n.n, v.v
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN dense y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
), marks AS (
    SELECT d.lang, d.source, d.term AS item, (d.p - w.q) * (d.p - w.q) // (d.p + w.q) AS value
    FROM dense d JOIN whole w ON w.lang = d.lang AND w.term = d.term WHERE d.c > 0 AND d.p > w.q
), parts AS (
    SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM marks
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""

CHAT_FORMAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
    SELECT *, '<|im_start|>' || marked(role) || '<|im_sep|>' || marked(text) || '<|im_end|>' AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_ANGLED = (
    r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|unk>|<SYS>>|</SYS>>|\|startoftext\|>|\|endoftext\|>|\|begin_of_text\|>"
    r"|\|end_of_text\|>|\|start_header_id\|>|\|end_header_id\|>|\|eot_id\|>|start_of_turn>|end_of_turn>|\|system\|>"
    r"|\|user\|>|\|assistant\|>|\|end\|>"
)
for _column in ("role", "text"):
    _marked = rf"regexp_replace(regexp_replace({_column}, '<(\\*(?:{_ANGLED}))', '<\\\1', 'g'), '\[(\\*(?:INST\]|/INST\]))', '[\\\1', 'g')"
    CHAT_FORMAT = CHAT_FORMAT.replace(f"marked({_column})", _marked)
