"""DuckDB SQL for the queries of this subpackage that SQL can express.

Tokenizers, learned models and packing are beyond SQL; tests hold those queries against brute force.
"""

_REACH = """reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

op2_nearest = """
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM c q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""

op7_jaccard_join = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.a = d.doc_id
"""

op8_chat_format = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|\\[ROLE|\\[/ROLE\\]')) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1
"""

op9_embedding_dedup = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
    {_REACH}
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, least(v.vec_id, coalesce(l.b, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN least_of l ON l.a = v.vec_id
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 of a list of bytes, by the table that its polynomial gives
_CRC = """crc AS MATERIALIZED (SELECT list(r ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS t(i)))"""


def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8, for code points below U+0800; `crc` must be in scope."""
    points = f"list_transform(string_split({text}, ''), lambda x: ord(x))"
    data = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform({data}, lambda x: x::BIGINT)), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295)"


op11_spelling_variants = f"""
WITH RECURSIVE {_CRC},
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
    drawn AS MATERIALIZED (SELECT run, n, {_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc),
    words AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM drawn GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
    less AS MATERIALIZED (SELECT word, n, p, word[:p] || word[p + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
    one AS (SELECT x.word AS a, x.n AS n_a, y.word AS b, y.n AS n_b FROM less x JOIN less y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
        UNION SELECT w.word, w.n, l.word, l.n FROM words w JOIN less l ON w.word = l.rest UNION SELECT l.word, l.n, w.word, w.n FROM words w JOIN less l ON w.word = l.rest),
    near AS (SELECT a AS word, count(*) AS n_near, max(n_b) AS most FROM one GROUP BY 1),
    best AS (SELECT a AS word, min(b) AS b FROM one JOIN near ON near.word = a AND n_b = most WHERE n_b >= 10 * n_a GROUP BY 1),
    way AS (SELECT word, word AS at FROM words UNION SELECT way.word, b FROM way JOIN best ON best.word = way.at),
    roots AS (SELECT way.word, way.at AS root FROM way WHERE way.at NOT IN (SELECT word FROM best))
SELECT words.word, best.b AS form, roots.root, words.n, coalesce(near.n_near, 0) AS n_near, CASE WHEN best.b IS NOT NULL THEN near.most END AS form_n
FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word) JOIN roots USING (word)
"""

op12_source_divergence = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("text")} AS text FROM documents),
    t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
    groups AS (SELECT DISTINCT lang, source FROM d),
    counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n FROM groups g JOIN kept ON kept.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q FROM every WINDOW g AS (PARTITION BY lang, source)),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(apart.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
    parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

op13_katz_scores = f"""
WITH {_CRC},
    d AS MATERIALIZED (SELECT doc_id, {_crc32("doc_id::VARCHAR")} % 5 = 1 AS held_out, list_append(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), chr(10)) AS w FROM documents, crc),
    t AS MATERIALIZED (SELECT doc_id, held_out, unnest(list_prepend(' ', w)[:len(w)]) AS h, unnest(w) AS w FROM d),
    uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
    bi AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
    having_ AS (SELECT 1 AS k, c, count(*) AS n FROM uni GROUP BY c UNION ALL SELECT 2, c, count(*) FROM bi GROUP BY c),
    cuts AS (SELECT k, cut, (cut + 1) * b.n / a.n AS x FROM having_ a JOIN having_ b USING (k) JOIN range(2, 6) AS r(cut) ON b.c = cut + 1 WHERE a.c = 1),
    shares AS (SELECT k, cut, a.c, ((a.c + 1) * b.n / (a.c * a.n) - x) / (1 - x) AS keeps FROM cuts JOIN having_ a USING (k) JOIN having_ b USING (k) WHERE x < 1 AND a.c <= cut AND b.c = a.c + 1),
    chosen AS (SELECT k, max(cut) AS cut FROM (SELECT k, cut FROM shares GROUP BY 1, 2 HAVING count(*) = cut AND min(keeps) > 0 AND max(keeps) < 1) GROUP BY 1),
    kept AS (SELECT k, c, CASE WHEN cut IS NULL THEN c - 0.5::DOUBLE ELSE c * coalesce(keeps, 1) END AS d FROM having_ LEFT JOIN chosen USING (k) LEFT JOIN shares USING (k, cut, c)),
    total AS (SELECT sum(c) AS n, count(*) AS v, sum(c - d) / sum(c) AS unknown FROM uni JOIN (SELECT c, d FROM kept WHERE k = 1) USING (c)),
    p AS (SELECT w, c, d / n AS p FROM uni JOIN (SELECT c, d FROM kept WHERE k = 1) USING (c), total),
    seen AS (SELECT h, w, c, d FROM bi JOIN (SELECT c, d FROM kept WHERE k = 2) USING (c)),
    sums AS (SELECT h, sum(seen.c) AS c, fsum(seen.c - d) AS taken, fsum(p.p) AS s FROM seen JOIN p USING (w) GROUP BY 1),
    after AS (SELECT h, c + (taken = 0)::INT AS c, CASE WHEN taken = 0 THEN 1 ELSE taken END / (c + (taken = 0)::INT) / (1 - s) AS back FROM sums),
    each AS (SELECT doc_id, held_out, p.c, log10((coalesce(p.c, 0) + 0.5) / (n + 0.5 * (v + 1))) AS base, log10(CASE WHEN seen.w IS NOT NULL THEN seen.d / after.c ELSE coalesce(back, 1) * coalesce(p.p, unknown) END) AS score
        FROM t LEFT JOIN p ON p.w = t.w LEFT JOIN seen ON seen.h = t.h AND seen.w = t.w LEFT JOIN after ON after.h = t.h, total)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT n FROM total)::BIGINT AS train_tokens, fsum(base) AS base_score, fsum(score) AS score FROM each GROUP BY 1, 2
"""
