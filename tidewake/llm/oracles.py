"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidewake.llm.licenses import templates

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, h, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM d
"""

OP2 = r"""
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h') AS body FROM r),
     g AS (SELECT conv_id, count(*) AS n_turns,
                  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                  sum(4 + length(role) + 2 + length(body) + 8) AS chars
           FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

OP5 = r"""
WITH c AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
     t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM c GROUP BY source),
     x AS (SELECT CASE WHEN max(n) > 2.0 * min(n) THEN round(1 - ln(2.0) / ln(max(n) / min(n)::DOUBLE), 6) ELSE 0.0 END AS a FROM t WHERE n > 0),
     z AS (SELECT a, (SELECT sum(pow(n::DOUBLE, a)) FROM t WHERE n > 0) AS z FROM x),
     w AS (SELECT source, n, CASE WHEN n > 0 THEN greatest(round(pow(n::DOUBLE, a) / z, 9), 1e-9) ELSE 0.0 END AS weight FROM t, z),
     b AS (SELECT *, CAST(coalesce(floor(weight * (SELECT max(n / weight) FROM w WHERE n > 0) + 0.5), 0) AS BIGINT) AS budget FROM w),
     s AS (SELECT *, CASE WHEN n > 0 THEN budget // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN budget - budget // n * n ELSE 0 END AS rest FROM b),
     e AS (SELECT c.doc_id, c.source, c.n_tokens, s.n, s.weight, s.passes, s.rest,
                  unnest(range(CAST(s.passes + CASE WHEN s.rest > 0 THEN 1 ELSE 0 END AS BIGINT))) AS epoch
           FROM c JOIN s USING (source)),
     k AS (SELECT *, CAST('0x' || substr(md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM e),
     g AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key RANGE UNBOUNDED PRECEDING)
                     - sum(n_tokens) OVER (PARTITION BY source, epoch, key) AS start FROM k),
     u AS (SELECT *, CAST(CASE WHEN weight > 0 THEN floor((epoch * n + start) / (weight * 1000000.0)) ELSE key % (SELECT greatest(1, CAST(ceil(sum(budget) / 1000000.0) AS BIGINT)) FROM b) END AS BIGINT) AS block
           FROM g WHERE epoch < passes OR start < rest),
     o AS (SELECT *, CAST('0x' || substr(md5('17:block:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || epoch), 1, 15) AS BIGINT) AS ord FROM u)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY ord, doc_id, epoch, n_tokens, source) AS place, doc_id, source,
       CAST(epoch AS BIGINT) AS epoch, n_tokens
FROM o
"""

OP8 = r"""
WITH tpl AS (SELECT * FROM (VALUES {values}) AS t(license, body)),
     norm AS (SELECT row_number() OVER () AS tid, license, string_split_regex(trim(regexp_replace(lower(body), '[^0-9a-z]+', ' ', 'g')), ' ') AS w FROM tpl),
     tg AS (SELECT tid, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM norm),
     lim AS (SELECT CAST(floor(max(len(w)) / (0.85 / 1.15)) AS BIGINT) AS most FROM norm),
     ln AS (SELECT row_number() OVER () AS did, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT did, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM ln),
     lw AS (SELECT did, doc_id, i, line, trim(regexp_replace(lower(line), '[^0-9a-z]+', ' ', 'g')) AS x FROM l),
     mk AS (SELECT *, sum(CASE WHEN x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY did ORDER BY i) AS blk FROM lw),
     b0 AS (SELECT did, doc_id, blk, string_agg(x, ' ' ORDER BY i) AS x, count(*) AS n_lines FROM mk WHERE x <> '' GROUP BY did, doc_id, blk),
     b AS (SELECT did, doc_id, x, n_lines, len(string_split(x, ' ')) AS n, row_number() OVER (PARTITION BY did ORDER BY blk) AS k FROM b0),
     c AS (SELECT *, sum(n) OVER (PARTITION BY did ORDER BY k) AS run FROM b),
     sp AS (SELECT a.did, a.doc_id, a.k AS i, z.k AS j, a.n_lines FROM c a JOIN c z ON a.did = z.did AND z.k >= a.k AND z.run - a.run + a.n <= (SELECT most FROM lim)),
     sw AS (SELECT sp.doc_id, string_agg(b.x, ' ' ORDER BY b.k) AS p FROM sp JOIN b ON b.did = sp.did AND b.k BETWEEN sp.i AND sp.j
            WHERE sp.j > sp.i OR sp.n_lines > 1 GROUP BY sp.did, sp.doc_id, sp.i, sp.j),
     st AS (SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?;]) ', '\1' || chr(1), 'g'), chr(1))) AS p FROM l WHERE regexp_matches(line, '[.!?;] ')),
     pas AS (SELECT doc_id, x AS p FROM lw WHERE x <> '' UNION ALL SELECT doc_id, trim(regexp_replace(lower(p), '[^0-9a-z]+', ' ', 'g')) FROM st UNION ALL SELECT doc_id, p FROM sw),
     pw AS (SELECT row_number() OVER () AS pid, doc_id, string_split(p, ' ') AS w FROM pas),
     pg AS (SELECT pid, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM pw WHERE len(w) > 1),
     pair AS (SELECT pid, doc_id, license, tid, len(pg.g) AS a, len(tg.g) AS b, len(list_intersect(pg.g, tg.g)) AS s
              FROM pg JOIN tg ON len(pg.g) BETWEEN len(tg.g) * 0.85 / 1.15 AND len(tg.g) * 1.15 / 0.85),
     hit AS (SELECT pid, doc_id, license, max(2.0::DOUBLE * s / (a + b)) AS dice FROM pair WHERE 2.0::DOUBLE * s / (a + b) >= 0.85 GROUP BY pid, doc_id, license),
     tb AS (SELECT tid, i - 1 AS k, w[i] || ' ' || w[i + 1] AS gram FROM norm, unnest(range(1, len(w))) AS t(i)),
     dw AS MATERIALIZED (SELECT row_number() OVER () AS did, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', ' ', 'g')), ' ') AS w FROM documents),
     db AS (SELECT did, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM dw, unnest(range(1, len(w))) AS t(i)),
     al AS (SELECT db.did, tb.tid, db.pos - tb.k AS start, count(*) AS votes FROM db JOIN tb USING (gram) GROUP BY db.did, tb.tid, db.pos - tb.k),
     wn AS (SELECT dw.doc_id, n.license, al.start, tg.g AS tgrams, dw.w[greatest(al.start, 0) + 1 : al.start + len(n.w)] AS w FROM al JOIN norm n USING (tid) JOIN tg ON tg.tid = al.tid JOIN dw ON dw.did = al.did WHERE 2 * al.votes >= 0.85 / 1.15 * (len(n.w) - 1) - 1e-9),
     wg AS (SELECT doc_id, license, start, tgrams, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM wn),
     wh AS (SELECT doc_id, license, start, 2.0::DOUBLE * len(list_intersect(g, tgrams)) / (len(g) + len(tgrams)) AS dice FROM wg),
     a AS (SELECT doc_id, license, max(dice) AS dice, CAST(count(*) AS BIGINT) AS n FROM hit GROUP BY doc_id, license),
     z AS (SELECT doc_id, license, max(dice) AS dice, CAST(count(DISTINCT start) AS BIGINT) AS n FROM wh WHERE dice >= 0.85 GROUP BY doc_id, license)
SELECT doc_id, license, greatest(coalesce(a.dice, 0), coalesce(z.dice, 0)) AS dice, coalesce(a.n, 0) AS n_passages, coalesce(z.n, 0) AS n_windows FROM a FULL JOIN z USING (doc_id, license)
""".replace("{values}", ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates()))



def op12_sql(rounds: int = 4) -> str:
    """Codebooks of four parts and 256 entries: each round a table of nearest entries and one of new entries."""
    near = """near{k} AS MATERIALIZED (SELECT x.rid, x.part, min(CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS BIGINT) * 256 + b.entry) AS m
          FROM parts x JOIN book{k} b ON b.part = x.part GROUP BY x.rid, x.part)"""
    book = """book{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM book{k} b LEFT JOIN (
          SELECT part, entry, list(c ORDER BY i) AS v FROM (
              SELECT n.part, n.m % 256 AS entry, i, floor(sum(x.v[i]) / count(*)) AS c FROM near{k} n JOIN parts x ON x.rid = n.rid AND x.part = n.part, size, unnest(range(1, size.deep + 1)) AS t(i)
              GROUP BY n.part, n.m % 256, i) GROUP BY part, entry) u ON u.part = b.part AND u.entry = b.entry)"""
    steps = ",\n     ".join(near.format(k=k) + (",\n     " + book.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS rid, vec_id, label, w FROM (
         SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS w FROM embeddings
         WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
     size AS (SELECT max(len(w)) // 4 AS deep FROM kept),
     parts AS MATERIALIZED (SELECT rid, part, w[part * deep + 1 : part * deep + deep] AS v FROM kept, size, unnest(range(4)) AS t(part)),
     book0 AS MATERIALIZED (SELECT part, rid AS entry, v FROM parts WHERE rid < 256),
     {steps},
     coded AS (SELECT n.rid, string_agg(printf('%02x', n.m % 256), '' ORDER BY n.part) AS code, CAST(sum(n.m // 256) AS BIGINT) AS error FROM near{rounds} n GROUP BY n.rid),
     digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS d FROM (SELECT part, entry, i, CAST(v[i] AS BIGINT) AS c FROM book{rounds}, size, unnest(range(1, size.deep + 1)) AS t(i)))
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, (SELECT d FROM digest) AS codebooks_sha256
FROM kept k JOIN coded c USING (rid)
"""


OP13 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS did, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     t AS MATERIALIZED (SELECT did, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
                        FROM (SELECT did, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)),
     k AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT did) >= 3),
     l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY t.lang, t.source, t.term),
     g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source),
     p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + l.v) AS BIGINT) AS p,
                               CAST(1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS BIGINT) AS q
                        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
           FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
     o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {"op1_warc_bundles": OP1, "op2_chat_fingerprint": OP2, "op5_temperature_mix": OP5, "op8_license_dice": OP8, "op12_kd_codebooks": op12_sql(), "op13_source_divergence": OP13}
