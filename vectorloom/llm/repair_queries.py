"""Registered queries on spelling, secrets and conversations, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import conversations, secret_scan, spelling
from vectorloom.llm.registered import query, table


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of the UTF-8 bytes of a text, bit by bit."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[('0x' || hex(encode({text}))[2 * i - 1:2 * i])::BIGINT, "
        f"0, 0, 0, 0, 0, 0, 0] for i in range(1, strlen({text}) + 1)])), "
        "lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
    )


SPELLING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
         unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
c AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM d GROUP BY ALL),
h AS (SELECT w, n, @CRC@ AS h FROM (SELECT *, id || ':' || w AS k FROM c WHERE length(w) >= 6)),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS gap FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT g.word, v.word FROM g JOIN v ON g.gap = v.word
  UNION SELECT v.word, g.word FROM g JOIN v ON g.gap = v.word),
s AS (SELECT a, count(*) AS n_near, min((-n, b)) AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n
  FROM v LEFT JOIN s ON a = word),
r AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL),
e AS (SELECT r.word, root FROM r JOIN f ON f.word = root AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
""".replace("@CRC@", crc32_sql("k"))


@query("op11_spelling_variants", SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


SECRET_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p(kind, o, pat) AS (VALUES
  ('assign', 1, '@ASSIGN@'), ('access', 2, 'AKIA[A-Z0-9]+'), ('hex', 3, '[0-9a-f]+'), ('random', 4, '[A-Za-z0-9+/_-]+')),
m AS (
  SELECT k, kind, o, regexp_extract_all(t, pat) AS m, regexp_split_to_array(t, pat) AS g
  FROM d, p WHERE regexp_matches(t, pat)),
pos AS (
  SELECT k, kind, o, x, CAST(coalesce(sum(length(y) + length(x)) OVER w, 0) + first_length AS BIGINT) AS b
  FROM (
    SELECT k, kind, o, length(g[1]) AS first_length, unnest(m) AS x, unnest(g[2:]) AS y, unnest(range(len(m))) AS i FROM m)
  WINDOW w AS (PARTITION BY k, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (
  SELECT k, kind, o, x, b, b + length(x) AS e FROM pos WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(x, '@ASSIGN@', 2)) >= 8
    WHEN 'access' THEN length(x) >= 16 WHEN 'hex' THEN length(x) >= 32 ELSE length(x) >= 20 END),
base AS (SELECT * FROM a WHERE o < 4),
cand AS (
  SELECT * FROM a WHERE o = 4 AND NOT EXISTS (SELECT 1 FROM base WHERE base.k = a.k AND base.b < a.e AND base.e > a.b)),
ch AS (
  SELECT k, i, CASE WHEN regexp_matches(c, '[A-Za-z0-9+/_-]') THEN c ELSE '' END AS c
  FROM (SELECT k, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM d)),
masked AS (
  SELECT k, i, CASE WHEN EXISTS (SELECT 1 FROM base WHERE base.k = ch.k AND base.b <= i AND i < base.e) THEN '' ELSE c END AS c
  FROM ch),
rs AS (
  SELECT row_number() OVER () AS k, x FROM (
    SELECT x FROM base WHERE o > 1
    UNION ALL SELECT sha256(t) FROM d
    UNION ALL SELECT replace(base64(unhex(sha256(t))), '=', '') FROM d)),
ns AS (SELECT k, CAST(CAST('0x' || substr(sha256(t), 1, @DIGITS@) AS BIGINT) AS VARCHAR) AS x FROM d),
pairs AS (
  SELECT 0 AS secret, coalesce(lag(c) OVER (PARTITION BY k ORDER BY i), '') AS p, c FROM masked
  UNION ALL
  SELECT 0, coalesce(lag(c) OVER (PARTITION BY k ORDER BY i), ''), c
  FROM (SELECT k, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS i FROM ns)
  UNION ALL
  SELECT 1, coalesce(lag(c) OVER (PARTITION BY k ORDER BY i), ''), c
  FROM (SELECT k, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS i FROM rs)),
n AS (SELECT secret, p, c, count(*) AS n FROM pairs WHERE c <> '' GROUP BY ALL),
tot AS (SELECT secret, p, sum(n) AS total FROM n GROUP BY ALL),
sym AS (SELECT unnest(string_split('@ALPHABET@', '')) AS c),
steps AS (
  SELECT p.c AS p, sym.c AS c,
         round(1000 * ln((coalesce(r.n, 0) + 1) / (coalesce(rt.total, 0) + 66)))
         - round(1000 * ln((coalesce(o.n, 0) + 1) / (coalesce(ot.total, 0) + 66))) AS v
  FROM (SELECT c FROM sym UNION ALL SELECT '') p CROSS JOIN sym
  LEFT JOIN n r ON r.secret = 1 AND r.p = p.c AND r.c = sym.c LEFT JOIN n o ON o.secret = 0 AND o.p = p.c AND o.c = sym.c
  LEFT JOIN tot rt ON rt.secret = 1 AND rt.p = p.c LEFT JOIN tot ot ON ot.secret = 0 AND ot.p = p.c),
scored AS (
  SELECT k, b, e FROM (
    SELECT k, b, e, coalesce(lag(c) OVER (PARTITION BY k, b ORDER BY i), '') AS p, c
    FROM (SELECT k, b, e, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS i FROM cand))
  JOIN steps USING (p, c) GROUP BY k, b, e HAVING sum(v) >= @THRESHOLD@),
f AS (SELECT k, kind, o, b, e FROM base UNION ALL SELECT k, 'random', 4, b, e FROM scored)
SELECT doc_id, count(*) FILTER (WHERE o = 1) AS n_assign, count(*) FILTER (WHERE o = 2) AS n_access,
       count(*) FILTER (WHERE o = 3) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (WHERE o < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o), '') AS spans
FROM d LEFT JOIN f USING (k) GROUP BY k, doc_id
"""
# The letters of an assignment's name in either case, spelled out: the engines fold case differently.
ASSIGN_SQL = (
    "("
    + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )
    + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
SECRET_SQL = (
    SECRET_SQL.replace("@ASSIGN@", ASSIGN_SQL)
    .replace("@ALPHABET@", secret_scan.ALPHABET)
    .replace("@THRESHOLD@", str(secret_scan.THRESHOLD))
    .replace("@DIGITS@", str(secret_scan.NUMBER_DIGITS))
)


@query("op12_secret_scan", SECRET_SQL)
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col(name)
    counts = [secret_scan.number_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS]
    base = secret_scan.marked(spans, *secret_scan.BASE_KINDS)
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.marked(spans, *secret_scan.KINDS).alias("spans"),
    )


CONVERSATION_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, @CRC@ % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations)),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (
  SELECT ids.c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM r),
f AS (
  SELECT c, i, turn, role, text, role[1:1] AS ini,
         CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated'
              ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) AS before
  FROM o),
n AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY c),
ins(st, added, state, lines) AS (VALUES
  ('-', '', '-', ''), ('-', 'I', 'u', '@user:'), ('-', 'II', 'a', '@user:@assistant:'),
  ('s', '', 's', ''), ('s', 'I', 'u', '@user:'), ('s', 'II', 'a', '@user:@assistant:'),
  ('u', '', 'u', ''), ('u', 'I', 'a', '@assistant:'), ('u', 'II', 'u', '@assistant:@user:'),
  ('a', '', 'a', ''), ('a', 'I', 'u', '@user:'), ('a', 'II', 'a', '@user:@assistant:')),
best AS (
  SELECT c, CAST(0 AS BIGINT) AS i, '-' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM ids
  UNION ALL
  SELECT c, i, st, cost, audit, lines FROM (
    SELECT p.c, f.i,
           CASE e.edit WHEN 'D' THEN ins.state WHEN 'K' THEN f.ini WHEN 'R' THEN if(ins.state = 'u', 'a', 'u') END AS st,
           p.cost + 3 * length(ins.added) + CASE e.edit WHEN 'D' THEN 4 ELSE if(e.edit = 'R', 3, 0) + if(fault = 'truncated', 3, 0) END AS cost,
           p.audit || ins.added || e.edit AS audit,
           p.lines || replace(ins.lines, '@', chr(10)) || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
             ELSE chr(10) || if(ins.state = 'u', 'assistant', 'user') || ':' || text END AS lines
    FROM best p JOIN f ON f.c = p.c AND f.i = p.i + 1 JOIN ins ON ins.st = p.st
    JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R'
      OR (ini = 's' AND ins.state = '-') OR (ini = 'u' AND ins.state <> 'u') OR (ini = 'a' AND ins.state = 'u'))))
  QUALIFY row_number() OVER (PARTITION BY c, i, st ORDER BY cost, audit) = 1),
done AS (
  SELECT c, cost + 3 * length(added) AS cost, audit || added AS audit, best.lines || replace(ins.lines, '@', chr(10)) AS lines
  FROM best JOIN ins USING (st)
  WHERE ins.state IN ('-', 'a') AND i = (SELECT count(*) FROM f WHERE f.c = best.c)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost + 3 * length(added), audit || added) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(lines[2:]) AS repaired_sha256
FROM ids JOIN done USING (c) LEFT JOIN n USING (c)
""".replace("@CRC@", crc32_sql("k"))


@query("op13_conversation_repair", CONVERSATION_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    return repaired.withColumnRenamed("digest", "repaired_sha256")
