"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import licenses, pii, quality, repair_queries, urls
from vectorloom.llm.codes import read_documents, write_tokens
from vectorloom.llm.minhash import near_duplicates
from vectorloom.llm.mixing import mix
from vectorloom.llm.packing import pack
from vectorloom.llm.pivots import top_inner_products
from vectorloom.llm.registered import LLM_ORACLES, LLM_QUERIES, query, table
from vectorloom.llm.transducer import count_tokens
from vectorloom.session import materialize

@query("op1_token_codes")
def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return read_documents(spark, manifest).drop("file")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w) AS n_words,
         CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
         coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END,
          CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END,
          CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
          CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END,
          CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END] AS v
  FROM m),
grid(seq, r, cuts) AS (VALUES @GRID@),
good AS (
  SELECT lang, list_transform((SELECT list(grid ORDER BY seq) FROM grid), lambda g: len(list_filter(g.cuts, lambda c: v[g.r] > c))) AS above
  FROM f JOIN (
    SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
cells AS (SELECT lang, above, count(*) AS n FROM good GROUP BY ALL),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY lang),
shares(stops, share) AS (VALUES @SHARES@),
lim AS (
  SELECT lang, stops, max(CASE WHEN p <= @ERROR@ * share / (SELECT count(*) FROM n) THEN k ELSE -1 END) AS allowed
  FROM (
    SELECT lang, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(@RATE@)
             + (n - k) * ln(1 - @RATE@))) OVER (PARTITION BY lang ORDER BY k) AS p
    FROM (SELECT lang, n, unnest(range(0, CAST(floor(n * @RATE@) AS BIGINT) + 1)) AS k FROM n)), shares
  GROUP BY lang, stops),
steps AS (
  SELECT seq, len(cuts) - g AS needed, row_number() OVER (ORDER BY seq, g) AS s
  FROM (SELECT seq, cuts, unnest(range(len(cuts))) AS g FROM grid)),
tried AS (
  SELECT lang, CAST(0 AS BIGINT) AS s, [11, 11, 11, 11, 11]::BIGINT[] AS needed, 0 AS stops, 0 AS stopped FROM n
  UNION ALL
  SELECT lang, s, CASE WHEN skip OR NOT passed THEN needed ELSE next END, CASE WHEN skip OR passed THEN stops ELSE stops + 1 END,
         CASE WHEN skip OR passed THEN stopped ELSE seq END
  FROM (
    SELECT x.lang, x.s, x.needed, x.next, x.stops, x.stopped, x.seq, x.stopped = x.seq AS skip,
           coalesce(coalesce(sum(c.n) FILTER (WHERE c.above[1] >= next[1] OR c.above[2] >= next[2] OR c.above[3] >= next[3]
             OR c.above[4] >= next[4] OR c.above[5] >= next[5]), 0) <= any_value(allowed) AND any_value(allowed) >= 0, false) AS passed
    FROM (
      SELECT t.lang, steps.s, t.needed, t.stops, t.stopped, steps.seq,
             [CASE WHEN seq = 1 THEN steps.needed ELSE t.needed[1] END, CASE WHEN seq = 2 THEN steps.needed ELSE t.needed[2] END,
              CASE WHEN seq = 3 THEN steps.needed ELSE t.needed[3] END, CASE WHEN seq = 4 THEN steps.needed ELSE t.needed[4] END,
              CASE WHEN seq = 5 THEN steps.needed ELSE t.needed[5] END] AS next
      FROM tried t JOIN steps ON steps.s = t.s + 1) x
    LEFT JOIN lim ON x.lang IS NOT DISTINCT FROM lim.lang AND x.stops = lim.stops
    JOIN cells c ON x.lang IS NOT DISTINCT FROM c.lang
    GROUP BY x.lang, x.s, x.needed, x.next, x.stops, x.stopped, x.seq)),
cut AS (
  SELECT lang, r, cuts[len(cuts) - needed[seq] + 1] AS c
  FROM tried JOIN grid ON needed[seq] <= len(cuts) WHERE s = (SELECT max(s) FROM steps))
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM f.lang AND f.v[cut.r] > cut.c) AS kept
FROM f
"""
QUALITY_SQL = (
    QUALITY_SQL.replace("WITH d AS", "WITH RECURSIVE d AS", 1)
    .replace(
        "@GRID@",
        ", ".join(
            f"({i}, {list(quality.RULES).index(r) + 1}, {list(quality.RULES[r])}::DOUBLE[])"
            for i, r in enumerate(quality.SEQUENCE, 1)
        ),
    )
    .replace("@SHARES@", ", ".join(f"({stops}, {quality.error_share(stops)!r}::DOUBLE)" for stops in range(len(quality.SEQUENCE))))
    .replace("@ERROR@", repr(quality.ERROR))
    .replace("@RATE@", repr(quality.RISK))
)


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured, name = quality.measure(docs)
    # Numbers only: the texts are read once, the measures twice.
    measured = materialize(measured.drop("text"), "measures")
    cutoffs = quality.joint_cutoffs(measured, table(spark, sf_dir, "labels"), name)
    m = F.col(name)
    return measured.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        (m["n_lines"] - m["n_distinct_lines"]).alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        quality.base_failed(m).alias("base_failed"),
        quality.verdicts(measured, cutoffs, name).alias("kept"),
    )


@query("op5_harmonic_packing")
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(coalesce(first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (
           ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, cap), cap)
           AS target
  FROM l),
o AS (
  SELECT source, j,
         CAST('0x' || substr(md5('0:' || j || ':' || coalesce('s' || source, 'null')), 1, 12) AS BIGINT)
           / 281474976710656.0 AS o
  FROM t, range(32) x(j)),
r AS (
  SELECT doc_id, d.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT r.*, j, size * least(floor((k + 1) * rate + o) - floor(k * rate + o), 3) AS taken
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source),
b AS (
  SELECT source, arg_min(j, (miss, j)) AS j
  FROM (SELECT source, j, abs(sum(taken) - first(target)) AS miss FROM x GROUP BY source, j) GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken
FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.j = b.j
"""


@query("op8_source_mixing", MIX_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT row_number() OVER () AS k, page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
r(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, u.host AS host, u.path AS path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""


@query("op9_url_filters", URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


SPAN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p(kind, o, pat) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 3, '[0-9]([\x20-]?[0-9])+'),
  ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]'),
  ('iban', 5, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b'),
  ('ssn', 6, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')),
m AS (
  SELECT k, t, kind, o, regexp_extract_all(t, pat) AS m, regexp_split_to_array(t, pat) AS g
  FROM d, p WHERE regexp_matches(t, pat)),
s AS (
  SELECT k, t, kind, o, m[i] AS x,
         CAST(list_sum([length(y) for y in g[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
c AS (
  SELECT *, b + length(x) AS e, regexp_replace(x, '[^0-9]', '', 'g') AS digits,
         string_split(replace(x, ' ', ''), '') AS a,
         lower(substr(t, greatest(b - 40, 0) + 1, b - greatest(b - 40, 0)) || ' ' || substr(t, b + length(x) + 1, 20)) AS near
  FROM s),
v AS (
  SELECT k, kind, o, b, e FROM c WHERE CASE kind
    WHEN 'ip' THEN list_max([CAST(y AS HUGEINT) for y in string_split(x, '.')]) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([
      CASE WHEN i % 2 = 0 THEN CAST(reverse(digits)[i] AS INT)
           ELSE CAST(reverse(digits)[i] AS INT) END
      + CASE WHEN i % 2 = 0 THEN CAST(reverse(digits)[i] AS INT) - CASE WHEN CAST(reverse(digits)[i] AS INT) > 4 THEN 9 ELSE 0 END
             ELSE 0 END for i in range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN len(a) BETWEEN 15 AND 34 AND list_reduce(
      [CASE WHEN ascii(y) >= 65 THEN ascii(y) - 55 ELSE ascii(y) - 48 END for y in list_concat(a[5:], a[1:4])],
      lambda r, y: (r * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
    WHEN 'ssn' THEN 0.4 + CASE WHEN regexp_matches(near, 'ssn|social security') THEN 0.2 ELSE 0 END
      - CASE WHEN regexp_matches(near, 'example|test|dummy|version|sample') THEN 0.2 ELSE 0 END >= 0.5
    ELSE true END)
SELECT doc_id,
       count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b) FILTER (WHERE o <= 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY o, b), '') AS spans
FROM d LEFT JOIN v USING (k) GROUP BY k, doc_id
"""


@query("op10_personal_data", SPAN_SQL)
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = found.select("doc_id", name)

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def kind_is(*kinds):
        return F.filter(name, lambda s: s["kind"].isin(*kinds))

    return spans.select(
        "doc_id",
        *[F.size(kind_is(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(listed(kind_is(*pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(name)).alias("spans"),
    )


LICENSE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
i AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM w),
b AS (
  SELECT k, i - 1 AS i, CASE
    WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by'
    WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
    WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label
  FROM i WHERE label IS NOT NULL),
n AS (
  SELECT k, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base
  FROM b GROUP BY k),
l AS (
  SELECT k, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)),
t(label, words) AS (VALUES @TEMPLATES@),
m AS (
  SELECT k, list(DISTINCT label) AS own, max(share) AS best FROM (
    SELECT k, label, len(list_intersect(l.words, t.words)) / len(t.words) AS share,
           len(list_intersect(l.words, t.words)) >= ceil(@THRESHOLD@ * len(t.words) - 1e-9) AS met
    FROM l, t) WHERE met GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, own))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN n USING (k) LEFT JOIN m USING (k)
"""
LICENSE_SQL = LICENSE_SQL.replace(
    "@TEMPLATES@",
    ", ".join(f"('{label}', {sorted(set(text.split()))})" for label, text in licenses.TEMPLATES.items()),
).replace("@THRESHOLD@", repr(licenses.THRESHOLD))


@query("op6_license_scan", LICENSE_SQL)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined)


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")


PIVOT_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(q.v, b.v) AS BIGINT) AS score
  FROM e q, e b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op4_pivot_search", PIVOT_SQL)
def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


__all__ = ["LLM_ORACLES", "LLM_QUERIES", "repair_queries"]
