"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import byte_bpe, decontaminate, drift_clusters, edit_counts, filter_audit, interpolated_lm, media_chunks, near_duplicates, personal_data, secrets, toxicity, url_filters, warc
from weft.llm.common import fold, table, written


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.count_edits(edit_counts.release_edits(table(spark, sf_dir, "documents")), tokenizer_file(), split_pattern())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find(table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents")))


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.features_of(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    stored, _ = written(warc.archives(pages), "warc")
    as_id = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return warc.records(stored).select(F.when(F.col("record_id") != "", as_id("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file(), split_pattern())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.passages(docs, model).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_clusters.cluster(table(spark, sf_dir, "embeddings")).drop("scans")  # how often a vector was scanned is no part of the result


def either_case(pattern: str) -> str:
    """A (?i:...) group with both cases of each letter spelled out, as the other engine folds letters beyond ASCII too."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)


def places_sql(name: str, pattern: str) -> str:
    """(row, m, said, start, stop) of all matches of a pattern in the texts of docs(row, text)."""
    quoted = either_case(pattern).replace("'", "''")
    return f"""{name} AS (SELECT row, said, sum(length(gap) + length(said)) OVER (PARTITION BY row ORDER BY m) - length(said) AS start, sum(length(gap) + length(said)) OVER (PARTITION BY row ORDER BY m) AS stop
FROM (SELECT row, unnest(said) AS said, unnest(gap[1:len(said)]) AS gap, generate_subscripts(said, 1) AS m FROM (SELECT row, regexp_extract_all(text, '{quoted}') AS said, string_split_regex(text, '{quoted}') AS gap FROM docs) x) y)"""


#: Every pair of parts of a text is looked at; TAIL and SCOPE as in the operator.
SECRETS_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), {places_sql("a", secrets.ASSIGN)}, {places_sql("k", secrets.ACCESS)}, {places_sql("h", secrets.HEX)}, {places_sql("n", secrets.ACCOUNT)}, {places_sql("e", secrets.ENDPOINT)},
v AS (SELECT *, length(regexp_extract(said, '{either_case(secrets.ASSIGN).replace("'", "''")}', 1)) AS size FROM a),
every AS (SELECT row, start, stop, CASE WHEN size >= 6 THEN 0 ELSE 4 END AS rank, 'secret' AS role FROM v UNION ALL SELECT row, start, stop, CASE WHEN stop - start >= 20 THEN 1 ELSE 3 END, 'identifier' FROM k
UNION ALL SELECT row, start, stop, CASE WHEN stop - start >= 24 THEN 2 ELSE 4 END, 'secret' FROM h UNION ALL SELECT row, start, stop, 3, 'identifier' FROM n UNION ALL SELECT row, start, stop, 5, 'endpoint' FROM e),
parts AS (SELECT *, greatest(start, stop - {secrets.TAIL}) AS last FROM every),
near AS (SELECT w.row, w.start, w.stop, w.rank, w.role, bool_or(p.role = 'identifier') AS i, bool_or(p.role = 'secret') AS s, bool_or(p.role = 'endpoint') AS e, bool_or(p.role = 'identifier' AND p.rank < 3) AS si, bool_or(p.role = 'secret' AND p.rank < 3) AS ss
FROM parts w JOIN parts p ON p.row = w.row AND p.last >= w.start - {secrets.SCOPE} AND p.start <= w.last + {secrets.SCOPE} WHERE w.rank >= 3 GROUP BY w.row, w.start, w.stop, w.rank, w.role),
added AS (SELECT row, start, stop, rank FROM near WHERE CASE role WHEN 'identifier' THEN s AND (ss OR e) WHEN 'secret' THEN i AND (si OR e) ELSE i AND s END),
told AS (SELECT row, start, stop, rank, (['{"','".join(secrets.KINDS)}'])[rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said FROM (SELECT row, start, stop, rank FROM every WHERE rank < 3 UNION ALL SELECT * FROM added) x),
each AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(said, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank, stop) AS spans, count(*) FILTER (rank > 2) AS n_linked FROM told GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM docs LEFT JOIN each USING (row)"""



def url_filters_sql() -> str:
    """Each glob as a regular expression over `.` + host + path; the first of the longest decides."""
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    globs = sorted(url_filters.GLOBS, key=lambda g: -len(g[0]))
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    first = lambda items: "CASE " + " ".join(f"WHEN regexp_full_match('.' || host || path, {quoted(url_filters.regex(g))}) THEN {quoted(v)}" for g, v in items) + " END"
    of_rule = lambda value: [(url_filters.rule_glob(h, p), value(h, p, v)) for h, p, v in rules]
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u), p AS (SELECT page_id, translate(raw, '{url_filters.UPPER}', '{url_filters.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {first(of_rule(lambda h, p, v: h + p))} AS rule, {first(of_rule(lambda h, p, v: v))} AS ruled FROM p), m AS (SELECT *, CASE WHEN rule IS NULL THEN {first([(g, g) for g, _ in globs])} END AS pattern, {first(globs)} AS globbed FROM r)
SELECT page_id, host, path, rule, pattern, coalesce(ruled, globbed, 'allow') AS verdict FROM m"""


FILTER_AUDIT_SQL = """WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents), firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS BIGINT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS BIGINT)), 0) AS toxic FROM labels GROUP BY doc_id), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
o AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM o GROUP BY ALL),
f(k) AS (VALUES (1), (2), (3), (4), (5)), perms AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT ks, list_aggregate(list_transform(ks, lambda x: 'ABCDE'[x]), 'string_agg', '') AS filter_order, f.k AS step FROM perms, f),
e AS (SELECT part, filter_order, step, ks[step] AS own, n, good, toxic, fails[ks[step]] AS fail, list_bool_or(list_transform(ks[1:step - 1], lambda x: fails[x])) IS TRUE AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS unique_fails,
sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""


def drift_clusters_sql(clusters: int = drift_clusters.CLUSTERS, rounds: int = drift_clusters.ROUNDS, dim: int = drift_clusters.DIM) -> str:
    """Plain rounds: every vector against every centroid."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT row, min({{'d': d, 'c': c}}) AS best FROM (SELECT row, c, list_sum(list_transform(list_zip(v.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k}) x GROUP BY row)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v JOIN a{k} USING (row)) y GROUP BY c, j)")
            steps.append(f"m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{k} GROUP BY c), c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({drift_clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{drift_clusters.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM v ORDER BY c LIMIT {clusters}), {", ".join(steps)},
r AS (SELECT vec_id, best.c AS c, CAST(best.d AS BIGINT) AS distance FROM a{rounds} JOIN v USING (row))
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM r JOIN c{rounds} USING (c)"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_interpolated_lm, op2_decontaminate, op3_edit_counts, op4_personal_data, op5_secrets,
        op6_media_chunks, op7_warc, op8_byte_bpe, op9_toxicity, op10_near_duplicates,
        op11_url_filters, op12_filter_audit, op13_drift_clusters,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_secrets": SECRETS_SQL,
    "op7_warc": """WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS holder FROM h WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(h.html) AS BIGINT) AS payload_bytes, sha1(h.html) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM holder AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM h LEFT JOIN g ON g.html = h.html""",
    "op11_url_filters": url_filters_sql(),
    "op12_filter_audit": FILTER_AUDIT_SQL,
    "op13_drift_clusters": drift_clusters_sql(),
}
