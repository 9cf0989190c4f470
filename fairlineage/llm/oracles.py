"""SQL counterparts, for DuckDB, of the registered queries that SQL can express."""

from . import licenses
from .secrets import BASE_RULES, RULES

SQL: dict[str, str] = {}


def _secret_spans() -> str:
    def rule(rank, r):
        p = r.pattern.replace("'", "''")
        return f"""
    list_filter(list_transform(range(len(regexp_extract_all(t, '{p}', 0))), lambda i: {{
        's': list_sum(list_transform(string_split_regex(t, '{p}')[1:i+1], lambda x: length(x)))
           + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}', 0)[1:i], lambda x: length(x))), 0),
        'r': {rank}, 'k': '{r.kind}', 'n': length(regexp_extract_all(t, '{p}', 0)[i+1]),
        'g': length(regexp_extract_all(t, '{p}', {r.group})[i+1])}}), lambda x: x.g >= {r.least})"""

    lists = ",".join(rule(rank, r) for rank, r in enumerate(RULES))
    text = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ',')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, list_sort(flatten([{lists}])) AS a FROM docs)
SELECT doc_id, len(list_filter(a, lambda x: x.k = 'assign')) AS n_assign, len(list_filter(a, lambda x: x.k = 'access')) AS n_access,
    len(list_filter(a, lambda x: x.k = 'hex')) AS n_hex,
    sha256({text.format(f"list_filter(a, lambda x: x.r < {len(BASE_RULES)})")}) AS base_sha256,
    {text.format('a')} AS spans
FROM found"""


SQL["op5_secrets"] = _secret_spans()


def _licenses() -> str:
    def lowered(x: str) -> str:
        return f"translate({x}, '{licenses._CAPITALS}', '{licenses._SMALL}')"

    def canonical(x: str) -> str:
        out = f"regexp_replace({lowered(x)}, '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
        for written, meant in licenses.SPELLINGS:
            out = f"replace({out}, '{written}', '{meant}')"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    marked = "regexp_matches({}, '" + licenses.MARKS + "')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in sorted(licenses.known_digests().items()))
    return f"""
WITH known(digest, license) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT no, t, string_split(t, chr(10)) AS lines, string_split_regex(t, '\n[ \t\r]*\n') AS paragraphs FROM docs),
units AS (
    SELECT no, unnest(lines) AS u FROM parts
    UNION ALL SELECT no, u FROM (SELECT no, unnest(paragraphs) AS u FROM parts) WHERE regexp_matches(u, '{licenses.TWO_LINES}')
    UNION ALL SELECT no, t FROM parts WHERE len(paragraphs) > 1),
found AS (
    SELECT no, license FROM (SELECT no, sha256({canonical('u')}) AS digest FROM units WHERE {marked.format(lowered('u'))})
    JOIN known USING (digest))
SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (license IS NOT NULL)), ','), '') AS licenses,
    count(license) AS n_units
FROM docs LEFT JOIN found USING (no) GROUP BY no, doc_id"""


SQL["op9_licenses"] = _licenses()

SQL["op6_topk"] = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
    SELECT q.vec_id AS query_vec_id, r.vec_id, len(list_filter(list_zip(q.bits, r.bits), lambda z: z[1] <> z[2]))::INTEGER AS distance
    FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_vec_id, rank, vec_id, distance FROM ranked WHERE rank <= 10"""


SQL["op11_block_join"] = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sums AS (SELECT vec_id, v, list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b) AS s FROM good),
pairs AS (
    SELECT q.vec_id AS query_id, r.vec_id, greatest(-1, least(1, list_reduce(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]),
        lambda a, b: a + b) / sqrt(q.s * r.s))) AS score
    FROM sums q JOIN sums r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _clusters(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Assignments and exact floors, round by round; a vector is a list of integers."""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
at0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, x AS c FROM kept
    ORDER BY sha256('1:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
own{r} AS MATERIALIZED (
    SELECT no, min({{'d': d, 'j': cluster}}) AS best FROM (
        SELECT no, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, at{r})
    GROUP BY no)""")
        if r < rounds:
            steps.append(f"""
at{r + 1} AS MATERIALIZED (
    SELECT cluster, CASE WHEN count(f) = 0 THEN any_value(c) ELSE list(f ORDER BY i) END AS c FROM (
        SELECT a.cluster, any_value(c) AS c, i, floor(sum(x[i]) / count(x[i]))::BIGINT AS f
        FROM at{r} a CROSS JOIN range(1, {dims + 1}) AS t(i)
        LEFT JOIN (SELECT best.j AS cluster, x FROM own{r} JOIN kept USING (no)) USING (cluster) GROUP BY a.cluster, i)
    GROUP BY cluster)""")
    return f"""
WITH {",".join(steps)},
sums AS (SELECT best.j AS cluster, sum(best.d)::BIGINT AS cluster_inertia FROM own{rounds} GROUP BY best.j)
SELECT vec_id, cluster, best.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM own{rounds} JOIN kept USING (no) JOIN sums ON best.j = cluster JOIN at{rounds} USING (cluster)"""


SQL["op12_shallot"] = _clusters()
