"""DuckDB SQL of the document queries that SQL can express, over whole tables."""

from __future__ import annotations

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marked AS (
  SELECT part, doc_id,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM docs
), flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marked LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
  FROM orders, range(1, 6) AS r(step)
), each AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM each
"""


def clustering(size: int, scale: int, count: int, rounds: int, salt: str) -> str:
    """Every round compares every vector with every centroid."""
    parts = [
        f"""
WITH points AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, p) - 1 AS cluster, p AS c
  FROM points QUALIFY cluster < {count}
)"""
    ]
    for k in range(rounds + 1):
        parts.append(
            f""", a{k} AS (
  SELECT r, vec_id, p, cluster, list_sum(list_transform(list_zip(p, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance
  FROM points, c{k}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
)"""
        )
        if k < rounds:
            parts.append(
                f""", m{k} AS (
  SELECT cluster, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(p[i]) AS s, count(*) AS n FROM a{k}, range(1, {size + 1}) AS t(i) GROUP BY cluster, i)
  GROUP BY cluster
), c{k + 1} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""
            )
    last = f"a{rounds}"
    parts.append(
        f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} USING (cluster)
"""
    )
    return "".join(parts)


def mixing(weights: tuple[int, ...], rounds: int) -> str:
    """``rounds`` bounds how often the excess is shared again; the rate settles long before it."""
    parts = [
        rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS shuffled
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, ([{", ".join(map(str, weights))}])[rank % {len(weights)} + 1] AS weight FROM sources
), r0 AS (SELECT 0::DOUBLE AS rate, (3 * sum(source_size) // 2)::BIGINT AS budget FROM weighed)"""
    ]
    for k in range(rounds):
        parts.append(
            f""", r{k + 1} AS (
  SELECT coalesce((budget - sum(CASE WHEN weight * rate > most THEN most ELSE 0 END))::DOUBLE
                / nullif(sum(CASE WHEN weight * rate > most THEN 0 ELSE weight END), 0)::DOUBLE, any_value(rate)) AS rate, budget
  FROM weighed, r{k} GROUP BY budget
)"""
        )
    parts.append(
        f""", targets AS (
  SELECT source, source_size, rank, CASE WHEN weight * rate > most THEN most::DOUBLE ELSE weight * rate END AS target, budget
  FROM weighed, r{rounds}
), placed AS (
  SELECT row_number() OVER () AS r, doc_id, size, source_size, rank, shuffled, target, budget,
         sum(size) OVER (PARTITION BY rank ORDER BY shuffled, size, doc_id ROWS UNBOUNDED PRECEDING) AS reached
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), queue AS (
  SELECT *, CASE WHEN target > 0 THEN (epoch * source_size + reached)::DOUBLE / target ELSE 0 END AS finish
  FROM placed, range(0, 2) AS e(epoch)
), sent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, shuffled, size, doc_id ROWS UNBOUNDED PRECEDING) <= budget AS taken
  FROM queue
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
       any_value(target) AS target, sum(CASE WHEN taken THEN size ELSE 0 END)::BIGINT AS taken
FROM sent GROUP BY r
"""
    )
    return "".join(parts)
