"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

import string

from leafmill.llm.licenses import PHRASES, STRETCH, TEMPLATES, THETA

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan(stretch: int = STRETCH) -> str:
    """Phrase places by position; templates against every run of words. A block
    ends where, from one of its words on, enough are together for the first time;
    of all such runs, by end, those that begin after the last one taken stay."""
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {_list(p.split())})) AS pos FROM words"
        for p, label in PHRASES.items()
    )
    runs = []
    for name, text in TEMPLATES.items():
        known = _list(sorted(set(text.split())))
        n, reach = len(set(text.split())), stretch * len(text.split())
        need = f"ceil({THETA} * {n} - 1e-9)"
        held = lambda size: f"len(list_intersect(list_distinct(w[i : i + {size} - 1]), {known}))"
        starts = f"SELECT k, doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains({known}, w[i]))) AS i FROM words"
        ends = f"list_filter(range(CAST({need} AS BIGINT), {reach + 1}), lambda z: {held('z')} >= {need})[1]"
        runs.append(f"SELECT k, doc_id, '{name}' AS label, {held(reach)} / {n}::DOUBLE AS share, i - 1 AS f, i - 2 + {ends} AS g FROM ({starts}) WHERE {held(reach)} >= {need}")
    runs = " UNION ALL ".join(runs)
    return f"""WITH low AS (SELECT row_number() OVER () AS k, doc_id, {_LOW} AS t FROM documents),
    words AS (SELECT k, doc_id, {_WORDS.format("t")} AS w FROM low),
    places AS ({places}),
    base AS (SELECT doc_id, count(*) AS n, min(pos) AS f, max(pos) AS g, list(DISTINCT label) AS b FROM places GROUP BY doc_id),
    runs AS ({runs}),
    best AS (SELECT k, list(DISTINCT label) AS m, max(share) AS s FROM runs GROUP BY k),
    ordered AS (SELECT k, label, list([[f, g]] ORDER BY g, f DESC) AS l FROM runs GROUP BY k, label),
    taken AS (SELECT k, label, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1][1] > a[-1][2] THEN list_concat(a, x) ELSE a END)) AS b FROM ordered),
    blocks AS (SELECT k, string_agg(label || ':' || b[1] || ':' || b[2], ',' ORDER BY b[1], b[2], label) AS said FROM taken GROUP BY k)
    SELECT w.doc_id, len(w.w) AS n_words, coalesce(base.n, 0) AS n_base, f AS first_word, g AS last_word,
    coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(m, [])))), ','), '') AS labels,
    CAST(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(s, 0) END AS DOUBLE) AS score, coalesce(said, '') AS blocks
    FROM words w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN best ON best.k = w.k LEFT JOIN blocks ON blocks.k = w.k"""


def centroid_clustering(k: int = 16, rounds: int = 3, dim: int = 64, seed: int = 1) -> str:
    """Every distance to every centroid, in integers, round by round."""
    far = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * e::DOUBLE) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS n, v FROM kept QUALIFY n < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT x.row, x.vec_id, x.v, min(struct_pack(d := {far}, n := c.n)) AS best FROM kept x, c{r} c GROUP BY x.row, x.vec_id, x.v)")
        steps.append(f"s{r} AS (SELECT n, i, sum(e) AS s, count(*) AS m FROM (SELECT best.n AS n, unnest(range(1, {dim + 1})) AS i, unnest(v) AS e FROM a{r}) GROUP BY n, i)")
        steps.append(f"m{r} AS (SELECT n, list(CAST((s - (((s % m) + m) % m)) // m AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY n)")
        steps.append(f"c{r + 1} AS (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.n = c.n)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(best.n AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.n) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} c ON c.n = best.n"""
