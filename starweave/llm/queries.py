"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from starweave.llm import chat, clusters, decontam, licenses, linededup, lpf, media, negatives, packing, quality, secrets, simhash, urls


def queries() -> dict:
    found = [
        chat.op1_chat_formatting,
        urls.op2_url_filter,
        packing.op3_best_fit_packing,
        licenses.op4_license_scan,
        media.op5_media_columns,
        decontam.op6_benchmark_decontamination,
        linededup.op7_line_dedup,
        quality.op8_quality_classifier,
        simhash.op9_simhash_near_dedup,
        lpf.op10_longest_previous_factors,
        secrets.op11_secret_scan,
        clusters.op12_centroid_clustering,
        negatives.op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '###', '\h'), '</turn>', '\t')"

CHAT = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('### ' || replace({ESCAPED.format("role")}, ':', '\c') || ': ' || {ESCAPED.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def licence_sql() -> str:
    """The scan without an index: every position of every phrase."""
    all_phrases = licenses.phrases()
    name = {p: f"p{k}" for k, p in enumerate(all_phrases)}

    def places(phrase: str) -> str:
        test = " AND ".join(f"w[i + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split()))
        return f"list_filter(range(len(w)), lambda i: {test}) AS {name[phrase]}"

    def near(a: str, b: str, apart: int) -> str:
        return f"len(list_filter({name[a]}, lambda i: len(list_filter({name[b]}, lambda j: abs(i - j) <= {apart})) > 0)) > 0"

    base = [f"CASE WHEN len({name[p]}) > 0 THEN '{label}' END" for p, label in licenses.BASE.items()]
    labels, scores = list(base), []
    for label, (mandatory, supporting, apart) in licenses.TEMPLATES.items():
        hit = " AND ".join([f"len({name[mandatory[0]]}) > 0", *[near(mandatory[0], m, apart) for m in mandatory[1:]]])
        labels.append(f"CASE WHEN {hit} THEN '{label}' END")
        share = " + ".join(f"CASE WHEN {near(mandatory[0], s, apart)} THEN 1.0::DOUBLE ELSE 0.0 END" for s in supporting)
        scores.append(f"CASE WHEN {hit} THEN " + (f"0.7::DOUBLE + 0.3::DOUBLE * (({share}) / {len(supporting)})" if supporting else "1.0::DOUBLE") + " ELSE 0.0 END")
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))), ',')"
    every = " || ".join(name[p] for p in licenses.BASE)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n, {", ".join(map(places, all_phrases))} FROM words)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
    {joined(base)} AS base_labels, {joined(labels)} AS labels,
    greatest(CASE WHEN len({every}) > 0 THEN 0.5::DOUBLE ELSE 0.0 END, {", ".join(scores)}) AS score
FROM placed"""


#: Vectors without a null or non-finite component, as whole numbers.
WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def clustering_sql() -> str:
    """Plain rounds: all distances, the least, the means."""
    distance = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, v FROM ({WHOLE.format(factor=clusters.SCALE)} AND len(embedding) = {clusters.COMPONENTS}))",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {clusters.CLUSTERS}))",
    ]
    for k in range(clusters.ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT k.r, k.vec_id, k.v, c.c, {distance} AS d FROM kept k, c{k} c)")
        steps.append(f"a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < clusters.ROUNDS:
            steps.append(f"e{k} AS (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{k})")
            steps.append(f"s{k} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{k} GROUP BY c, j)")
            steps.append(f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY c)")
            steps.append(f"c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))")
    last = clusters.ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""


def negatives_sql() -> str:
    """All scores of the anchors, ranked."""
    n = negatives
    return f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {n.SHIFTED} = 0 THEN (label + 1) % {n.LABELS} ELSE label END AS label, v FROM ({WHOLE.format(factor=n.SCALE)} AND vec_id IS NOT NULL AND label IS NOT NULL)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {n.ANCHORS} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {n.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND {n.LEAST_SHARE} * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {n.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT, "op4_license_scan": licence_sql(), "op12_centroid_clustering": clustering_sql(), "op13_hard_negatives": negatives_sql()}
