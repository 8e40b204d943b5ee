"""One query per operator over its whole table, with the columns its contract names, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairsignal.llm import centroids, chosen_path, conversations, decontaminate, exact_dedup, licenses, main_text, packing, quality, sharding, simhash, token_files, toxicity
from pairsignal.llm.common import read


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(read(spark, sf_dir, "conversations"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pack, op2_decontaminate, op3_exact_dedup, op4_toxicity, op5_licenses, op6_shards, op7_token_files, op8_main_text, op9_quality, op10_near_duplicates,
        op11_centroids, op12_conversations, op13_near_duplicates,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _rounds(rounds: int = 3) -> str:
    """The rounds of the centroid clustering, one after the other, on one row per component."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
            SELECT row_id, min({{'distance': distance, 'cluster': cluster}}) AS best
            FROM (SELECT row_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM parts JOIN c{r} USING (dim) GROUP BY row_id, cluster) GROUP BY row_id
        )""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT cluster, dim, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
            FROM c{r} LEFT JOIN (SELECT best.cluster AS cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{r} JOIN parts USING (row_id) GROUP BY ALL) USING (cluster, dim)
        )""")
    return ",\n        ".join(parts)


ORACLE: dict[str, str] = {
    "op12_conversations": r"""
        WITH RECURSIVE tab AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, i) AS c
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
        ),
        named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes
            FROM conversations
        ),
        fated AS (
            SELECT named.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS fate
            FROM named CROSS JOIN tab
        ),
        damaged AS (
            SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM fated WHERE fate <> 0
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
        judged AS MATERIALIZED (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                   left(role, 1) || left(lead(role) OVER (PARTITION BY conv ORDER BY pos), 1) AS pair
            FROM placed
        ),
        inserts AS (SELECT * FROM (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
            (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])) v(q, q2, chars, made)),
        steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(q, initial, q2)),
        ways AS (
            SELECT DISTINCT conv, CAST(0 AS BIGINT) AS pos, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'made': CAST([] AS VARCHAR[])} AS best FROM judged
            UNION ALL
            SELECT conv, pos, q, min(best) AS best FROM (
                SELECT o.conv, r.pos, o.q2 AS q, {'cost': o.cost + 2, 'audit': o.audit || 'D', 'made': o.made} AS best FROM opened o JOIN judged r ON r.conv = o.conv AND r.pos = o.pos + 1
                UNION ALL
                SELECT o.conv, r.pos, s.q2, {'cost': o.cost + CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'audit': o.audit || 'K', 'made': list_append(o.made, r.role || ':' || r.text)}
                FROM opened o JOIN judged r ON r.conv = o.conv AND r.pos = o.pos + 1 AND r.fault IN ('', 'truncated') JOIN steps s ON s.q = o.q2 AND s.initial = left(r.role, 1)
                UNION ALL
                SELECT o.conv, r.pos, s.q2, {'cost': o.cost + 1 + CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'audit': o.audit || 'R',
                       'made': list_append(o.made, CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text)}
                FROM opened o JOIN judged r ON r.conv = o.conv AND r.pos = o.pos + 1 AND r.fault IN ('', 'truncated') JOIN steps s ON s.q = o.q2 AND s.initial <> 's'
            ) GROUP BY conv, pos, q
        ),
        finished AS (
            SELECT w.conv, min({'cost': w.best.cost + 5 * len(i.chars), 'audit': w.best.audit || i.chars, 'made': list_concat(w.best.made, i.made)}) AS best
            FROM ways w JOIN inserts i ON i.q = w.q JOIN (SELECT conv, max(pos) AS n FROM judged GROUP BY conv) e ON e.conv = w.conv AND e.n = w.pos
            WHERE i.q2 IN (0, 3) GROUP BY w.conv
        ),
        counted AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv
        )
        SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
               coalesce(c.illegal, 0) AS illegal, coalesce(f.best.cost, 0) AS cost, coalesce(f.best.audit, '') AS audit, sha256(coalesce(array_to_string(f.best.made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) e LEFT JOIN counted c USING (conv) LEFT JOIN finished f USING (conv)
    """.replace("opened o", """(SELECT w.conv, w.pos, i.q2, w.best.cost + 5 * len(i.chars) AS cost, w.best.audit || i.chars AS audit, list_concat(w.best.made, i.made) AS made
                    FROM ways w JOIN inserts i ON i.q = w.q) o"""),
    "op13_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
            FROM w WHERE len(w) > 0
        ),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        linked AS MATERIALIZED (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
        ),
        edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
        reach AS (SELECT DISTINCT a AS doc_id, a AS node FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node),
        least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
    "op11_centroids": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ),
        parts AS MATERIALIZED (SELECT row_id, unnest(range(1, 65)) AS dim, unnest(v) AS x FROM kept),
        first AS (SELECT row_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster FROM kept),
        c0 AS MATERIALIZED (SELECT CAST(cluster AS INTEGER) AS cluster, dim, x AS c FROM first JOIN parts USING (row_id) WHERE cluster < 16),
        {_rounds()},
        names AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY cluster)
        SELECT vec_id, best.cluster AS cluster, best.distance AS distance, CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near3 JOIN kept USING (row_id) JOIN names ON names.cluster = near3.best.cluster
    """,
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS MATERIALIZED (
            SELECT DISTINCT item_id, list_slice(w, p, p + 12) AS x
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
        ),
        lens AS (SELECT DISTINCT len(x) AS l FROM win),
        places AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, lens WHERE len(w) >= l),
        hits AS MATERIALIZED (
            SELECT places.doc_id, places.p, places.l, win.item_id
            FROM places JOIN win ON list_slice(places.w, places.p, places.p + places.l - 1) = win.x
        ),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
