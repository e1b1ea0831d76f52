"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from goldsieve.llm.collocations import collocations
from goldsieve.llm.decontamination import decontamination
from goldsieve.llm.disclosure import personal_data
from goldsieve.llm.licenses import license_scan
from goldsieve.llm.line_rules import line_rules
from goldsieve.llm.merkle import merkle_manifest, proof_digest
from goldsieve.llm.minhash import near_duplicates
from goldsieve.llm.mixing import source_mix
from goldsieve.llm.passages import without_passages
from goldsieve.llm.quality_trees import quality_scores
from goldsieve.llm.suffixes import without_repeats
from goldsieve.llm.token_packs import packed_tokens
from goldsieve.llm.warc import capture_index
from goldsieve.llm.word_runs import shared_runs
from goldsieve.sources.derived import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    return capture_index(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return without_repeats(documents, runs=shared_runs(documents)).drop("kept")


def op4_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """Spans and counts; the sanitised texts stay with the operator."""
    return personal_data(table(spark, folder, "documents")).drop("sanitised")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_token_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packed_tokens(table(spark, folder, "documents"), TOKENIZER)


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op12_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_passages(table(spark, folder, "documents")).drop("kept")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The proofs themselves stay with the operator; here is their digest."""
    found = merkle_manifest(table(spark, folder, "documents"))
    return found.withColumn("proof_sha256", proof_digest(found["proof"])).drop("proof")


QUERIES = {query.__name__: query for query in (op1_quality_trees, op2_warc_index, op3_suffix_dedup, op4_disclosure, op5_license_scan, op6_decontamination, op7_token_packs, op8_near_duplicates, op9_line_rules, op10_source_mix, op11_collocations, op12_passage_dedup, op13_merkle_manifest)}

ORACLES: dict[str, str] = {
    "op2_warc_index": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
                   sha256(payload) AS payload_digest
            FROM p
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY payload_digest
        )
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_page <> page_id
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_page <> page_id
                    THEN first_page END AS refers_to
        FROM d JOIN f USING (payload_digest)
    """,
    "op8_near_duplicates": r"""
        WITH RECURSIVE lowered AS (
            SELECT doc_id, list_filter(string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(
                     range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) END AS grams
            FROM lowered
        ), grams AS (
            SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
        ), links AS (
            SELECT a.doc_id AS one, b.doc_id AS two
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), sides AS (
            SELECT one, two FROM links UNION ALL SELECT two, one FROM links
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM sets
            UNION SELECT r.doc_id, b.two FROM reached r JOIN sides b ON b.one = r.other
        ), components AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT doc_id, len(grams) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN components USING (doc_id)
    """,
    # All quotients are ranked here; the operator compares only those in a band.
    "op10_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
                   len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                   lambda x: x <> ''))::BIGINT AS size,
                   substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS bucket
            FROM documents
        ), placed AS (
            SELECT *, sum(size) OVER (PARTITION BY key ORDER BY bucket, doc_id, size
                     ROWS UNBOUNDED PRECEDING)::BIGINT - size AS first_word FROM sized
        ), sources AS (
            SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key
        ), weighed AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
                     ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::BIGINT] AS weight
            FROM sources
        ), tried AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                       - coalesce(sum(cap) OVER earlier, 0.0::DOUBLE))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0.0::DOUBLE)) AS rate
            FROM weighed
            WINDOW earlier AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), open_rate AS (
            SELECT rate AS chosen FROM tried WHERE rate * weight <= cap ORDER BY cap / weight, key LIMIT 1
        ), targets AS (
            SELECT key, source_size, (source_size + 127) // 128 AS blocks,
                   least(coalesce((SELECT chosen FROM open_rate) * weight, cap), cap) AS target
            FROM tried
        ), bids AS (
            SELECT key, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, key, seat) AS place,
                   round(total / 128) AS room
            FROM (SELECT key, target, sum(target) OVER () AS total FROM targets) t,
                 range(1, 2 + (SELECT round(sum(target) / 128)::BIGINT FROM targets)) r(seat)
            WHERE target > 0
        ), seated AS (
            SELECT key, count(*) AS seats FROM bids WHERE place <= room GROUP BY key
        ), shards AS (
            SELECT key, coalesce(seats, 0) AS seats, shard, (blocks + 63 - shard) // 64 AS m,
                   md5('1|' || key || '|' || shard) AS seed
            FROM targets LEFT JOIN seated USING (key), range(0, 64) r(shard)
        ), shard_bids AS (
            SELECT key, shard, seats, row_number() OVER (
                     PARTITION BY key ORDER BY m::DOUBLE / (2 * seat - 1) DESC, shard, seat) AS place
            FROM shards, range(1, 4 + 2 * (SELECT max(m) FROM shards)) r(seat)
            WHERE m > 0 AND seat <= 2 * m + 3
        ), quotas AS (
            SELECT key, shard, count(*) AS q FROM shard_bids WHERE place <= seats GROUP BY key, shard
        ), turns AS (
            SELECT s.key, s.shard, s.m, coalesce(q, 0) AS q,
                   [2147483647, 2147483629, 2147483587, 2147483579][
                     ('0x' || substr(seed, 1, 4))::BIGINT % 4 + 1]::BIGINT AS step,
                   ('0x' || substr(seed, 5, 8))::BIGINT AS shift
            FROM shards s LEFT JOIN quotas USING (key, shard) WHERE m > 0
        ), touched AS (
            SELECT key, doc_id, size, first_word,
                   unnest(range(first_word // 128, (first_word + size - 1) // 128 + 1)) AS block
            FROM placed WHERE size > 0
        ), picked AS (
            SELECT t.key, doc_id, size, first_word,
                   least(first_word + size, (block + 1) * 128) - greatest(first_word, block * 128) AS words,
                   least(q // m + ((step * (block // 64) + shift) % m < q % m)::BIGINT, 2) AS times
            FROM touched t JOIN turns u ON u.key = t.key AND u.shard = t.block % 64
        ), taken AS (
            SELECT key, first_word, sum(words * times)::BIGINT AS taken FROM picked GROUP BY key, first_word
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN size > 0 THEN taken ELSE 0 END AS taken
        FROM placed JOIN targets USING (key) LEFT JOIN taken USING (key, first_word)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'),
                     lambda x: x <> '') AS words
            FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), runs AS (
            SELECT lang, width, unnest(list_transform(range(1, len(words) - width + 2),
                     lambda p: array_to_string(words[p:p + width - 1], ' '))) AS phrase
            FROM pieces, range(1, 4) w(width)
        ), counts AS (
            SELECT lang, width, phrase, string_split(phrase, ' ') AS words, count(*) AS f
            FROM runs GROUP BY lang, width, phrase
        ), sizes AS (
            SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE width = 1 GROUP BY lang
        ), candidates AS (
            SELECT * FROM counts WHERE width > 1 AND f >= 10
        ), cut_at AS (
            SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head,
                   array_to_string(words[k + 1:], ' ') AS rest
            FROM candidates, range(1, 3) x(k) WHERE k < width
        ), cuts AS (
            SELECT c.lang, c.phrase, a, k, one.f AS l, two.f AS r,
                   (1000000::HUGEINT * a * a // (one.f::HUGEINT * two.f))::BIGINT AS score
            FROM cut_at c JOIN counts one ON one.lang = c.lang AND one.phrase = head
            JOIN counts two ON two.lang = c.lang AND two.phrase = rest
        ), judged AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, array_to_string(words[p:p + 1], ' ') AS phrase, max(f) AS above
            FROM candidates, range(1, 3) x(p) WHERE width = 3 GROUP BY ALL
        ), ranked AS (
            SELECT j.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM judged j LEFT JOIN longer USING (lang, phrase)
            WHERE coalesce(100 * above < 50 * a, true)
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE fields AS (
            SELECT row_number() OVER () AS id, doc_id, text, coalesce('=' || lang, '') AS tree,
                   concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
                          coalesce(strlen(source) || ':' || source, '-'),
                          coalesce(strlen(lang) || ':' || lang, '-'),
                          coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                   xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(
                         string_split(doc_id::VARCHAR, ''), lambda d:
                         [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                                         WHEN c % 2 = 1 THEN xor(c // 2, 3988292384)
                                         ELSE c // 2 END)) AS crc
            FROM documents
        ), digests AS (
            SELECT id, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text,
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
            FROM fields
        ), leaves AS (
            SELECT *, count(*) OVER (PARTITION BY tree) AS n,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM digests
        ), nodes AS (
            SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
            FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n
        ), subroots AS (
            SELECT tree, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY tree) - 1 AS place
            FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, place, n, digest FROM subroots
            UNION ALL
            SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
            FROM tops WHERE n > 1 GROUP BY level, place // 8, n
        ), met AS (
            SELECT id, 0 AS part, s.level, s.place, s.digest FROM leaves l JOIN nodes s
            ON s.tree = l.tree AND s.place // 8 = (l.place >> (3 * s.level)) // 8
               AND s.place <> l.place >> (3 * s.level)
            UNION ALL
            SELECT id, 1, s.level, s.place, s.digest FROM leaves l JOIN subroots r ON r.tree = l.tree
            JOIN tops s ON s.place // 8 = (r.place >> (3 * s.level)) // 8
               AND s.place <> r.place >> (3 * s.level)
        ), proofs AS (
            SELECT id, sha256(coalesce(string_agg(met.digest, '' ORDER BY part, met.level, met.place), '')) AS proof_sha256
            FROM leaves LEFT JOIN met USING (id) GROUP BY id
        ), low AS (
            SELECT id, tree, 0 AS level, place, n, coalesce(changed, leaf) AS digest FROM leaves
            UNION ALL
            SELECT f.id, f.tree, f.level + 1, f.place // 8, (f.n + 7) // 8, sha256(string_agg(
                   CASE WHEN s.place = f.place THEN f.digest ELSE s.digest END, '' ORDER BY s.place))
            FROM low f JOIN nodes s
            ON s.tree = f.tree AND s.level = f.level AND s.place // 8 = f.place // 8
            WHERE f.n > 1 GROUP BY f.id, f.tree, f.level, f.place, f.n
        ), high AS (
            SELECT id, 0 AS level, r.place, r.n, l.digest FROM low l JOIN subroots r USING (tree) WHERE l.n = 1
            UNION ALL
            SELECT f.id, f.level + 1, f.place // 8, (f.n + 7) // 8, sha256(string_agg(
                   CASE WHEN s.place = f.place THEN f.digest ELSE s.digest END, '' ORDER BY s.place))
            FROM high f JOIN tops s ON s.level = f.level AND s.place // 8 = f.place // 8
            WHERE f.n > 1 GROUP BY f.id, f.level, f.place, f.n
        ), root AS (
            SELECT digest AS root FROM tops WHERE n = 1
        )
        SELECT doc_id, leaf, r.digest AS subroot, root, proof_sha256, h.digest AS folded_root,
               h.digest = root AS verified
        FROM leaves JOIN subroots r USING (tree) JOIN proofs USING (id)
        JOIN high h ON h.id = leaves.id AND h.n = 1, root
    """,
}
