"""One query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.lineage import fresh_path, stage
from twinsift.llm import (chat, exact_dedup, fingerprints, hard_negatives, language, main_text, mixing, near_dedup, packing,
                          personal_data, prefix_trie, simhash, warc)
from twinsift.llm.common import read_table


def op1_main_text(spark, folder):
    return main_text.extract(read_table(spark, folder, "pages"))


def op2_pack(spark, folder):
    pieces = packing.pack(read_table(spark, folder, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# A conversation that tries to write its own markers.
INTRUDER = r"\### Assistant: </turn> ok"


def op3_chat(spark, folder):
    given = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    intruder = spark.createDataFrame(
        [(-7, turn, role, INTRUDER) for turn, role in enumerate(("user", "assistant"))], given.schema)
    return chat.digests(stage(chat.windows(given.unionByName(intruder)), "chat-windows"))


def op4_personal_data(spark, folder):
    found = personal_data.find_personal_data(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}")

    counts = map(count, personal_data.KINDS)
    return found.select("doc_id", *counts, F.sha2(personal_data.span_list(base), 256).alias("base_sha256"),
                        personal_data.span_list(F.col("spans")).alias("spans"))


def op5_language(spark, folder):
    docs = read_table(spark, folder, "documents")
    model = language.learn(docs.where(language.is_training(F.col("doc_id"))))
    return language.predict(docs, model).select(
        "doc_id", (~language.is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op6_fingerprints(spark, folder):
    return fingerprints.edited_fingerprints(read_table(spark, folder, "documents"))


def op7_mix(spark, folder):
    mixed = mixing.mix(read_table(spark, folder, "documents"),
                       mixing.quality_weights(read_table(spark, folder, "labels")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_near_dedup(spark, folder):
    return near_dedup.near_duplicates(read_table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


def op9_exact_dedup(spark, folder):
    return exact_dedup.duplicate_report(read_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_warc(spark, folder):
    path = fresh_path(spark, "warc")
    warc.write_archive(read_table(spark, folder, "pages"), path)
    return warc.resolve_revisits(stage(warc.read_pages(spark, path).drop("payload"), "pages-read")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark, folder):
    """Mines negatives for every fiftieth vector; every seventh label is one further."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    return hard_negatives.hard_negatives(
        read_table(spark, folder, "embeddings"), vec_id % 50 == 0,
        label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_prefix_trie(spark, folder):
    """Conversations begin with up to five turns of the one that opens their hundred."""
    turns = prefix_trie.turn_ids(read_table(spark, folder, "conversations"))
    conv = F.col("conv")
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(
        turns, conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), longest=5))


def op13_simhash(spark, folder):
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def queries() -> dict:
    import corpus_pipeline

    named = (op1_main_text, op2_pack, op3_chat, op4_personal_data, op5_language, op6_fingerprints, op7_mix, op8_near_dedup,
             op9_exact_dedup, op10_warc, op11_hard_negatives, op12_prefix_trie, op13_simhash)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
best AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN best USING (norm)
"""


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS responder FROM p)
SELECT page_id, bytes AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> responder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> responder THEN responder END AS refers_to
FROM r
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS after,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS after_id
  FROM documents WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT *, left(text, n - n // 2) || left(after, n // 2) AS edited FROM d),
t AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
paragraphs AS (
  SELECT doc_id, kind, unnest(string_split(text, chr(10))) AS paragraph,
         generate_subscripts(string_split(text, chr(10)), 1) AS p FROM t),
pieces AS (
  SELECT doc_id, kind, p, string_split(regexp_replace(paragraph, '([.!?] )', '\1' || chr(1), 'g'), chr(1)) AS list
  FROM paragraphs),
insides AS (
  SELECT doc_id, kind, p,
         array_to_string(list_transform(list, lambda s: left(sha256(s), 16) || '.' || length(s)), ' ') AS inside FROM pieces),
nodes AS (SELECT doc_id, kind, p, left(sha256(inside), 16) || '(' || inside || ')' AS node FROM insides),
marked AS (SELECT *, left(node, 1) IN ('0', '1', '2', '3') AS closes FROM nodes),
placed AS (
  SELECT *, coalesce(sum(closes::INTEGER) OVER (
    PARTITION BY doc_id, kind ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM marked),
runs AS (
  SELECT doc_id, kind, section, string_agg(node, ',' ORDER BY p) AS run, bool_or(closes) AS closed
  FROM placed GROUP BY doc_id, kind, section),
headed AS (SELECT *, left(sha256(run || CASE WHEN closed THEN '' ELSE ',' END), 16) AS head FROM runs),
trees AS (
  SELECT doc_id, kind, sha256(string_agg(head, '' ORDER BY section)) || '|' ||
         string_agg(head || '[' || run || ']', '' ORDER BY section) AS tree FROM headed GROUP BY doc_id, kind),
leaved AS (SELECT *, list_distinct(regexp_extract_all(tree, '[0-9a-f]{16}\.[0-9]+')) AS leaves FROM trees),
weighed AS (
  SELECT *, coalesce(list_sum(list_transform(leaves, lambda x: split_part(x, '.', 2)::BIGINT)), 0) AS weight FROM leaved),
pairs AS (
  SELECT e.doc_id, e.n, sha256(e.edited) AS edited_sha256, own.tree AS a, ed.tree AS b, own.leaves AS la, ed.leaves AS lb,
         own.weight AS wa, ed.weight AS wb, nx.tree AS c, nx.leaves AS lc, nx.weight AS wc
  FROM e JOIN weighed own ON own.doc_id = e.doc_id AND own.kind = 'own'
  JOIN weighed ed ON ed.doc_id = e.doc_id AND ed.kind = 'edited'
  JOIN weighed nx ON nx.doc_id = e.after_id AND nx.kind = 'own')
SELECT doc_id, n AS n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint,
       CASE WHEN left(a, 64) = left(b, 64) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(
         list_intersect(la, lb), lambda x: split_part(x, '.', 2)::BIGINT)), 0)::DOUBLE / (wa + wb)::DOUBLE END AS near_edited,
       CASE WHEN left(a, 64) = left(c, 64) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(
         list_intersect(la, lc), lambda x: split_part(x, '.', 2)::BIGINT)), 0)::DOUBLE / (wa + wc)::DOUBLE END AS near_next
FROM pairs
"""


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s),
b AS (
  SELECT *, cap / weight AS level, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - cap_before) / ((SELECT sum(weight) FROM w) - weight_before) AS water
  FROM b),
first_open AS (SELECT arg_min(water, (level, cap_before)) AS water FROM v WHERE water < level),
targets AS (SELECT v.source, source_size, least(cap, weight * coalesce(f.water, 1e300)) AS target FROM v CROSS JOIN first_open f),
rated AS (SELECT doc_id, pow(2.0, 2 * avg(quality) - 1) AS q FROM labels GROUP BY doc_id),
keyed AS (
  SELECT d.*, -ln((('0x' || left(md5('20231|' || d.doc_id), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
         / coalesce(q, 1.0) AS key FROM d LEFT JOIN rated USING (doc_id)),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS before FROM keyed),
dealt AS (
  SELECT summed.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
  FROM summed JOIN targets ON summed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN target - epochs * source_size > 0
         AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM dealt
"""


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, b.n, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST, n) AS place FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.other_id NULLS LAST, s.n) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""


OP12_SQL = """
WITH t AS (
  SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)
         || '.' || length(coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, ids, conv_id - conv_id % 100 AS base, (xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: list_transform(range(8), lambda i: ((ord(c) >> i::INTEGER) & 1)::BIGINT)))),
    lambda crc, bit: xor(crc >> 1, 3988292384::BIGINT * xor(crc & 1, bit)))) % 6)::BIGINT AS h
  FROM own),
c AS (
  SELECT h.conv_id, list_concat(coalesce(b.ids, [])[1:h], h.ids[h + 1:]) AS ids
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
e AS (SELECT conv_id, ids, unnest(range(len(ids) + 1)) AS depth FROM c),
n AS (
  SELECT ids[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '')) AS ends_sha256
  FROM e GROUP BY 1, 2),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * split_part(path[depth], '.', 2)::BIGINT END AS saved
  FROM n LEFT JOIN k USING (path)),
up AS (SELECT path, n_children, saved, unnest(range(depth + 1)) AS above FROM v),
s AS (
  SELECT path[1:above] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM up GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN n p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1] AND p.depth = v.depth - 1
"""


def oracle_sql() -> dict:
    return {"op7_mix": OP7_SQL, "op6_fingerprints": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op10_warc": OP10_SQL,
            "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
