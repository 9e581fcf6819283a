"""SQL counterparts of the queries, for DuckDB over the same tables."""

from __future__ import annotations

# ---- common table expressions -----------------------------------------------------------

TFIDF = r"""
questions AS (
  SELECT doc_id AS question_id, text AS question_text, source AS survey_name, lang AS directorate
  FROM documents),
words AS (
  SELECT question_id, unnest(string_split_regex(lower(question_text), '\s+')) AS token FROM questions),
counts AS (
  SELECT question_id, token, count(*) AS tf FROM words WHERE token <> '' GROUP BY question_id, token),
vocab AS (SELECT token, count(*) AS df FROM counts GROUP BY token),
total AS (SELECT count(DISTINCT question_id) AS n FROM counts),
raw AS (
  SELECT question_id, token, tf * ln((n + 1.0) / (df + 1)) AS v
  FROM counts JOIN vocab USING (token) CROSS JOIN total),
units AS (
  SELECT question_id, token, v / sqrt(sum(v * v) OVER (PARTITION BY question_id)) AS u
  FROM raw WHERE v > 0)"""

TEXT_PAIRS = TFIDF + """,
pairs AS (
  SELECT a.question_id AS id1, b.question_id AS id2, sum(a.u * b.u) AS similarity
  FROM units a JOIN units b ON a.token = b.token AND a.question_id < b.question_id
  GROUP BY 1, 2 HAVING sum(a.u * b.u) >= 0.78)"""

DETAILED_PAIRS = TEXT_PAIRS + """,
detailed AS (
  SELECT id1, id2, a.question_text AS question1, b.question_text AS question2,
         a.survey_name AS survey1, b.survey_name AS survey2, similarity
  FROM pairs JOIN questions a ON a.question_id = id1 JOIN questions b ON b.question_id = id2)"""

COMPONENTS = """,
edges AS (SELECT id1 AS a, id2 AS b FROM pairs UNION ALL SELECT id2, id1 FROM pairs),
reach(id, root) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.id),
members AS (SELECT min(root) AS cluster_id, id FROM reach GROUP BY id),
sizes AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY cluster_id)"""


GAPPY = r"""
gappy AS (
  SELECT doc_id AS question_id, text AS question_text, source AS survey_name, lang AS directorate FROM documents
  UNION ALL
  SELECT -1 - doc_id, CASE WHEN doc_id % 21 = 0 THEN NULL WHEN doc_id % 21 = 7 THEN '' ELSE ' ' || chr(9) || chr(10) END,
         source, lang FROM documents WHERE doc_id % 7 = 0)"""

# The two rows of a text pair see each other; a row is its own first neighbour.
TEXT_NEIGHBORS = """,
sided AS (
  SELECT id1 AS id, id2 AS neighbor_id, similarity FROM pairs
  UNION ALL SELECT id2, id1, similarity FROM pairs
  UNION ALL SELECT id, id, 1.0 FROM (SELECT id1 AS id FROM pairs UNION SELECT id2 FROM pairs)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(1 - least(similarity, 1), 12), neighbor_id) AS rank FROM sided),
nearest AS (SELECT * FROM ranked WHERE rank <= 3)"""


def _vector_pairs(threshold: float) -> str:
    return f"""
pairs AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {threshold})"""


VECTOR_PAIRS = _vector_pairs(0.40)
LABELLED = _vector_pairs(0.30) + """,
labelled AS (
  SELECT id1, id2, similarity, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS y
  FROM pairs JOIN embeddings a ON a.vec_id = id1 JOIN embeddings b ON b.vec_id = id2)"""

FEEDBACK = """,
feedback AS (
  SELECT id1, id2, similarity,
    CASE WHEN a.quality = b.quality AND a.toxic = b.toxic THEN 'duplicate'
         WHEN a.quality = b.quality THEN 'near-duplicate/harmonizable'
         WHEN a.quality > b.quality THEN 'different' ELSE 'needs-review' END AS label,
    'quality ' || a.quality || '/' || b.quality AS note,
    '2025-11-30T09:00:00.000000' AS "timestamp"
  FROM pairs JOIN labels a ON a.doc_id = id1 JOIN labels b ON b.doc_id = id2)"""

NOTES = """,
notes AS (
  SELECT cluster_id, 'group ' || cluster_id AS cluster_name,
         CASE WHEN size >= 3 THEN question_text ELSE 'gone' END AS canonical_question
  FROM (SELECT cluster_id, max(id) AS id, count(*) AS size FROM members GROUP BY cluster_id)
  JOIN questions ON question_id = id)"""


def _odd(column: str, by: str) -> str:
    return rf"""CASE {by} % 3 WHEN 0 THEN '' WHEN 1 THEN {column} || chr(0) || '\n' || chr(13) || chr(10) || '\' ELSE {column} END"""


def _neighbors(k: int) -> str:
    return f"""
near AS (
  SELECT a.vec_id AS id, b.vec_id AS neighbor_id,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
  FROM embeddings a CROSS JOIN embeddings b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(1 - similarity, 12), neighbor_id) AS rank FROM near),
nearest AS (SELECT * FROM ranked WHERE rank <= {k})"""


SPLIT = LABELLED + """,
numbered AS (
  SELECT *, row_number() OVER (ORDER BY id1, id2) - 1 AS position, count(*) OVER () AS n FROM labelled),
split AS (
  SELECT id1, id2, y, similarity AS score,
         CASE WHEN position < floor(n * 0.9) THEN 'train' ELSE 'validation' END AS split FROM numbered)"""


def _sweep(source: str) -> str:
    return f"""
grid AS (SELECT round(0.30 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(21) t(i)),
sweep AS (
  SELECT threshold, avg(CASE WHEN (score >= threshold) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM {source} CROSS JOIN grid GROUP BY threshold),
best AS (SELECT threshold AS best_threshold, accuracy AS best_accuracy
         FROM sweep ORDER BY accuracy DESC, threshold LIMIT 1)"""


SCORED = LABELLED + ", scored AS (SELECT id1, id2, y, similarity AS score FROM labelled)"

def _listed_parts(rows: int) -> str:
    return f"""
SELECT cluster_id, part, any_value(size) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members
FROM (SELECT cluster_id, id, (row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1) // {rows} AS part FROM members)
JOIN sizes USING (cluster_id) GROUP BY cluster_id, part"""


LISTS = """
SELECT cluster_id, 0::BIGINT AS part, any_value(size) AS size, string_agg(id::VARCHAR, ',' ORDER BY id) AS members
FROM members JOIN sizes USING (cluster_id) GROUP BY cluster_id"""

REPORT = """
        per_class AS (
          SELECT c AS class, count(*) FILTER (WHERE y = c AND p = c) AS hits,
                 count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE p = c) AS claimed
          FROM predicted CROSS JOIN (SELECT DISTINCT unnest([y, p]) AS c FROM predicted) GROUP BY c),
        ratios AS (
          SELECT class, hits, support, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS precision,
                 CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM per_class),
        scored_classes AS (
          SELECT *, CASE WHEN precision + recall = 0 THEN 0
                         ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ratios)
        SELECT class::VARCHAR AS class, round(precision, 8) AS precision, round(recall, 8) AS recall,
               round(f1, 8) AS f1, support FROM scored_classes
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 8), round(sum(hits) / sum(support), 8),
               round(sum(hits) / sum(support), 8), sum(support)::BIGINT FROM scored_classes
        UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8),
               sum(support)::BIGINT FROM scored_classes
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8),
               round(sum(recall * support) / sum(support), 8), round(sum(f1 * support) / sum(support), 8),
               sum(support)::BIGINT FROM scored_classes"""

# The stratified split by a hash both engines have, and logistic regression by accelerated
# gradient steps: the penalty is |w|^2 / 2 without the intercept, the last weight.
CLASSIFIED = LABELLED + """,
ordered AS (
  SELECT id1, id2, y, row_number() OVER (PARTITION BY y ORDER BY sha256('42|' || id1 || '|' || id2), id1, id2) - 1 AS position,
         count(*) OVER (PARTITION BY y) AS n FROM labelled),
sides AS (
  SELECT id1, id2, y, position < round(n * 0.2) AS test, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb
  FROM ordered JOIN embeddings a ON a.vec_id = id1 JOIN embeddings b ON b.vec_id = id2),
featured AS (
  SELECT id1, id2, y, test, list_concat(list_concat(
           list_transform(list_zip(va, vb), lambda p: abs(p[1] - p[2])),
           list_transform(list_zip(va, vb), lambda p: p[1] * p[2])), [1.0::DOUBLE]) AS x FROM sides),
train AS (SELECT row_number() OVER (ORDER BY id1, id2) AS i, y, x FROM featured WHERE NOT test),
entries AS (SELECT i, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM train),
by_column AS MATERIALIZED (
  SELECT list(col ORDER BY j) AS cols FROM (SELECT j, list(v ORDER BY i) AS col FROM entries GROUP BY j)),
by_row AS MATERIALIZED (
  SELECT list(x ORDER BY i) AS rows, list(y::DOUBLE ORDER BY i) AS ys,
         0.25 * sum(list_dot_product(x, x)) + 1 AS steepest FROM train),
fit(k, w, ahead) AS (
  SELECT 0, list_transform(cols, lambda c: 0.0::DOUBLE), list_transform(cols, lambda c: 0.0::DOUBLE) FROM by_column
  UNION ALL
  SELECT k + 1, next, list_transform(list_zip(next, w), lambda p: p[1] + 0.95 * (p[1] - p[2]))
  FROM (
    SELECT k, w, list_transform(list_zip(ahead, gradient), lambda p: p[1] - p[2] / steepest) AS next
    FROM (
      SELECT k, w, ahead, steepest, list_transform(list_zip(cols, ahead, range(1, len(ahead) + 1)), lambda c:
               list_dot_product(c[1], residuals) + CASE WHEN c[3] < len(ahead) THEN c[2] ELSE 0 END) AS gradient
      FROM (
        SELECT k, w, ahead, steepest, list_transform(list_zip(rows, ys), lambda r:
                 1 / (1 + exp(-list_dot_product(r[1], ahead))) - r[2]) AS residuals
        FROM fit CROSS JOIN by_row WHERE k < 1200)
      CROSS JOIN by_column))),
classified AS (
  SELECT id1, id2, y, 1 / (1 + exp(-list_dot_product(x, w))) AS score
  FROM featured CROSS JOIN (SELECT w FROM fit WHERE k = 1200) WHERE test)"""

# ---- queries ----------------------------------------------------------------------------

ORACLES = {
    "text_cluster_lists": f"WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS} {LISTS}",
    "text_cluster_members": f"WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS} SELECT cluster_id, id FROM members",
    "text_pairs": f"""WITH {DETAILED_PAIRS}
        SELECT id1, id2, question1, question2, survey1, survey2, round(similarity, 4) AS similarity FROM detailed""",
    "positioned_pairs": f"""WITH {TEXT_PAIRS},
        places AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS idx FROM questions)
        SELECT a.idx AS idx1, b.idx AS idx2, id1, id2, round(similarity, 4) AS similarity
        FROM pairs JOIN places a ON a.question_id = id1 JOIN places b ON b.question_id = id2""",
    "pairs_in_length_order": f"""WITH {DETAILED_PAIRS},
        flagged AS (SELECT *, (length(question1), id1) <= (length(question2), id2) AS first FROM detailed)
        SELECT CASE WHEN first THEN id1 ELSE id2 END AS id1, CASE WHEN first THEN id2 ELSE id1 END AS id2,
               round(similarity, 4) AS similarity FROM flagged""",
    "tfidf": f"WITH {TFIDF} SELECT question_id, token, round(u, 6) AS u FROM units",
    "vector_pairs": f"WITH {VECTOR_PAIRS} SELECT id1, id2, round(similarity, 4) AS similarity FROM pairs",
    "knn": f"""WITH {_neighbors(10)}
        SELECT id AS question_id, rank::INTEGER AS rank, neighbor_id, round(similarity, 4) AS similarity,
               round(1 - similarity, 4) AS distance FROM nearest""",
    "knn_pairs": f"""WITH {_neighbors(3)}
        SELECT id AS id1, neighbor_id AS id2, round(similarity, 4) AS similarity
        FROM nearest WHERE id < neighbor_id AND similarity >= 0.30""",
    "knn_pairs_symmetric": f"""WITH {_neighbors(3)}
        SELECT least(id, neighbor_id) AS id1, greatest(id, neighbor_id) AS id2,
               round(max(similarity), 4) AS similarity
        FROM nearest WHERE id <> neighbor_id AND similarity >= 0.30 GROUP BY 1, 2""",
    "vector_cluster_members": f"WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS} SELECT cluster_id, id FROM members",
    "pair_list_clusters": f"WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS} SELECT cluster_id, id FROM members",
    "cluster_sizes": f"WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS} SELECT cluster_id, size FROM sizes",
    "cluster_summary": f"""WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS}
        SELECT count(*) AS clusters, sum(size)::BIGINT AS members, max(size) AS largest FROM sizes""",
    "vector_cluster_lists": f"WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS} {LISTS}",
    "dbscan": f"""WITH RECURSIVE {_vector_pairs(0.40)},
        both_ways AS (SELECT id1 AS a, id2 AS b FROM pairs UNION ALL SELECT id2, id1 FROM pairs),
        cores AS (SELECT a AS id FROM both_ways GROUP BY a HAVING count(*) + 1 >= 3),
        core_edges AS (SELECT a, b FROM both_ways WHERE a IN (FROM cores) AND b IN (FROM cores)),
        reach(id, root) AS (
          SELECT id, id FROM cores
          UNION
          SELECT core_edges.b, reach.root FROM reach JOIN core_edges ON core_edges.a = reach.id),
        roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
        numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
        borders AS (
          SELECT a AS id, min(label) AS label FROM both_ways JOIN numbered ON numbered.id = b
          WHERE a NOT IN (FROM cores) GROUP BY a)
        SELECT vec_id AS question_id, coalesce(numbered.label, borders.label, -1)::BIGINT AS label,
               CASE WHEN numbered.label IS NOT NULL THEN 'core'
                    WHEN borders.label IS NOT NULL THEN 'border' ELSE 'noise' END AS role
        FROM embeddings LEFT JOIN numbered ON numbered.id = vec_id LEFT JOIN borders ON borders.id = vec_id""",
    "preview": """SELECT doc_id AS question_id, text AS question_text, source AS survey_name, lang AS directorate
        FROM documents ORDER BY doc_id LIMIT 5""",
    "clean_text": rf"WITH {GAPPY} SELECT * FROM gappy WHERE regexp_matches(question_text, '\S')",
    "blank_count": rf"""WITH {GAPPY} SELECT count(*) AS rows,
               count(*) FILTER (WHERE NOT coalesce(regexp_matches(question_text, '\S'), false)) AS blank FROM gappy""",
    "repeated_ids": """SELECT conv_id AS question_id, count(*) AS rows FROM conversations
        GROUP BY conv_id HAVING count(*) > 1""",
    "default_columns": """SELECT doc_id AS question_id, text AS question_text, '' AS survey_name, '' AS directorate
        FROM documents""",
    "pair_count": f"WITH {TEXT_PAIRS} SELECT count(*) AS pairs FROM pairs",
    "pair_review": f"""WITH {TEXT_PAIRS}{FEEDBACK}
        SELECT id1, id2, round(pairs.similarity, 4) AS similarity, coalesce(label, 'unlabeled') AS label,
               coalesce(note, '') AS note FROM pairs LEFT JOIN feedback USING (id1, id2)""",
    "latest_feedback": f"""WITH {TEXT_PAIRS}{FEEDBACK}
        SELECT id1, id2, round(similarity, 4) AS similarity,
               CASE WHEN label = 'needs-review' THEN label ELSE 'different' END AS label, note,
               CASE WHEN label = 'needs-review' THEN "timestamp" ELSE '2025-12-01T11:26:13.126563' END AS "timestamp"
        FROM feedback""",
    "invalid_labels": f"""WITH {TEXT_PAIRS}{FEEDBACK}
        SELECT note AS label, count(*) AS rows FROM feedback WHERE label = 'duplicate' GROUP BY note""",
    "feedback_upsert": f"""WITH {DETAILED_PAIRS}{FEEDBACK},
        submitted AS (SELECT id1, id2, similarity FROM detailed WHERE lower(trim(survey1)) <> lower(trim(survey2)))
        SELECT id1, id2, round(similarity, 4) AS similarity, label, note, "timestamp"
        FROM feedback WHERE (id1, id2) NOT IN (SELECT (id1, id2) FROM submitted)
        UNION ALL
        SELECT id1, id2, round(similarity, 4), 'different', '', '2025-12-01T11:26:13.126563' FROM submitted""",
    "first_pairs": f"""WITH {_vector_pairs(0.30)}
        SELECT id1, id2, round(similarity, 4) AS similarity FROM pairs ORDER BY id1, id2 LIMIT 200""",
    "top_pairs": f"""WITH {_vector_pairs(0.30)}
        SELECT id1, id2, round(similarity, 4) AS similarity FROM
        (SELECT * FROM pairs ORDER BY similarity DESC, id1, id2 LIMIT 200)""",
    "page_count": f"""WITH {_vector_pairs(0.30)}
        SELECT count(*) AS pairs, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages FROM pairs""",
    "pair_page": f"""WITH {_vector_pairs(0.30)},
        numbered AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id1, id2) - 1 AS position FROM pairs)
        SELECT position, id1, id2, round(similarity, 4) AS similarity FROM numbered
        WHERE position >= 100 AND position < 150""",
    "cluster_detail": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}
        SELECT cluster_id, questions.* FROM members JOIN questions ON question_id = id""",
    "canonical_question": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}
        SELECT cluster_id, question_text AS canonical_question
        FROM (SELECT DISTINCT cluster_id FROM members) JOIN questions ON question_id = cluster_id""",
    "annotated_clusters": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}{NOTES}
        SELECT cluster_id, size, coalesce(cluster_name, '') AS cluster_name,
               CASE WHEN canonical_question IN (
                      SELECT question_text FROM members m JOIN questions q ON q.question_id = m.id
                      WHERE m.cluster_id = sizes.cluster_id)
                    THEN canonical_question ELSE first.question_text END AS canonical_question
        FROM sizes LEFT JOIN notes USING (cluster_id) JOIN questions first ON first.question_id = cluster_id""",
    "chosen_clusters": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}
        SELECT cluster_id, id FROM members WHERE cluster_id IN (SELECT cluster_id FROM sizes WHERE size >= 3)""",
    "training_pairs": f"""WITH {TEXT_PAIRS}{FEEDBACK.replace('feedback AS', 'decided AS')}, {GAPPY},
        feedback AS (
          SELECT id1, id2, label FROM decided
          UNION ALL SELECT -1 - doc_id, doc_id, 'duplicate' FROM documents WHERE doc_id % 7 = 0)
        SELECT id1, id2, a.question_text AS text1, b.question_text AS text2,
               CASE WHEN label = 'different' THEN 0.0 ELSE 1.0 END::DOUBLE AS label
        FROM feedback JOIN gappy a ON a.question_id = id1 JOIN gappy b ON b.question_id = id2
        WHERE label <> 'needs-review' AND length(a.question_text) > 0 AND length(b.question_text) > 0""",
    "pair_features": f"""WITH {LABELLED},
        sides AS (
          SELECT id1, id2, y, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb
          FROM labelled JOIN embeddings a ON a.vec_id = id1 JOIN embeddings b ON b.vec_id = id2),
        entries AS (SELECT id1, id2, y, len(va) AS d, unnest(range(1, len(va) + 1)) AS i, va, vb FROM sides)
        SELECT id1, id2, y, (i - 1)::INTEGER AS dim, round(abs(va[i] - vb[i]), 6) AS "value" FROM entries
        UNION ALL
        SELECT id1, id2, y, (d + i - 1)::INTEGER, round(va[i] * vb[i], 6) FROM entries""",
    "split_sequential": f"WITH {SPLIT} SELECT id1, id2, split FROM split",
    "split_counts": f"WITH {SPLIT} SELECT split, count(*) AS rows FROM split GROUP BY split",
    "split_stratified": f"""WITH {LABELLED},
        ordered AS (
          SELECT id1, id2, y, row_number() OVER (
                   PARTITION BY y ORDER BY sha256('42|' || id1 || '|' || id2), id1, id2) - 1 AS position,
                 count(*) OVER (PARTITION BY y) AS n FROM labelled)
        SELECT id1, id2, y, CASE WHEN position < round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM ordered""",
    "pair_scores": f"WITH {SCORED} SELECT id1, id2, y, round(score, 4) AS score FROM scored",
    "threshold_sweep": f"""WITH {SCORED}, {_sweep('scored')}
        SELECT threshold, round(accuracy, 8) AS accuracy FROM sweep""",
    "best_threshold": f"""WITH {SCORED}, {_sweep('scored')}
        SELECT best_threshold, round(best_accuracy, 8) AS best_accuracy FROM best""",
    "threshold_report": f"""WITH {SPLIT},
        validation AS (SELECT * FROM split WHERE split = 'validation'), {_sweep('validation')}
        SELECT (SELECT count(*) FROM split WHERE split = 'train') AS num_training_samples,
               (SELECT count(*) FROM split WHERE split = 'validation') AS num_validation_samples,
               best_threshold, round(best_accuracy, 8) AS best_accuracy FROM best""",
    "classification_report": f"""WITH {SCORED},
        predicted AS (SELECT y, CASE WHEN score >= 0.40 THEN 1 ELSE 0 END AS p FROM scored),{REPORT}""",
    "classifier": f"""WITH RECURSIVE {CLASSIFIED}
        SELECT id1, id2, y, (score > 0.5)::INTEGER AS prediction, round(score, 3) AS score FROM classified""",
    "classifier_report": f"""WITH RECURSIVE {CLASSIFIED},
        predicted AS (SELECT y, (score > 0.5)::INTEGER AS p FROM classified),{REPORT}""",
    "roc_auc": f"""WITH {SCORED},
        ranks AS (
          SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
        sums AS (SELECT sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives,
                        sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rank_sum FROM ranks)
        SELECT positives, negatives, round((rank_sum - positives * (positives + 1) / 2.0)
               / (positives::DOUBLE * negatives), 8) AS auc FROM sums""",
    "heatmap_grid": """WITH placed AS (
          SELECT vec_id, embedding::DOUBLE[] AS v,
                 floor((row_number() OVER (ORDER BY vec_id) - 1) * 10 / (count(*) OVER ()))::INTEGER AS bin
          FROM embeddings)
        SELECT a.bin AS row_bin, b.bin AS col_bin, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS avg_similarity,
               count(*) AS cells FROM placed a CROSS JOIN placed b GROUP BY 1, 2""",
    "cross_source_pairs": f"""WITH {DETAILED_PAIRS}
        SELECT id1, id2, survey1, survey2, round(similarity, 4) AS similarity FROM detailed
        WHERE lower(trim(survey1)) <> lower(trim(survey2))""",
    "source_redundancy": f"""WITH {DETAILED_PAIRS}
        SELECT least(lower(trim(survey1)), lower(trim(survey2))) AS survey_a,
               greatest(lower(trim(survey1)), lower(trim(survey2))) AS survey_b, count(*) AS pairs,
               round(avg(similarity), 4) AS avg_similarity, round(max(similarity), 4) AS max_similarity
        FROM detailed GROUP BY 1, 2""",
    "group_redundancy": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}
        SELECT directorate, count(*) AS questions, count(id) AS clustered, round(count(id) / count(*), 8) AS share
        FROM questions LEFT JOIN members ON id = question_id GROUP BY directorate""",
    "csv_questions": """SELECT doc_id AS question_id, text AS question_text, source AS survey_name,
        lang AS directorate FROM documents""",
    "csv_any_format": """SELECT doc_id AS question_id, text AS question_text, source AS survey_name,
        lang AS directorate FROM documents""",
    "pairs_csv": f"""WITH {TEXT_PAIRS},
        places AS (SELECT question_id, (row_number() OVER (ORDER BY question_id) - 1)::INTEGER AS idx FROM questions)
        SELECT a.idx AS idx1, b.idx AS idx2, id1, id2, round(similarity, 4) AS similarity
        FROM pairs JOIN places a ON a.question_id = id1 JOIN places b ON b.question_id = id2""",
    "feedback_roundtrip": f"""WITH {TEXT_PAIRS}{FEEDBACK}
        SELECT id1, id2, round(similarity, 4) AS similarity, label, {_odd('note', 'id1')} AS note, '2025-11-30 09:00:00' AS "timestamp"
        FROM feedback WHERE label <> 'needs-review'""",
    "notes_roundtrip": f"""WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS}{NOTES}
        SELECT cluster_id, {_odd('cluster_name', 'cluster_id')} AS cluster_name, canonical_question FROM notes""",
    "vectors_roundtrip": """WITH entries AS (
          SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
        SELECT vec_id AS question_id, (i - 1)::INTEGER AS dim, round(v[i], 6) AS "value" FROM entries""",
    "text_knn_pairs": f"""WITH {TEXT_PAIRS}{TEXT_NEIGHBORS}
        SELECT id AS id1, neighbor_id AS id2, round(least(similarity, 1), 4) AS similarity
        FROM nearest WHERE id < neighbor_id""",
    "text_knn_pairs_symmetric": f"""WITH {TEXT_PAIRS}{TEXT_NEIGHBORS}
        SELECT least(id, neighbor_id) AS id1, greatest(id, neighbor_id) AS id2, round(least(max(similarity), 1), 4) AS similarity
        FROM nearest WHERE id <> neighbor_id GROUP BY 1, 2""",
    "batch_run": f"""WITH RECURSIVE {TEXT_PAIRS.replace('pairs AS', 'all_pairs AS')},
        pairs AS (SELECT * FROM all_pairs){TEXT_NEIGHBORS},
        one_sided AS (SELECT id AS id1, neighbor_id AS id2, least(similarity, 1) AS similarity
                      FROM nearest WHERE id < neighbor_id){COMPONENTS.replace('FROM pairs', 'FROM one_sided')}
        SELECT 'pair' AS kind, id1, id2, round(similarity, 4) AS similarity FROM one_sided
        UNION ALL SELECT 'member', cluster_id, id, NULL FROM members""",
    "encoded": rf"""WITH {GAPPY}, letters AS (SELECT unnest(['a', 'b', 'c', 'd']) AS letter, unnest([0, 1, 2, 3]) AS dim)
        SELECT question_id, dim::INTEGER AS dim,
               (length(question_text) - length(replace(question_text, letter, '')))::DOUBLE AS "value"
        FROM gappy CROSS JOIN letters WHERE regexp_matches(question_text, '\S')""",
    "clusters_json": f"WITH RECURSIVE {VECTOR_PAIRS}{COMPONENTS} {LISTS}",
}
NEAR_COPIES = """
  FROM documents
  UNION ALL
  SELECT -1 - d.doc_id, f.text || ' number' || (d.doc_id % 40), d.source, d.lang
  FROM documents d JOIN documents f ON f.doc_id = d.doc_id - d.doc_id % 40),
words"""
ORACLES |= {
    "text_knn_near_copies": "WITH " + (TEXT_PAIRS + TEXT_NEIGHBORS).replace("\n  FROM documents),\nwords", NEAR_COPIES).replace(
        "rank <= 3", "rank <= 5") + """
        SELECT id AS question_id, rank::INTEGER AS rank, neighbor_id, round(least(similarity, 1), 4) AS similarity FROM nearest""",
    "tfidf_dealt": ORACLES["tfidf"],
    "text_pairs_dealt": f"WITH {TEXT_PAIRS} SELECT id1, id2, round(similarity, 4) AS similarity FROM pairs",
    "text_cluster_lists_dealt": f"WITH RECURSIVE {TEXT_PAIRS}{COMPONENTS} {_listed_parts(3)}",
    "vector_pairs_blocks": ORACLES["vector_pairs"],
    "knn_blocks": ORACLES["knn"],
    "dbscan_blocks": ORACLES["dbscan"],
}
