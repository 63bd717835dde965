"""Relational operators of the engine, one query each, over the model tables."""

from __future__ import annotations

from ..functions import titles

B = "CAST({} AS BIGINT)"
FOLD = "'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'"

QUERIES: dict[str, str | tuple[str, str]] = {
    # Sources and knowledge base.
    "S1_scan_documents": "SELECT doc_id, replace(text, chr(65533), '''') AS text FROM documents",
    "S13_stop_words": "SELECT t.surface AS token, count(*) AS n FROM token_surfaces t LEFT ANTI JOIN (SELECT token FROM vocab CROSS JOIN n_docs WHERE df * 2 > n_docs.n) s ON t.surface = s.token WHERE t.surface <> '' GROUP BY t.surface",
    "K1_valid_titles": "SELECT DISTINCT title FROM anchors WHERE length(title) > 1 AND NOT title LIKE 'List of %' AND NOT title LIKE 'Category:%' AND NOT title LIKE '%(disambiguation)' AND NOT title LIKE 'Talk:%'",
    "K2_title_cleanup": "SELECT DISTINCT title, replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), ' ', '_') AS clean FROM anchors",
    "K3_redirect_heads": "WITH RECURSIVE hop(src, dst, depth) AS (SELECT src, dst, 1 FROM redirects UNION ALL SELECT h.src, r.dst, h.depth + 1 FROM hop h JOIN redirects r ON h.dst = r.src WHERE h.depth < 50) SELECT src, max_by(dst, depth) AS head, CAST(max(depth) AS BIGINT) AS hops FROM hop GROUP BY src",
    "K8_ambiguous_targets": "SELECT surface, count(*) AS n_targets, min(title) AS first_title, max(title) AS last_title FROM pair_counts GROUP BY surface HAVING count(*) > 1",
    "K9_relation_index": "SELECT l.src AS from_id, 'WIKI_LINK_RELATION' AS pred, l.dst AS to_id, p.p_name AS from_name, q.p_name AS to_name FROM links l JOIN part p ON p.p_partkey = l.src JOIN part q ON q.p_partkey = l.dst",
    "K10_infobox_relations": "SELECT t.arg1, t.pred, t.arg2, p.p_name AS name1, s.s_name AS name2 FROM triples t JOIN part p ON p.p_partkey = t.arg1 JOIN supplier s ON s.s_suppkey = t.arg2",
    "K11_pairwise_similarity": "SELECT a, b, round(in_pmi, 6) AS in_pmi, round(out_pmi, 6) AS out_pmi, round(in_ngd, 6) + 0e0 AS in_ngd, round(out_ngd, 6) + 0e0 AS out_ngd, two_way FROM pairwise_sim",
    "K13_pair_keys": "SELECT concat_ws('_', CAST(least(src, dst) AS STRING), CAST(greatest(src, dst) AS STRING)) AS pair, count(*) AS n FROM links GROUP BY 1",
    "K16_surface_statistics": "SELECT surface, title, n, round(p_title, 9) AS p_title, round(p_surface, 9) AS p_surface, rank FROM surface_candidates",
    # Lookups.
    "L1_candidates": "SELECT doc_id, pos, title, rank, round(p_title, 9) AS p_title, round(p_surface, 9) AS p_surface FROM candidates",
    "L1_good_turing": "SELECT surface, round(CASE WHEN linked_count > 5 THEN CAST(singletons AS DOUBLE) / linked_count ELSE 0.0 END, 9) AS mass, round(ln(CAST(total_count AS DOUBLE)) - ln(2478573.0), 6) + 0e0 AS log_appear FROM surface_forms",
    "L1_link_documents": "SELECT d.lang, count(*) AS n_mentions, count(x.link) AS n_links, CAST(sum(CASE WHEN x.link = x.tok THEN 1 ELSE 0 END) AS BIGINT) AS n_correct FROM decided x JOIN documents d ON d.doc_id = x.doc_id GROUP BY d.lang",
    "L4_title_ids": "SELECT a.title, coalesce(t.id, -1) AS title_id FROM (SELECT DISTINCT title FROM anchors) a LEFT JOIN (SELECT title, CAST(row_number() OVER (ORDER BY title) AS BIGINT) - 1 AS id FROM (SELECT DISTINCT title FROM anchors WHERE length(title) > 2) z) t ON a.title = t.title",
    "L5_unlinkable": "SELECT surface, linked_count, total_count FROM surface_forms WHERE length(surface) < 3 OR linkability < 0.05",
    "L6_known_unlinkable": "SELECT t.surface, count(*) AS n FROM token_surfaces t LEFT ANTI JOIN linked_counts l ON t.surface = l.surface GROUP BY t.surface",
    "L7_linkability": "SELECT t.surface, round(coalesce(f.linkability, 1.0), 9) AS linkability FROM (SELECT DISTINCT surface FROM token_surfaces) t LEFT JOIN surface_forms f ON t.surface = f.surface",
    "L8_redirects_applied": "WITH RECURSIVE hop(src, dst, depth) AS (SELECT src, dst, 1 FROM redirects UNION ALL SELECT h.src, r.dst, h.depth + 1 FROM hop h JOIN redirects r ON h.dst = r.src WHERE h.depth < 50), heads AS (SELECT src, max_by(dst, depth) AS head FROM hop GROUP BY src) SELECT c.c_custkey, coalesce(h.head, 'n' || CAST(c.c_nationkey AS VARCHAR(10))) AS resolved FROM customer c LEFT JOIN heads h ON h.src = 'n' || CAST(c.c_nationkey AS VARCHAR(10))",
    "L9_normalised_titles": "SELECT DISTINCT title, CASE WHEN title IS NULL THEN '*null*' WHEN title LIKE 'ß%' THEN replace(title, ' ', '_') ELSE upper(substr(replace(title, ' ', '_'), 1, 1)) || substr(replace(title, ' ', '_'), 2) END AS normal FROM anchors",
    "L10_url_form": f"SELECT k AS url_key, max_by(title, n) AS title FROM (SELECT translate(lower(replace(replace(title, '-', '_'), ' ', '_')), {FOLD}) AS k, title, n * 1000000 + CAST(row_number() OVER (ORDER BY title) AS BIGINT) AS n FROM (SELECT title, count(*) AS n FROM anchors GROUP BY title) a) b GROUP BY k",
    "L14_disambiguation_pages": "SELECT title, title LIKE '%(disambiguation)' OR title IN (SELECT title FROM pair_counts WHERE surface IN (SELECT surface FROM pair_counts GROUP BY surface HAVING count(*) > 3)) AS is_disambiguation FROM (SELECT DISTINCT title FROM anchors) a",
    "L18_consolidated_triples": "SELECT arg1, arg2, round(CAST(sum(CASE WHEN pred = 'LINK' THEN 0.2 * score ELSE 1.0 * score END) AS DOUBLE), 6) AS score, coalesce(max(CASE WHEN pred <> 'LINK' THEN pred END), 'LINK') AS pred FROM triples GROUP BY arg1, arg2",
    "L19_similarity_lookup": "SELECT l.src, l.dst, round(s.in_pmi, 6) AS in_pmi, s.two_way FROM links l LEFT JOIN pairwise_sim s ON s.a = least(l.src, l.dst) AND s.b = greatest(l.src, l.dst)",
    "L16_relation_search": "SELECT p.p_partkey AS from_id, r.pred, r.arg2 AS to_id, r.score FROM triples r JOIN part p ON p.p_partkey = r.arg1 WHERE p.p_name LIKE '%1%' UNION ALL SELECT r.arg1, r.pred, s.s_suppkey, r.score FROM triples r JOIN supplier s ON s.s_suppkey = r.arg2 WHERE s.s_name LIKE '%2%'",
    "L11_bm25": "SELECT source, doc_id, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS BIGINT) AS k FROM (SELECT q.source, t.doc_id, round(sum(ln(1 + (d.n - v.df + 0.5) / (v.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * z.size / a.size))), 5) AS score FROM (SELECT title AS source, token FROM (SELECT title, token, row_number() OVER (PARTITION BY title ORDER BY tf DESC, token) AS r FROM source_counts WHERE length(token) > 5) x WHERE r <= 3) q JOIN term_counts t ON t.token = q.token JOIN vocab v ON v.token = q.token JOIN (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS size FROM term_counts GROUP BY doc_id) z ON z.doc_id = t.doc_id CROSS JOIN (SELECT CAST(sum(tf) AS DOUBLE) / count(DISTINCT doc_id) AS size FROM term_counts) a CROSS JOIN n_docs d GROUP BY q.source, t.doc_id) s WHERE score > 2.0",
    # Features.
    "F12_cosine": "SELECT d.doc_id, t.title, round(sum(d.w * t.w) / (max(x.len) * max(y.len)), 6) AS cosine FROM doc_vectors d JOIN documents o ON o.doc_id = d.doc_id JOIN title_vectors t ON t.token = d.token AND t.title = o.source JOIN (SELECT doc_id, sqrt(sum(w * w)) AS len FROM doc_vectors GROUP BY doc_id) x ON x.doc_id = d.doc_id JOIN (SELECT title, sqrt(sum(w * w)) AS len FROM title_vectors GROUP BY title) y ON y.title = t.title WHERE x.len > 0 AND y.len > 0 GROUP BY d.doc_id, t.title",
    "F14_shared_links": "SELECT a, b, i FROM out_shared",
    "F15_link_weights": "SELECT id, n, round(ln((CAST(t AS DOUBLE) + 1) / n), 6) AS log_specificity, round(CAST(1 AS DOUBLE) / n, 9) AS specificity FROM in_sizes CROSS JOIN (SELECT n AS t FROM titles_n) z",
    # The link features of relatedness; those of texts and categories are F12_cosine.
    "F16_link_relatedness": "SELECT p.a, p.b, round(p.in_pmi, 6) AS in_pmi, round(p.out_pmi, 6) AS out_pmi, round(p.in_ngd, 6) + 0e0 AS in_ngd, round(p.out_ngd, 6) + 0e0 AS out_ngd, round(coalesce(d.dot / (na.n * nb.n), 0e0), 6) AS in_cosine, round(coalesce(e.dot / (oa.n * ob.n), 0e0), 6) AS out_cosine, p.two_way FROM pairwise_sim p LEFT JOIN in_dots d ON d.a = p.a AND d.b = p.b LEFT JOIN out_dots e ON e.a = p.a AND e.b = p.b LEFT JOIN in_norms na ON na.id = p.a LEFT JOIN in_norms nb ON nb.id = p.b LEFT JOIN out_norms oa ON oa.id = p.a LEFT JOIN out_norms ob ON ob.id = p.b",
    "F17_shapes": "SELECT DISTINCT tok, tok = lower(tok) AS no_upper, substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) AS capitalised, CAST(length(tok) - length(translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals FROM tokens",
    "F18_likely_acronym": "SELECT DISTINCT tok, (tok <> 'I' AND length(tok) < 5 AND tok = upper(tok)) OR length(tok) - length(replace(tok, '.', '')) >= greatest(2, length(tok) / 2) AS acronym FROM tokens",
    "F21_canonical_title": "SELECT DISTINCT title, trim(split_part(split_part(replace(title, '_', ' '), ',', 1), '(', 1)) AS canonical FROM anchors",
    "F26_text_keys": "SELECT doc_id, md5(text) AS key FROM documents",
    "F27_span_overlaps": "SELECT a.doc_id, a.pos AS pos1, b.pos AS pos2 FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 2 WHERE a.ambiguity > 1 AND b.ambiguity > 1",
    "F30_softmax": "SELECT surface, title, round(exp(p_title) / sum(exp(p_title)) OVER (PARTITION BY surface), 9) AS share FROM surface_candidates",
    "F31_entropy": "SELECT surface, round(abs(sum(p_title * ln(p_title))), 6) AS entropy, round(abs(sum(p_title * ln(p_title))) / max(p_title), 6) AS confusion FROM surface_candidates GROUP BY surface",
    "F32_tfidf": "SELECT doc_id, token, round(w, 6) AS w FROM doc_vectors",
    "F33_reweighted": "SELECT surface, title, round(n * ln(CAST(sum(m) OVER (PARTITION BY surface) AS DOUBLE) / n), 6) AS w FROM (SELECT surface, title, n, max(n) OVER (PARTITION BY surface, title) AS m FROM pair_counts) x",
    "F34_top_words": "SELECT title, token, tf FROM (SELECT title, token, tf, row_number() OVER (PARTITION BY title ORDER BY tf DESC, token) AS r FROM source_counts) x WHERE r <= 20",
    "T1_title_features": "SELECT c.doc_id, c.pos, c.title, round(c.p_title, 9) AS p_title, c.rank, round(c.p_surface, 9) AS p_surface, round(CAST(a.n AS DOUBLE) / z.n, 9) AS frequency FROM candidates c JOIN (SELECT title, count(*) AS n FROM anchors GROUP BY title) a ON a.title = c.title CROSS JOIN (SELECT count(*) AS n FROM anchors) z",
    "C1_kept_candidates": "SELECT doc_id, pos, title, rank FROM candidates WHERE rank <= 3",
    "C2_context_windows": "SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - 1 AS n_context FROM mentions",
    "C5_coherence": "SELECT l.l_orderkey AS doc, p.l_partkey AS title, count(*) AS n_context, round(sum(coalesce(s.in_pmi, 0.0)) / count(*), 6) AS avg_in_pmi, round(greatest(max(coalesce(s.in_ngd, 0.0)), 0.0), 6) + 0e0 AS max_in_ngd, round(sum(CASE WHEN s.two_way THEN s.out_pmi ELSE 0.0 END) / count(*), 6) AS avg_two_way FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) p JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_orderkey = p.l_orderkey AND l.l_partkey <> p.l_partkey LEFT JOIN pairwise_sim s ON s.a = least(l.l_partkey, p.l_partkey) AND s.b = greatest(l.l_partkey, p.l_partkey) GROUP BY l.l_orderkey, p.l_partkey",
    # Text and span functions.
    "F3_isolated_punctuation": (
        "SELECT doc_id, CAST(length(x) AS BIGINT) AS n_chars, md5(x) AS key FROM (SELECT doc_id, regexp_replace(text, '([.,;:!?()])', ' $1 ') AS x FROM documents) y",
        r"SELECT doc_id, length(x) AS n_chars, md5(x) AS key FROM (SELECT doc_id, regexp_replace(text, '([.,;:!?()])', ' \1 ', 'g') AS x FROM documents) y",
    ),
    "F5_url_keys": f"SELECT DISTINCT title, translate(lower(replace(replace(title, '-', '_'), ' ', '_')), {FOLD}) AS url_key FROM anchors",
    "F7_stripped": (
        "SELECT surface, regexp_replace(surface, '[^A-Za-z0-9]', '') AS stripped FROM (SELECT DISTINCT surface FROM token_surfaces) x",
        "SELECT surface, regexp_replace(surface, '[^A-Za-z0-9]', '', 'g') AS stripped FROM (SELECT DISTINCT surface FROM token_surfaces) x",
    ),
    "F19_acronyms": (
        "SELECT p_partkey, regexp_replace(p_type, '[^A-Z]', '') AS capitals, array_join(transform(split(p_name, ' '), w -> upper(substr(w, 1, 1))), '') AS initials FROM part",
        "SELECT p_partkey, regexp_replace(p_type, '[^A-Z]', '', 'g') AS capitals, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1))), '') AS initials FROM part",
    ),
    # Customers' names with their nations stand for titles with a second entity, which must be a known name.
    "F22_secondary_entities": f"SELECT c_custkey, x.second FROM (SELECT c_custkey, {titles.secondary('full_name')} AS second FROM (SELECT c.c_custkey, replace(c.c_name, '#', '_') || ',_' || n.n_name AS full_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey) t) x WHERE x.second IN (SELECT n_name FROM nation)",
    "F23_heads": f"SELECT p_partkey, {titles.head('p_name')} AS head, {titles.head('p_type')} AS type_head FROM part",
    "F28_match_flags": "SELECT doc_id, pos, title, surface = lower(title) AS perfect, p_surface < 1e-6 AS no_surface_share FROM candidates",
    "M2_outermost_spans": "SELECT w.doc_id, w.s, w.e FROM (SELECT doc_id, pos AS s, pos + 1 AS e FROM mentions UNION SELECT doc_id, s, e FROM chunks) w LEFT ANTI JOIN (SELECT doc_id, s, e FROM chunks WHERE e - s > 1) c ON c.doc_id = w.doc_id AND c.s <= w.s AND c.e >= w.e AND c.e - c.s > w.e - w.s",
    "N10_contained_mentions": "SELECT c.doc_id, c.s, c.e, m.pos, m.surface FROM chunks c JOIN mentions m ON m.doc_id = c.doc_id AND m.pos >= c.s AND m.pos < c.e WHERE c.e - c.s BETWEEN 2 AND 4",
    "Z7_longest_first": "SELECT doc_id, s, e, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) AS BIGINT) AS place FROM chunks",
    "F29_sentence_starts": "SELECT doc_id, pos FROM (SELECT doc_id, pos, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens) x WHERE before IS NULL OR before LIKE '%.' OR before LIKE '%!' OR before LIKE '%?'",
    "K14_spell_index": (
        "SELECT title, substr(lower(title), i, n) AS gram, count(*) AS times FROM (SELECT title, n, explode(sequence(1, length(title) - n + 1)) AS i FROM (SELECT title, explode(sequence(1, 5)) AS n FROM (SELECT DISTINCT title FROM anchors) t) a WHERE n <= length(title)) b GROUP BY 1, 2",
        "SELECT title, substr(lower(title), i, n) AS gram, count(*) AS times FROM (SELECT title, n, unnest(range(1, length(title) - n + 2)) AS i FROM (SELECT title, unnest(range(1, 6)) AS n FROM (SELECT DISTINCT title FROM anchors) t) a WHERE n <= length(title)) b GROUP BY 1, 2",
    ),
    "K15_back_filled": "SELECT r.src, coalesce(t.dst, r.dst) AS dst FROM redirects r LEFT JOIN redirects t ON t.src = r.dst",
    "L21_recapitalised": "SELECT DISTINCT tok, CASE WHEN tok = upper(tok) AND length(tok) - length(translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '')) > 3 THEN upper(substr(tok, 1, 1)) || lower(substr(tok, 2)) ELSE tok END AS corrected FROM tokens",
    "M3_chunks": "SELECT doc_id, s, e FROM chunks WHERE e - s > 1",
    "M4_windows": "SELECT c.doc_id, m.pos AS s, m.pos + k.k AS e FROM chunks c JOIN mentions m ON m.doc_id = c.doc_id AND m.pos >= c.s AND m.pos < c.e CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) k(k) WHERE m.pos + k.k <= c.e AND NOT (m.pos = c.s AND m.pos + k.k = c.e)",
    "M6_merged_spans": "SELECT coalesce(b.doc_id, g.doc_id) AS doc_id, coalesce(b.pos, g.pos) AS pos, coalesce(g.gold, b.surface) AS surface FROM (SELECT doc_id, pos, surface FROM best WHERE linkability < 0.5) b FULL OUTER JOIN (SELECT doc_id, pos, gold FROM gold WHERE gold IS NOT NULL) g ON g.doc_id = b.doc_id AND g.pos = b.pos",
    "M10_eligible": "SELECT m.doc_id, m.pos FROM mentions m LEFT ANTI JOIN (SELECT token FROM vocab CROSS JOIN n_docs WHERE df * 2 > n_docs.n) s ON m.surface = s.token WHERE m.linkability >= 0.05 AND length(m.surface) >= 2",
    "N11_abbreviated": "SELECT a.doc_id, a.tok AS abbreviated, b.tok AS head FROM (SELECT DISTINCT doc_id, tok FROM tokens WHERE length(tok) < 5 AND tok LIKE '%.') a JOIN (SELECT DISTINCT doc_id, tok FROM tokens WHERE length(tok) < 4) b ON a.doc_id = b.doc_id AND a.tok = b.tok || '.'",
    "O3_mention_lines": "SELECT x.doc_id, x.pos, x.surface || ' -> ' || coalesce(x.link, '*null*') || ' / ' || coalesce(g.gold, '*null*') AS line FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos",
    "E10_equal_spans": "SELECT x.doc_id, count(*) AS n FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos AND g.gold = x.link GROUP BY x.doc_id",
    "Z4_known_tokens": "SELECT t.doc_id, CAST(sum(t.tf) AS BIGINT) AS n, count(*) AS n_distinct FROM term_counts t JOIN (SELECT token FROM vocab WHERE df >= 5) v ON v.token = t.token GROUP BY t.doc_id",
    "W7_sample": "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS STRING)), doc_id LIMIT 100",
    # Ranking and linking.
    "R1_scaling": "SELECT max(abs(l_quantity)) AS quantity, max(abs(l_extendedprice)) AS price, max(abs(l_discount)) AS discount, max(abs(l_tax)) AS tax FROM lineitem",
    "R2_linear_scores": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * l_quantity / 50 - 0.2 * l_discount + 0.1 * l_tax, 6) + 0e0 AS score FROM lineitem",
    "R4_ranked": "SELECT doc_id, pos, title, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, rank) AS BIGINT) AS place FROM (SELECT doc_id, pos, title, rank, round(2.0 * p_title + 0.5 * p_surface - 0.01 * rank, 6) AS score FROM candidates) c",
    "R6_margins": "SELECT doc_id, pos, title, score, round(score - coalesce(second, 0.0), 6) AS margin, round(CASE WHEN second IS NULL THEN 1.0 ELSE score / nullif(score + second, 0) END, 6) AS ratio FROM (SELECT doc_id, pos, title, rank, round(p_title, 6) AS score, lead(round(p_title, 6)) OVER (PARTITION BY doc_id, pos ORDER BY rank) AS second FROM candidates) x WHERE rank = 1",
    "R7_surface_properties": "SELECT surface, ambiguity, round(linkability, 9) AS linkability, round(CASE WHEN total_count > 10 THEN linkability ELSE 0.0 END, 9) AS over10, round(CASE WHEN total_count > 50 THEN linkability ELSE 0.0 END, 9) AS over50, round(CASE WHEN total_count > 100 THEN linkability ELSE 0.0 END, 9) AS over100, ambiguity = 1 AS unambiguous FROM surface_forms",
    "R8_linked": "SELECT doc_id, pos, top, link FROM decided",
    "R11_top_scores": "SELECT surface, title, n FROM surface_candidates WHERE rank <= 5",
    # Candidate generation: probes with a priority, the first that has candidates wins.
    "G_probe_chain": "SELECT doc_id, pos, probe, priority FROM (SELECT p.doc_id, p.pos, p.probe, p.priority, row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY p.priority) AS r FROM (SELECT doc_id, pos, lower(tok) AS probe, CAST(1 AS BIGINT) AS priority FROM tokens UNION ALL SELECT doc_id, pos, lower(replace(tok, '.', '')), CAST(2 AS BIGINT) FROM tokens WHERE tok LIKE '%.' UNION ALL SELECT doc_id, pos, lower(replace(replace(tok, '.', ''), ',', '')), CAST(3 AS BIGINT) FROM tokens) p JOIN linked_counts l ON l.surface = p.probe) x WHERE r = 1",
    "G11_almost_unambiguous": "SELECT surface, bool_or(p_title >= 0.99) AS unambiguous FROM surface_candidates GROUP BY surface",
    "L24_inverted_index": "SELECT token, count(*) AS n_titles FROM (SELECT DISTINCT surface AS token, title FROM anchor_surfaces UNION SELECT DISTINCT lower(substr(title, 1, 1)), title FROM anchors) x GROUP BY token",
    # Mentions.
    "M5_deduplicated_spans": "SELECT doc_id, pos, kind FROM (SELECT doc_id, pos, kind, row_number() OVER (PARTITION BY doc_id, pos ORDER BY priority) AS r FROM (SELECT doc_id, pos, 'NER' AS kind, 1 AS priority FROM mentions WHERE ambiguity > 1 UNION ALL SELECT doc_id, pos, 'NP', 2 FROM mentions) x) y WHERE r = 1",
    "M8_previous_token": "SELECT doc_id, pos FROM (SELECT doc_id, pos, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens) x WHERE substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) AND before IS NOT NULL AND before LIKE '%.'",
    "M12_types_by_surface": "SELECT m.doc_id, m.pos, max(CASE WHEN n.ambiguity > 1 THEN 'AMBIGUOUS' END) AS kind FROM mentions m JOIN (SELECT DISTINCT doc_id, surface, ambiguity FROM mentions) n ON m.doc_id = n.doc_id AND m.surface = n.surface GROUP BY m.doc_id, m.pos",
    # Coreference.
    "Q3_ambiguity": "SELECT doc_id, surface, count(DISTINCT top) AS n_titles, count(*) AS n FROM best GROUP BY doc_id, surface",
    "Q6_election": "SELECT doc_id, surface, max_by(link, votes) AS elected FROM (SELECT doc_id, surface, link, sum(p_title) * 1000000 + CAST(row_number() OVER (PARTITION BY doc_id, surface ORDER BY link) AS DOUBLE) AS votes FROM decided WHERE link IS NOT NULL GROUP BY doc_id, surface, link) v GROUP BY doc_id, surface",
    # Evaluation.
    "E1_hits_at_k": "SELECT k, CAST(sum(CASE WHEN hit <= k THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN hit IS NULL OR hit > k THEN 1 ELSE 0 END) AS BIGINT) AS missed FROM (SELECT g.doc_id, g.pos, min(c.rank) AS hit FROM (SELECT * FROM gold WHERE gold IS NOT NULL) g LEFT JOIN candidates c ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title = g.gold GROUP BY g.doc_id, g.pos) h CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) + 1 AS k FROM region) ks GROUP BY k",
    "E2_scores": "SELECT round(tp / nullif(pred, 0), 6) AS precision_, round(tp / nullif(n_gold, 0), 6) AS recall_, round(2 * tp / nullif(pred + n_gold, 0), 6) AS f1 FROM (SELECT CAST(sum(CASE WHEN x.link = g.gold THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(count(x.link) AS DOUBLE) AS pred, CAST(count(g.gold) AS DOUBLE) AS n_gold FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos) s",
    "E3_bag_of_concepts": "SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, count(p.t) AS predicted, count(g.t) AS expected, CAST(sum(CASE WHEN p.t = g.t THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM (SELECT DISTINCT doc_id, link AS t FROM decided WHERE link IS NOT NULL) p FULL OUTER JOIN (SELECT DISTINCT doc_id, gold AS t FROM gold WHERE gold IS NOT NULL) g ON p.doc_id = g.doc_id AND p.t = g.t GROUP BY 1",
    "E5_linker_accuracy": "SELECT count(*) AS n, CAST(sum(CASE WHEN g.gold IS NOT NULL AND x.top = g.gold THEN 1 ELSE 0 END) AS BIGINT) AS solvable, CAST(sum(CASE WHEN coalesce(x.link, '') = coalesce(g.gold, '') THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM decided x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos",
    "E7_transitions": "SELECT before, after, count(*) AS n FROM (SELECT event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x WHERE before IS NOT NULL GROUP BY before, after",
    "E8_oracle_recall": "SELECT rank, n, CAST(sum(n) OVER (ORDER BY rank) AS BIGINT) AS total FROM (SELECT c.rank, count(*) AS n FROM gold g JOIN candidates c ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title = g.gold GROUP BY c.rank) x",
    "E9_set_scores": "SELECT count(*) AS both_sets FROM (SELECT DISTINCT surface FROM token_surfaces INTERSECT SELECT DISTINCT surface FROM anchor_surfaces) x",
    "E13_averages": "SELECT role, count(*) AS n, round(avg(CAST(length(text) AS DOUBLE)), 6) AS mean_length FROM turns GROUP BY role",
    # Training samples and corpus statistics.
    "W1_ranker_samples": "SELECT c.doc_id, c.pos, c.title, round(g.p_title - c.p_title, 9) + 0e0 AS d_title, round(g.p_surface - c.p_surface, 9) + 0e0 AS d_surface FROM candidates c JOIN (SELECT x.doc_id, x.pos, x.title, x.p_title, x.p_surface FROM candidates x JOIN gold y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.title = y.gold) g ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title <> g.title",
    "W2_linker_samples": "SELECT x.doc_id, x.pos, CAST(CASE WHEN x.top = g.gold THEN 1 ELSE -1 END AS BIGINT) AS label FROM best x JOIN gold g ON g.doc_id = x.doc_id AND g.pos = x.pos",
    "W5_gold_candidates": "SELECT g.doc_id, g.pos, c.title, c.rank FROM gold g JOIN candidates c ON c.doc_id = g.doc_id AND c.pos = g.pos AND c.title = g.gold",
    "Z1_unigrams": "SELECT token, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM term_counts GROUP BY token",
    "Z2_vocabulary": "SELECT token, CAST(row_number() OVER (ORDER BY token) AS BIGINT) - 1 AS fid, df FROM vocab WHERE df >= 5",
    "Z5_words_by_class": "SELECT title AS source, token, tf FROM source_counts",
    "Z6_scored_titles": "SELECT title, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (length(title) - length(replace(title, '_', '')) + 1), 6) AS score FROM anchors GROUP BY title",
    "Z8_row_windows": "SELECT a.conv_id, a.turn, b.turn AS near_turn, abs(a.turn - b.turn) AS distance FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn",
    "Z9_dense_ids": "SELECT event_type, CAST(dense_rank() OVER (ORDER BY first_id) AS BIGINT) - 1 AS id FROM (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type) x",
}

#: The oracle's dialect has no LEFT ANTI JOIN ... ON by that name.
ORACLE_WORDS = {" LEFT ANTI JOIN ": " ANTI JOIN ", " LEFT SEMI JOIN ": " SEMI JOIN ", "AS STRING)": "AS VARCHAR)"}
